"""Fixed tables of the path audit: sensitive patterns, privacy rules, allowlist, and words of paths."""

from __future__ import annotations

#: Id, severity, category, globs. Each glob also holds at any depth (`**/` before it), unless it has that already.
_PATTERNS = [
    ("env-files", "required", "secret", [".env", ".env.*", ".env*"]),
    ("pem-files", "required", "secret", ["*.pem"]),
    ("key-files", "required", "secret", ["*.key"]),
    ("ssh-files", "recommended", "secret", [".ssh/", ".ssh/**", "id_rsa", "**/.ssh/id_rsa", "id_ed25519", "id_ecdsa", "*.ppk"]),
    ("aws-files", "recommended", "cloud", [".aws/", ".aws/**", ".aws/credentials"]),
    ("credentials-json", "required", "secret", ["credentials.json"]),
    ("secrets-json", "required", "secret", ["secrets.json"]),
    ("gcp-credentials", "recommended", "cloud", ["service-account*.json", "gcp-credentials*.json"]),
    ("azure-credentials", "recommended", "cloud", [".azure/", ".azure/**", "azureauth.json"]),
    ("kube-config", "required", "cloud", ["kubeconfig", "*.kubeconfig", ".kube/", ".kube/**"]),
    ("terraform-state", "recommended", "cloud", ["*.tfstate", "*.tfstate.*"]),
    ("terraform-vars", "recommended", "cloud", ["*.tfvars"]),
    ("pkcs12-p12", "recommended", "signing", ["*.p12"]),
    ("pkcs12-pfx", "recommended", "signing", ["*.pfx"]),
    ("pgp-keys", "recommended", "secret", ["*.gpg", "secring.*"]),
    ("netrc-files", "recommended", "secret", [".netrc", "_netrc"]),
    ("npmrc-files", "recommended", "secret", [".npmrc"]),
    ("pypirc-files", "recommended", "secret", [".pypirc"]),
    ("htpasswd-files", "recommended", "secret", [".htpasswd"]),
    ("docker-config", "recommended", "secret", [".docker/", ".docker/**", ".dockerconfigjson"]),
    ("firebase-keys", "required", "cloud", ["serviceAccountKey.json", "firebase-adminsdk-*.json"]),
    ("firebase-client-config", "recommended", "cloud", ["google-services.json", "GoogleService-Info.plist"]),
    ("android-local-properties", "recommended", "secret", ["local.properties"]),
    ("xcode-secrets-xcconfig", "recommended", "secret", ["Secrets.xcconfig"]),
    ("spring-local-config", "recommended", "secret", ["application-local.*"]),
    ("cargo-credentials", "recommended", "secret", [".cargo/credentials", ".cargo/credentials.toml", ".cargo/credentials.json", ".cargo/credentials*"]),
    ("auth-json", "recommended", "secret", ["auth.json"]),
    ("aws-root-key-csv", "required", "cloud", ["accessKeys.csv", "credentials.csv"]),
    ("vpn-rdp-configs", "recommended", "secret", ["*.ovpn", "*.rdp"]),
    ("keepass-databases", "required", "secret", ["*.kdbx"]),
    ("fly-cli-config", "recommended", "cloud", [".fly/", ".fly/**", ".fly/config.yml"]),
    ("git-credentials", "required", "secret", [".git-credentials"]),
    ("rails-master-key", "required", "secret", ["master.key"]),
    ("secrets-yaml", "required", "secret", ["secrets.yml", "secrets.yaml", "credentials.yml", "credentials.yaml"]),
    ("gnupg-home", "recommended", "secret", [".gnupg/", ".gnupg/**"]),
    ("pgpass-files", "recommended", "secret", [".pgpass"]),
    ("mysql-client-config", "recommended", "secret", [".my.cnf"]),
    ("yarn-config", "recommended", "secret", [".yarnrc.yml"]),
    ("terraform-rc", "recommended", "cloud", [".terraformrc", "terraform.rc"]),
    ("apple-p8-keys", "recommended", "signing", ["*.p8"]),
    ("android-keystore", "recommended", "signing", ["*.keystore", "*.jks"]),
    ("apple-provisioning", "recommended", "signing", ["*.mobileprovision"]),
    ("local-databases", "informational", "pii", ["*.sqlite", "*.sqlite3"]),
    ("log-files", "informational", "pii", ["*.log", "logs/", "logs/**"]),
    ("data-exports", "informational", "pii", ["dumps/", "dumps/**", "exports/", "exports/**"]),
    ("backup-files", "informational", "pii", ["*.bak", "*.backup"]),
    ("shell-history", "informational", "history", [".bash_history", ".zsh_history", ".psql_history", ".mysql_history", ".python_history"]),
    ("agent-transcripts", "recommended", "history", ["agent-transcripts/**", "**/.cursor/agent-transcripts/**"]),
    ("db-dumps", "informational", "pii", ["*.sql.gz", "*.dump"]),
]
SENSITIVE_PATTERNS = [
    (pattern, severity, category, list(dict.fromkeys(g for glob in globs for g in ([glob] if glob.startswith("**/") else [glob, f"**/{glob}"]))))
    for pattern, severity, category, globs in _PATTERNS
]


def privacy_rules(product: str = "veilmark") -> list[tuple[str, str | None, str, list[str], bool]]:
    """Rules of the audit: id, tool, severity, globs, whether its ignore file is checked for exposures; the first glob is the file a fix writes."""
    #: Fixed values; the files of two tools carry the product's name.
    return [
        ("cursor-ignore", "cursor", "required", [".cursorignore"], True),
        ("cursor-indexing-ignore", "cursor", "recommended", [".cursorindexingignore"], True),
        ("cursor-project-rules", "cursor", "recommended", [f".cursor/rules/{product}_privacy.mdc", ".cursor/rules/privacy.mdc"], False),
        ("claude-project-rules", "claude", "recommended", [f".claude/rules/{product}_privacy.md"], False),
        ("copilot-exclude", "copilot", "recommended", [".aiexclude"], True),
        ("continue-ignore", "continue", "recommended", [".continueignore"], True),
        ("codeium-ignore", "windsurf", "recommended", [".codeiumignore"], True),
        ("claude-ignore", "claude", "recommended", [".claudeignore"], True),
        ("gemini-ignore", "gemini", "recommended", [".geminiignore"], True),
        ("llm-ignore", "llm", "recommended", [".llmignore"], True),
        ("aider-ignore", "aider", "recommended", [".aiderignore"], True),
        ("cline-ignore", "cline", "recommended", [".clineignore"], True),
        ("roo-ignore", "roo", "recommended", [".rooignore"], True),
        ("zed-ignore", "zed", "recommended", [".zedignore"], True),
        ("cody-ignore", "cody", "recommended", [".codyignore"], True),
        ("agents-md", None, "informational", ["AGENTS.md"], False),
        ("claude-md", "claude", "informational", ["CLAUDE.md"], False),
        ("git-ignore", None, "informational", [".gitignore"], False),
    ]


#: Paths that are no exposure.
ALLOWLIST = [
    ".env.example", "**/.env.example", "public.key", "**/public.key", "license.key", "**/license.key", "licence.key", "**/licence.key",
    "Tests/**", "**/Tests/**", "test/**", "**/test/**", "**/*Tests/**", "**/*tests/**",
]
#: Directories that a walk doesn't enter.
SKIPPED_DIRECTORIES = [".git", "node_modules", ".build", "build", "DerivedData"]

#: Words of the sensitivity tier.
TIER_PLACEHOLDERS = "example sample template dist tmpl".split()
TIER_SECRET_NAMES = "config configuration secrets secret credentials".split()
TIER_SECRET_EXTENSIONS = "env tfvars pem key p12 pfx keystore jks ppk asc".split()
TIER_KEY_FILES = "id_rsa id_dsa id_ecdsa id_ed25519".split()
TIER_KEY_DIRECTORIES = ".ssh .aws .gnupg".split()
TIER_DOC_DIRECTORIES = "test tests __tests__ spec specs docs doc example examples fixtures fixture __fixtures__ __mocks__ mocks sample samples testdata".split()
TIER_DOC_EXTENSIONS = "md markdown mdx rst adoc".split()
TIER_DOC_NAMES = "readme changelog license licence contributing authors notice codeowners".split()

#: Words of a path that an attachment should not have.
SUSPICIOUS_DIRECTORIES = ".ssh .aws .azure .kube .docker .gnupg .fly".split()
SUSPICIOUS_NAMES = "id_rsa id_ed25519 id_ecdsa kubeconfig serviceaccountkey secring accesskeys firebase-adminsdk application-local".split()
SUSPICIOUS_FILES = (
    "google-services.json googleservice-info.plist local.properties master.key auth.json "
    ".npmrc .pypirc .netrc _netrc .git-credentials .pgpass .my.cnf .htpasswd .yarnrc.yml .terraformrc"
).split()
SUSPICIOUS_DOCUMENTS = "credentials secrets".split()
SUSPICIOUS_DOCUMENT_EXTENSIONS = "json yml yaml csv env toml ini conf properties xml txt p12 pfx pem key".split()
SUSPICIOUS_EXTENSIONS = "pem p12 pfx p8 kdbx ovpn rdp tfstate tfvars jks keystore mobileprovision".split()
BENIGN_KEYS = "public.key license.key licence.key".split()

#: Marks of a setting that starts programs.
EXECUTABLE_MARKS = [
    '"runtimeexecutable"', '"pythonpath"', "defaultinterpreterpath", "interpreterpath", '"shell.args"', '"terminal.integrated.env',
    '"task.command"', '"command":', "/bin/sh", "/bin/bash", "/usr/bin/env", "node_options", "pythonpath",
]
