"""Rows that the driver tables lack: rare findings, labelled paths, commands and addresses, dealt out over ids by remainder."""

from __future__ import annotations

_A = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGH"
#: Texts with rare findings; put together here so that no secret-shaped literal stands in the repository.
FINDINGS = [
    "nothing here",
    "pay $1,200.50 or €40 to GB82" + "WEST12345698765432 not GB00" + "WEST12345698765432",
    "key " + "sk-" + _A[:36] + " and " + "AKIA" + "ABCDEFGHIJ234567",
    "use " + "ghp_" + _A[:36] + " then " + "xoxb-" + "123456789012-abcdef",
    "stripe " + "sk_live_" + _A[:24] + " see https://example.com/a?b=c",
    "-----BEGIN RSA " + "PRIVATE KEY-----\nMIIE\nabc\n-----END RSA " + "PRIVATE KEY-----",
    "postgres://user:" + "pass@db.internal/x host build.corp",
    "Authorization: Bearer " + _A[:30] + " invoice INV-12345 order ORD_777 contract CN-1234",
    "api_key = " + "your_" + _A[:24] + " placeholder",
    "cost $5 card 4111 1111 1111 1111 bad 4111 1111 1111 1112",
    "gsk_" + _A[:24] + " glpat-" + _A[:22] + " hf_" + _A[:32] + " npm_" + _A[:36],
    "blob " + "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo" + "0123456789+/=abc",
    "skip this token = " + _A[:25] + " # scan-ok",
    "call +1 415 555 2671, (415) 555-2671 8 (495) 123-45-67 or 020 7946 0958-12 not 2024-01-02 nor 10.20.30.40 nor a415-555-2671",
    "session " + "eyJ" + "hbGciOiJub25lIn0.eyJhIjoxfQ.c2ln" + " and " + "eyJ" + "0eXAiOiJ4In0.eyJhIjoxfQ.c2ln",
]
#: Mark of a line whose findings don't count.
IGNORE_MARK = "scan-ok"
TERMS = [("client", "General Public License"), ("company", "All rights reserved"), ("sensitiveTerm", "licensed under"), ("internalDomain", "build.corp")]

#: Lines of ignore files.
IGNORE_LINES = {".cursorignore": ["*.pem", "/docs/", "logs/", "!keep.pem"], ".aiexclude": [".env", "secret-*", "a/b/c"]}
EXCLUDES = ["docs/**", "**/vendor/**", "*.lock", "**/gen.py", "src/*.tmp"]
#: path, first sensitive pattern, allowlisted, ignored, excluded, tier, suspicious, artifact kind. Labelled by hand.
PATHS = [
    (".env", "env-files", False, True, False, "secretsConfig", True, None),
    ("app/.env.local", "env-files", False, False, False, "secretsConfig", True, None),
    (".env.example", "env-files", True, False, False, "neutral", True, None),
    ("certs/server.pem", "pem-files", False, True, False, "secretsConfig", True, None),
    ("keep.pem", "pem-files", False, False, False, "secretsConfig", True, None),
    ("public.key", "key-files", True, False, False, "secretsConfig", False, None),
    ("ops/master.key", "key-files", False, False, False, "secretsConfig", True, None),
    ("home/.ssh/known_hosts", "ssh-files", False, False, False, "secretsConfig", True, "sshConfig"),
    ("docs/readme.md", None, False, True, True, "docsOrTests", False, None),
    ("a/docs/readme.md", None, False, False, False, "docsOrTests", False, None),
    ("src/main.rs", None, False, False, False, "neutral", False, None),
    ("src/config.yml", None, False, False, False, "secretsConfig", False, None),
    ("config.sample.yml", None, False, False, False, "neutral", False, None),
    ("logs/app.log", "log-files", False, True, False, "neutral", False, None),
    ("Tests/x.pem", "pem-files", True, True, False, "secretsConfig", True, None),
    ("infra/prod.tfstate", "terraform-state", False, False, False, "neutral", True, None),
    ("infra/prod.tfvars", "terraform-vars", False, False, False, "secretsConfig", True, None),
    ("x/credentials.json", "credentials-json", False, False, False, "secretsConfig", True, None),
    (".vscode/tasks.json", None, False, False, False, "neutral", False, "editorTaskConfig"),
    (".vscode/settings.json", None, False, False, False, "neutral", False, "editorSettings"),
    (".git/hooks/pre-commit", None, False, False, False, "neutral", False, "gitHook"),
    (".git/config", None, False, False, False, "secretsConfig", False, "gitConfig"),
    ("home/.zshrc", None, False, False, False, "neutral", False, "shellStartupConfig"),
    ("lib/vendor/x/y.js", None, False, False, True, "neutral", False, None),
    ("yarn.lock", None, False, False, True, "neutral", False, None),
    ("a/b/gen.py", None, False, False, True, "neutral", False, None),
    ("src/a.tmp", None, False, False, True, "neutral", False, None),
    ("src/a/b.tmp", None, False, False, False, "neutral", False, None),
    ("secret-plan/x.txt", None, False, True, False, "neutral", False, None),
    ("a/b/c/d.txt", None, False, True, False, "neutral", False, None),
    ("web/foo.test.ts", None, False, False, False, "docsOrTests", False, None),
    ("x/.cursor/agent-transcripts/t.jsonl", "agent-transcripts", False, False, False, "neutral", False, None),
    (".cargo/credentials.toml", "cargo-credentials", False, False, False, "secretsConfig", True, None),
    ("db/backup.sql.gz", "db-dumps", False, False, False, "neutral", False, None),
    (".cursorignore", None, False, False, False, "neutral", False, None),
    ("AGENTS.md", None, False, False, False, "docsOrTests", False, None),
    ("venv/lib/site-packages/x.pth", None, False, False, False, "neutral", False, "pythonStartupHook"),
]
#: command, decision, reasons. Labelled by hand.
COMMANDS = [
    ("ls -la", "allow", ""),
    ("git config core.pager less", "deny", "git-config"),
    ("git config --list", "allow", ""),
    ("PYTHONPATH=x python run.py", "deny", "environment"),
    ("docker run alpine", "deny", "container"),
    ("cat .env", "ask", "sensitive-path"),
    ("veilmark policy trust", "deny", "policy"),
    ("veilmark unseal notes.txt", "deny", "unseal"),
    ("vim ~/.ssh/config", "deny", "artifact"),
    ("cat fixtures/a.txt", "deny", "ignored"),
    ("cat 'c'+\"ert.pem\"", "ask", "sensitive-path"),
    ("echo done", "allow", ""),
]
#: address of a repository, normal form or none. Labelled by hand.
REPOSITORIES = [
    ("git@github.com:owner/name.git", "https://github.com/owner/name"),
    ("https://user:pw@GitHub.com/owner/name/?q=1#x", "https://github.com/owner/name"),
    ("github.com/owner/name", "https://github.com/owner/name"),
    ("  https://www.github.com/a/b.git ", "https://www.github.com/a/b"),
    ("http://github.com/a/b", None),
    ("https://github.com:8080/a/b", None),
    ("https://gitlab.com/a/b", None),
    ("https://github.com/a/b/tree/main", None),
    ("https://github.com/../b", None),
    ("", None),
]
#: Server rules: idx, server, tool, mode.
SERVER_RULES = [(0, "*", "*", "ask"), (1, "postgres", "*", "deny"), (2, "*", "query", "allow"), (3, "files", "read_*", "allow"), (4, "files", "read_*", "deny"), (5, "post*", "query", "observe")]
SERVERS, TOOLS = ["postgres", "files", "shell"], ["query", "read_file", "write", "read_dir"]
#: Labels of a token model, dealt out by remainder.
TOKEN_LABELS = ["O", "B-PER", "I-PER", "I-LOC", "B-LOC", "E-PER", "S-ORG"]
#: Arguments of a call.
ARGUMENTS = ["select 1", "read config/.env", "mail ann@corp.example", "plain words", "key " + "AKIA" + "ABCDEFGHIJ234567"]
#: command, the same with secret arguments hidden. By hand.
SECRET_COMMANDS = [
    ("run --token abc --x 1", "run --token *** --x 1"),
    ("run --api-key=abc y", "run --api-key=*** y"),
    ("PASSWORD=x run", "PASSWORD=*** run"),
    ("get https://u:p@h/x", "get https://***@h/x"),
    ("ls -la", "ls -la"),
]
#: sensitive pattern, the line that ignores it. By hand.
CANONICAL_LINES = [
    ("env-files", ".env.*"), ("pem-files", "*.pem"), ("key-files", "*.key"), ("ssh-files", "*.ppk"), ("terraform-state", "*.tfstate"), ("terraform-vars", "*.tfvars"),
    ("credentials-json", "credentials.json"), ("agent-transcripts", "agent-transcripts/**"), ("cargo-credentials", ".cargo/credentials*"), ("log-files", "*.log"), ("db-dumps", "*.sql.gz"),
]
