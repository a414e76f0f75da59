"""Column predicates on paths: globs, ignore lines, excludes, tiers and classes. Patterns are literals compiled at plan time."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.functions import path_tables as T


def _quoted(text: str) -> str:
    """Regex for a literal, in a form that Java, RE2 and Python read alike."""
    return re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", text) if text.isascii() else re.escape(text)


def glob_regex(glob: str) -> str:
    """An anchored regex: `**/` any directories or none, `**` anything, `*` and `?` within one segment."""
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    wild = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(wild.get(p, _quoted(p) if p else "") for p in parts) + "$"


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def matches_glob(path: Column, *globs: str) -> Column:
    """Whether any of the globs matches, as one alternation: a path is read once however many globs there are."""
    if not globs:
        return F.lit(False)
    return path.rlike("^(?:" + "|".join(glob_regex(g)[1:-1] for g in globs) + ")$")


def _ignore_regex(line: str) -> str | None:
    """The regex of one ignore line (without its `!`); None if it matches nothing."""
    pattern = line.strip()
    anchored = pattern.startswith("/")
    pattern = pattern[1:] if anchored else pattern
    pattern = pattern[:-1] if pattern.endswith("/") else pattern
    if not pattern:
        return None
    wild = "*" in pattern or "?" in pattern
    if anchored or "/" in pattern:
        return glob_regex(pattern) if wild else f"^{_quoted(pattern)}(?:$|/)"
    return f"(?:^|/){glob_regex(pattern)[1:-1]}(?:/|$)" if wild else f"(?:^|/){_quoted(pattern)}(?:/|$)"


def is_ignored(path: Column, lines: Iterable[str]) -> Column:
    """Whether the lines of one ignore file cover a path: at least one does and no `!` line does, in any order."""
    plain, negated = [], []
    for line in lines:
        body = line.strip()
        if body.startswith("!") and len(body) > 1:
            negated.append(_ignore_regex(body[1:]))
        else:
            plain.append(_ignore_regex(body))
    hit = any_of(path.rlike(r) for r in dict.fromkeys(plain) if r)
    return hit & ~any_of(path.rlike(r) for r in dict.fromkeys(negated) if r)


def normalised(path: Column) -> Column:
    """Backslashes as slashes, without leading `./` and one leading slash."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./)+", ""), "^/", "")


def is_excluded(path: Column, patterns: Iterable[str]) -> Column:
    """Whether exclude patterns cover a path: `dir/**` a tree, `**/x` any depth, others a path or base name."""
    p = normalised(path)
    base = F.regexp_extract(p, "[^/]*$", 0)
    segments = F.filter(F.split(p, "/"), lambda s: s != "")

    def segment(body: str) -> Column:
        if "/" in body:
            q = _quoted(body)
            return p.rlike(f"^{q}$|/{q}$|/{q}/")
        return F.exists(segments, lambda s: s.rlike(glob_regex(body)))

    def one(pattern: str) -> Column:
        if pattern.endswith("/**"):
            body = pattern[:-3]
            if body.startswith("**/"):
                return segment(body[3:])
            return segment(body) if re.search(r"[*?\[]", body) else p.rlike(f"^{_quoted(body)}(?:$|/)")
        if pattern.startswith("**/"):
            rest = pattern[3:]
            return p.rlike(f"(?:^|/){_quoted(rest)}$") if "/" in rest else base.rlike(glob_regex(rest))
        if "/" in pattern:
            return matches_glob(p, pattern)
        return base.rlike(glob_regex(pattern)) | matches_glob(p, pattern)

    return (p != "") & any_of(one(x) for x in patterns)


def skips_directory(path: Column, patterns: Iterable[str] = ()) -> Column:
    p = normalised(path)
    return (p != "") & (p.rlike(r"(?:^|/)\.git$") | is_excluded(path, patterns))


def under_skipped(path: Column, names: Iterable[str] = T.SKIPPED_DIRECTORIES) -> Column:
    """Whether a directory above the file is one that a walk doesn't enter."""
    return path.rlike("(?:^|/)(?:" + "|".join(map(_quoted, names)) + ")/")


def is_allowlisted(path: Column) -> Column:
    return matches_glob(path, *T.ALLOWLIST)


def sensitive_pattern(path: Column) -> Column:
    """The id of the first sensitive pattern, in the order of the table, that matches; null if none does."""
    return F.coalesce(*[F.when(matches_glob(path, *globs), F.lit(i)) for i, _, _, globs in T.SENSITIVE_PATTERNS])


def canonical_ignore_line(globs: list[str]) -> str | None:
    """The glob to write into an ignore file: the first with `*` and no `**`, else the first without `**`, else the first."""
    flat = [g for g in globs if "**" not in g]
    return next((g for g in flat if "*" in g), next(iter(flat), next(iter(globs), None)))


def sensitivity_tier(path: Column) -> Column:
    """neutral, secretsConfig or docsOrTests from a path alone."""
    segments = F.filter(F.split(F.lower(path), r"[/\\]"), lambda s: s != "")
    name = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lower(path))
    above = F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))
    base = F.when(name.rlike(r"(?s)^.+\."), F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1)).otherwise(name)
    extension = F.when(name.rlike(r"(?s)^.+\."), F.regexp_extract(name, r"\.([^.]*)$", 1)).otherwise("")
    secret = (
        (name == ".env") | name.startswith(".env.") | name.isin(*T.TIER_KEY_FILES) | extension.isin(*T.TIER_SECRET_EXTENSIONS)
        | base.isin(*T.TIER_SECRET_NAMES) | F.arrays_overlap(above, F.array(*map(F.lit, T.TIER_KEY_DIRECTORIES)))
    )
    docs = (
        extension.isin(*T.TIER_DOC_EXTENSIONS) | base.isin(*T.TIER_DOC_NAMES) | F.arrays_overlap(above, F.array(*map(F.lit, T.TIER_DOC_DIRECTORIES)))
        | base.rlike(r"(?:[._](?:test|spec))$|^test_")
    )
    placeholder = name.rlike("|".join(T.TIER_PLACEHOLDERS))
    return F.when(~placeholder & secret, "secretsConfig").when(docs, "docsOrTests").otherwise("neutral")


def is_suspicious(path: Column) -> Column:
    """Whether a file named in a prompt or read looks like one with secrets."""
    lower = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.regexp_extract(lower, r"([^/]+)/*$", 1)
    extension = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    slashed = F.concat(F.lit("/"), lower, F.lit("/"))
    marked = "|".join(map(_quoted, T.SUSPICIOUS_NAMES))
    documents = "|".join(T.SUSPICIOUS_DOCUMENT_EXTENSIONS)
    return (
        name.rlike(r"^\.env$|^\.env\.|\.env$") | name.isin(*T.SUSPICIOUS_FILES)
        | slashed.rlike("/(?:" + "|".join(map(_quoted, T.SUSPICIOUS_DIRECTORIES)) + ")/") | slashed.rlike(r"/\.cargo/+credentials")
        | name.rlike(f"^(?:{marked})(?:$|[._-])") | name.rlike(f"^(?:{'|'.join(T.SUSPICIOUS_DOCUMENTS)})(?:$|\\.(?:{documents})$)")
        | extension.isin(*T.SUSPICIOUS_EXTENSIONS) | ((extension == "key") & ~name.isin(*T.BENIGN_KEYS))
    )


def artifact_class(path: Column, policy_file: str = ".veilmark.yml") -> Column:
    """struct<kind, enforcement> of a file that runs or steers programs, by the first class that fits; null if none does."""
    lower = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.regexp_extract(lower, "[^/]*$", 0)
    s = F.concat(F.lit("/"), F.regexp_replace(lower, "/+", "/"), F.lit("/"))
    in_git = F.regexp_extract(s, r"^.*?/\.git/(.*)$", 1)

    def pairs(*found: str) -> Column:
        return s.rlike("/(?:" + "|".join(_quoted(x) for x in found) + ")/")

    def as_class(kind: str, enforcement: str = "deny") -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(enforcement).alias("enforcement"))

    return (
        F.when(name == policy_file, as_class("policy"))
        .when(pairs(".cursor/hooks.json", ".claude/settings.json", ".claude/settings.local.json", ".windsurf/hooks.json", ".codex/hooks.json"), as_class("editorHookConfig"))
        .when(pairs(".vscode/tasks.json", ".vscode/launch.json"), as_class("editorTaskConfig"))
        .when(pairs(".vscode/settings.json") | name.endswith(".code-workspace"), as_class("editorSettings", "denyWhenContentExecutable"))
        .when(name.isin(".zshrc", ".zprofile", ".zshenv", ".bashrc", ".bash_profile", ".profile", ".envrc", ".direnvrc") | pairs(".config/fish/config.fish", ".config/direnv/direnvrc"), as_class("shellStartupConfig"))
        .when(pairs(".ssh"), as_class("sshConfig"))
        .when(pairs("launchagents", "launchdaemons"), as_class("launchAgent"))
        .when(pairs(".git") & ((in_git != "") & F.concat(F.lit("/"), in_git).rlike("/hooks/") | (in_git != "") & name.isin("pre-commit", "pre-push")), as_class("gitHook"))
        .when(pairs(".git") & (in_git != "") & (name == "config"), as_class("gitConfig"))
        .when(pairs(".git"), as_class("gitDirectoryPointer"))
        .when((name == ".gitconfig") | pairs(".config/git/config"), as_class("gitConfig"))
        .when((name.endswith(".pth") & pairs("site-packages")) | name.isin("sitecustomize.py", "usercustomize.py"), as_class("pythonStartupHook"))
        .when(name == "pyvenv.cfg", as_class("virtualEnvironmentInterpreter", "observe"))
    )


def looks_executable(content: Column) -> Column:
    return F.lower(content).rlike("|".join(map(_quoted, T.EXECUTABLE_MARKS)))


def edit_touches_executable(content: Column, old: Column) -> Column:
    """Whether a mark stands in the 160 characters before the text that an edit replaces."""
    at = F.call_function("instr", content, old)
    start = F.greatest(at - 160, F.lit(1))
    return (at > 0) & looks_executable(content.substr(start, at - start))


def resolve_path(path: Column) -> Column:
    """A path with slashes only, without `.` and empty segments, `..` taking one segment away."""
    absolute = F.replace(path, F.lit("\\"), F.lit("/")).startswith("/")
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda a, s: F.when(s.isin("", "."), a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))),
    )
    resolved = F.concat(F.when(absolute, "/").otherwise(""), F.array_join(kept, "/"))
    return F.when(path.rlike(r"\\|//|(?:^|/)\.\.?(?:/|$)|/$|^$"), resolved).otherwise(path)  # most are so already


def is_safe_relative(path: Column) -> Column:
    """A relative path that stays inside: not absolute, no home, no drive, no NUL, no `..`."""
    return (path != "") & ~path.rlike(r"^[/\\~]|^[A-Za-z]:|\x00") & ~F.exists(F.split(path, r"[/\\]"), lambda s: s == "..")
