"""Column functions on texts, commands, addresses and JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of an argument's name that say its value is a secret.
SECRET_ARGUMENTS = "token key secret password passwd auth credential bearer".split()
#: Settings of git that run programs, and variables that change what runs.
GIT_PROGRAM_KEYS = (
    "core.hookspath core.sshcommand core.gitproxy core.fsmonitor core.editor core.pager core.askpass init.templatedir "
    "sequence.editor diff.external gpg.program include.path credential.helper"
).split()
POISON_VARIABLES = (
    "BASH_ENV ENV ZDOTDIR IFS CDPATH SHELLOPTS NODE_OPTIONS PYTHONPATH PYTHONSTARTUP PYTHONHOME LD_PRELOAD "
    "DYLD_INSERT_LIBRARIES GIT_SSH_COMMAND GIT_ASKPASS GIT_EDITOR SSH_ASKPASS"
).split()
CONTAINER_PROGRAMS = "docker podman nerdctl docker-compose".split()
CONTAINER_ACTIONS = "run create exec start attach cp up build pull push commit load import tag".split()
#: Hosts of repositories that may be scanned.
REPOSITORY_HOSTS = ("github.com", "www.github.com")


def json_field(payload: Column, *paths: str) -> Column:
    """The first of several JSON paths that is there."""
    return F.coalesce(*[F.get_json_object(payload, p) for p in paths])


def json_strings(payload: Column) -> Column:
    """All string values of a JSON text, in order, however deep: a quoted string before a colon is a key."""
    quoted = F.regexp_extract_all(payload, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0))
    values = F.filter(quoted, lambda s: ~s.endswith(":"))
    return F.transform(values, lambda s: F.get_json_object(F.concat(F.lit('{"v":'), s, F.lit("}")), "$.v"))


def path_mentions(text: Column) -> Column:
    """Paths named with @, up to a blank or one of , ; ) ] that hold a slash or dot."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"@([^\s,;)\]]+)"), F.lit(1)), lambda p: p.rlike(r"[/.]"))


def shell_tokens(command: Column) -> Column:
    tokens = F.transform(F.split(command, r"\s+"), lambda t: F.regexp_replace(t, r"^[;&|]+|[;&|]+$", ""))
    return F.filter(tokens, lambda t: t != "")


def quoted_literals(command: Column) -> Column:
    """Texts in single or double quotes."""
    return F.transform(F.regexp_extract_all(command, F.lit(r"""("[^"]*"|'[^']*')"""), F.lit(1)), lambda t: t.substr(F.lit(2), F.length(t) - 2))


def joined_literals(command: Column) -> Column:
    """Literals put together from adjacent ones with +: `"a"+"b"` is `ab`."""
    chains = F.regexp_extract_all(command, F.lit(r"""((?:"[^"]*"|'[^']*')(?:\s*\+\s*(?:"[^"]*"|'[^']*'))+)"""), F.lit(1))
    return F.transform(chains, lambda c: F.array_join(quoted_literals(c), ""))


def path_candidates(command: Column) -> Column:
    """What in a command may be a path: tokens with a slash, backslash or leading dot, literals, and joined literals."""
    bare = F.transform(shell_tokens(command), lambda t: F.regexp_replace(t, "^['\"]+|['\"]+$", ""))
    tokens = F.filter(bare, lambda t: t.rlike(r"[/\\]|^\.") & ~t.startswith("-"))
    literals = F.filter(quoted_literals(command), lambda t: (t != "") & ~t.startswith("-") & (t.rlike(r"[/\\]|^\.") | ~F.contains(t, F.lit(" "))))
    return F.array_distinct(F.concat(tokens, F.filter(joined_literals(command), lambda t: t != ""), literals))


def _program(token: Column) -> Column:
    return F.regexp_extract(token, r"[^/\\]*$", 0)


def git_config_mutation(command: Column) -> Column:
    """Whether a command changes git's configuration; reading it is fine."""
    tokens = shell_tokens(command)
    at = F.array_position(F.transform(tokens, _program), F.lit("git"))
    rest = F.when(at > 0, F.slice(tokens, (at + 1).cast("int"), F.size(tokens)))
    reads = F.arrays_overlap(rest, F.array(*map(F.lit, ("-l", "--list", "--get", "-get", "--get-all", "--get-regexp"))))
    return F.coalesce((F.get(rest, F.lit(0)) == "config") & ~reads, F.lit(False))


def environment_poisoning(command: Column) -> Column:
    """The variable by which a command changes what later ones run; null if none."""
    upper = F.upper(command)
    named = F.coalesce(*[F.when(F.contains(upper, F.lit(f"{v}=")), F.lit(v)) for v in POISON_VARIABLES])
    return F.coalesce(named, F.when(upper.rlike("DYLD_|LD_|GIT_CONFIG_"), F.lit("loader")), F.when(F.contains(command, F.lit("PATH=")) | command.rlike(r"(?:^|\s)[;&|]*path="), F.lit("PATH")))


def container_access(command: Column) -> Column:
    """Whether a command reaches a container daemon or acts through one."""
    lower, tokens = F.lower(command), shell_tokens(command)
    acts = F.arrays_overlap(tokens, F.array(*map(F.lit, CONTAINER_ACTIONS))) | lower.rlike("--privileged|--network=host|--pid=host")
    program = _program(F.get(tokens, F.lit(0))).isin(*CONTAINER_PROGRAMS)
    return lower.rlike(r"docker\.sock|podman\.sock|containerd\.sock|unix://") | F.coalesce(program & acts, F.lit(False))


def mask_url_user(text: Column) -> Column:
    return F.regexp_replace(text, r"([A-Za-z][A-Za-z0-9+.-]*://)[^/\s:@]+:[^/\s@]*@", "$1***@")


def mask_arguments(arguments: Column) -> Column:
    """Arguments with the values of flags and assignments of secret names as ***; `--token x` hides the next one."""
    names = "|".join(SECRET_ARGUMENTS)
    flag = rf"(?i)^-{{1,2}}[^=\s]*(?:{names})[^=\s]*$"
    assigned = rf"(?i)^(-{{0,2}}[^=\s]*(?:{names})[^=\s]*)=.*$"
    hidden = lambda a, i: F.when((i > 0) & F.get(arguments, i - 1).rlike(flag), F.lit("***")).when(a.rlike(assigned), F.regexp_replace(a, assigned, "$1=***")).otherwise(mask_url_user(a))
    return F.transform(arguments, hidden)


def repository_url(raw: Column, hosts: tuple[str, ...] = REPOSITORY_HOSTS) -> Column:
    """https://host/owner/name of a repository's address; null if it is of another scheme, host or shape."""
    t = F.regexp_replace(raw, r"^\s+|\s+$", "")
    t = F.when(F.contains(t, F.lit("://")), t).when(t.startswith("git@github.com:"), F.concat(F.lit("https://github.com/"), F.regexp_replace(t, r"^git@github\.com:", ""))).otherwise(F.concat(F.lit("https://"), t))
    parts = r"^(?i:https)://(?:[^/?#@]*@)?([^/?#:@]+)(:[0-9]*)?(/[^?#]*)?(?:[?#].*)?$"
    host, port, path = (F.regexp_extract(t, parts, i) for i in (1, 2, 3))
    host = F.lower(host)
    names = F.filter(F.split(F.regexp_replace(F.regexp_replace(path, r"\.git$", ""), r"^/+|/+$", ""), "/"), lambda s: s != "")
    good = host.isin(*hosts) & (port == "") & (F.size(names) == 2) & ~F.exists(names, lambda s: s.isin(".", "..")) & ~t.rlike(r"\s")
    return F.when(good, F.concat(F.lit("https://"), host, F.lit("/"), names[0], F.lit("/"), names[1]))


def trimmed_text(text: Column, limit: int = 500_000) -> Column:
    """struct<text, truncated>: white space trimmed, then cut at `limit` characters."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.struct(F.left(t, F.lit(limit)).alias("text"), (F.length(t) > limit).alias("truncated"))


def decoded_text(content: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def likely_text(content: Column) -> Column:
    """Whether the first 8192 bytes have no NUL and are UTF-8, or at least 85 % printable."""
    head = F.substring(content, 1, 8192)
    latin = F.decode(head, "ISO-8859-1")
    printable = F.length(F.regexp_replace(latin, r"[^\t\n\r\x20-\x7E\xA0-\xFF]", ""))
    whole = F.regexp_replace(F.hex(head), "(?:F[0-7](?:[89AB][0-9A-F]){0,2}|E[0-9A-F](?:[89AB][0-9A-F])?|[CD][0-9A-F])$", "")
    utf8 = F.is_valid_utf8(F.unhex(whole).cast("string"))
    return ~F.contains(latin, F.lit("\x00")) & (utf8 | (printable * 100 >= F.length(latin) * 85))


def iso_time(epoch_seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch_seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ruleset_hash(parts: list[str]) -> str:
    """The djb2 hash of a rule set as hex: a constant, so it is no column."""
    h = 5381
    for byte in "\n".join(parts).encode():
        h = (h * 33 + byte) % 2**64
    return f"{h:x}"
