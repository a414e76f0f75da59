"""Exclude templates and their merge into lists, against plain lists."""

import random

from veilmark.functions.template_tables import ALIASES, TEMPLATES
from veilmark.operators import templates


def by_hand(raws):
    out, unknown = ["common"], []
    for raw in raws:
        for part in (raw or "").split(","):
            key = part.strip().lower()
            name = key if key in TEMPLATES else ALIASES.get(key)
            if key and name is None and key not in unknown:
                unknown.append(key)
            elif key and name and name not in out:
                out.append(name)
    return out, unknown


def test_templates_and_merge(spark):
    rng = random.Random(1)
    pool = ["node", "JS", " ts", "Swift", "ios", "python,Go", "rust, java,android", "", ",", None, "common", "cobol", "Cobol,x", "tuist,ruby"]
    choices = {f"r{i}": [rng.choice(pool) for _ in range(rng.randrange(1, 4))] for i in range(30)}
    lists = {f"r{i}": [rng.choice(["*.lock", "own/**", "**/venv/**", "own/**", "*.jar", "z"]) for _ in range(rng.randrange(6))] for i in range(25)} | {"other": ["a", "a"]}
    asked = spark.createDataFrame([(r, n, raw) for r, raws in choices.items() for n, raw in enumerate(raws)], "repo string, n int, raw string")
    rows = templates.chosen_templates(asked.repartition(3)).collect()
    for repo, raws in choices.items():
        mine = sorted((r for r in rows if r["repo"] == repo), key=lambda r: r["place"])
        known, unknown = by_hand(raws)
        assert [r["template"] for r in mine if r["template"]] == known
        assert sorted(r["name"].lower() for r in mine if not r["template"]) == sorted(unknown)
    own = spark.createDataFrame([(r, n, p) for r, ps in lists.items() for n, p in enumerate(ps)], "repo string, n int, pattern string")
    merged = {}
    for r in templates.merge_excludes(own, templates.template_patterns(asked)).orderBy("repo", "n").collect():
        merged.setdefault(r["repo"], []).append((r["pattern"], r["added"]))
    for repo in {*choices, *lists}:
        wanted = [(p, False) for p in lists.get(repo, [])]
        for t in by_hand(choices[repo])[0] if repo in choices else []:
            for p in TEMPLATES[t]:
                if p not in [w for w, _ in wanted]:
                    wanted.append((p, True))
        assert merged.get(repo, []) == wanted


def test_empty(spark):
    none = spark.createDataFrame([], "repo string, n int, raw string")
    assert templates.template_patterns(none).count() == 0
    assert templates.merge_excludes(none.withColumnRenamed("raw", "pattern"), templates.template_patterns(none)).count() == 0
