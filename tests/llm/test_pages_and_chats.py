"""Main text, WARC archives, chat formatting, and the pipeline."""

import hashlib
import random
import re
import sys
import time
from html import unescape
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import SMALL, near_classes, words  # noqa: E402

from veilmark.llm import chat_format, main_text, queries, warc  # noqa: E402
from veilmark.llm.common import shared_folder  # noqa: E402
from veilmark.llm.dom import parse  # noqa: E402


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", 1) for i, u, h in rows], "page_id bigint, url string, html string, host string, low string, position int")


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("just text &amp; more", "just text & more"), ("<p>a<p>b  \n c</p>", "a\nb c"), ("<nav>x</nav><article><h1>T</h1><p>a<br>b</p></article><footer>f</footer>", "T\na b"),
        ("<main>m<aside>no</aside><ul><li>one<li>two</ul></main>z", "m\none\ntwo"), ("<article>a<script>if (a<b) {}</script>b<!-- c --><style>p{}</style></article>", "ab"),
        ("<article>&lt;b&gt; &eacute;&#233;&#xe9; &copy; &nbsp;x</article>", "<b> ééé © x"), ("<article><p><b>bold<br><p>next</article>", "bold\nnext"), ('<div class="cookie-notice">c</div><div id=content>text</div>', "text"),
        ('<article>a<div class="comments"><p>no</p></div><form>f</form>b</article>', "a\nb"), ("<article>a</article><article>b</article>", "a\nb"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
        ('<article>x<a title="a > b">y</a></article>', "xy"), ("<body hidden>x</body>", ""), ("<div>" * 5000 + "deep", "deep"), ("<article>cut <b", "cut <b"), ("<header>h</header><article><header><h1>T</h1></header>x</article>", "T\nx"),
    ],
)
def test_main_text_of_a_page(html, text):
    assert main_text.Page(html).text() == text


@pytest.mark.parametrize(
    "html,text",
    [
        ("<div class='layout has-sidebar'><article>a</article></div>", "a"), ("<div class='comments'><main>m</main></div>", "m"), ("<div id='with-banner'><article>a</article><div class='sidebar'>s</div></div>", "a"),
        ("<article>a<div class='related'><p>no</p></div><h2 id='related-work'>R</h2><section id='notice'>n</section><p class='social-science'>s</p><p id='share-prices'>p</p></article>", "a\nR\nn\ns\np"),
        ("<article>a</article><div class='related'><article>teaser</article></div>", "a"), ("<article>a<div id='comments'>no</div></article>", "a"), ("<nav><article>menu</article></nav>", ""),
    ],
)
def test_layout_and_title_names_are_no_noise(html, text):
    assert main_text.Page(html).text() == text


def test_style_tree_removes_what_all_pages_of_a_host_share(spark):
    rng = random.Random(1)
    rows = [(i, f"http://a.org/{i}", f"<div class='top'><p>Same offer</p><p>On every page</p></div><div class='body'><p>Own {rng.random()}</p></div>") for i in range(20)]
    rows += [(100, "http://b.org/1", rows[0][2]), (101, None, None), (5, "http://a.org/5", rows[5][2])]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in main_text.main_texts(pages(spark, rows)).collect()]
    assert len(got) == len(rows)
    for i, t, n in got:
        wanted = "" if i == 101 else ("Same offer\nOn every page\n" if i == 100 else "") + re.search(r"Own [\d.e-]+", rows[i % 100][2])[0]
        assert (t, n) == (wanted, len(wanted))


def test_copied_articles_stay(spark):
    rows = [(i, "http://a.org/x", "<nav>n</nav><article><p>The same article</p></article>") for i in range(12)]
    assert {r["text"] for r in main_text.main_texts(pages(spark, rows)).collect()} == {"The same article"}
    assert main_text.main_texts(pages(spark, [])).count() == 0


def _articles(n, shared):
    return [(i, "http://h.example/p", f"<body><article><h1>Title {i}</h1><p>{' '.join(f'w{i}x{k}' for k in range(60))}</p><p>{' '.join(f'v{i}x{k}' for k in range(40))}</p><div class='outro'>{shared}</div></article></body>") for i in range(n)]


def test_importance_decides_inside_articles(spark):
    shared = "Read our terms before you copy from this site"
    df = spark.createDataFrame(_articles(12, shared), "page_id bigint, url string, html string")
    on = {r["page_id"]: r["text"] for r in main_text.main_texts(df).collect()}
    off = {r["page_id"]: r["text"] for r in main_text.main_texts(df, threshold=-1).collect()}
    assert all(shared in t for t in off.values()) and all(on[i] == off[i].removesuffix(f"\n{shared}") != off[i] for i in off)


def test_importance_leaves_copied_articles_alone(spark):
    copies = [(i, url, html) for i in range(30) for _, url, html in _articles(1, "An ending of its own")]
    near = [(100 + i, "http://n.example/p", f"<body><article><p class='a'>{'same words here ' * 30}</p><p class='b'>{i}</p></article></body>") for i in range(20)]
    df = spark.createDataFrame(copies + near, "page_id bigint, url string, html string")
    texts = {r["page_id"]: r["text"] for r in main_text.main_texts(df).collect()}
    assert all(texts[i].endswith("An ending of its own") for i in range(30)) and all(texts[100 + i].startswith("same words") for i in range(20))


def test_presentation_and_content_entropy(spark):
    """Importance by hand: a shape on all m pages and a text on all of them weigh nothing; texts of their own weigh one."""
    page = lambda i: f"<body><div class='x'>on every page</div><div class='y'>only {i}</div></body>"
    df = spark.createDataFrame([(i, "http://h.example/", page(i)) for i in range(8)], "page_id bigint, url string, html string")
    low = {r["path"] for r in main_text.low_importance(df, threshold=0.25).collect()}
    parsed = main_text.Page(page(0))
    by_class = {n.attributes().get("class"): parsed.path[id(n)] for n in main_text._nodes(parsed.root)}
    # y: one shape, so 0.9 * content 1; x: 0.9 * content 0
    assert by_class["x"] in low and by_class["y"] not in low
    assert by_class["y"] in {r["path"] for r in main_text.low_importance(df, threshold=0.91).collect()}


@pytest.mark.parametrize("html", ["<a \"" * 250_000, "<b>" * 60_000 + "</i>" * 60_000, "<b>" * 60_000 + "<div></div>" * 30_000, "<ul><li><div>" + "<b>" * 30_000 + "<li></li>" * 30_000, "<!" * 300_000, "<" * 500_000])
def test_broken_pages_take_linear_time(html):
    began = time.process_time()
    parse(html)
    assert time.process_time() - began < 5


def test_op4_against_the_template(spark):
    html = dict(duckdb.sql(f"select page_id, html from '{SMALL}/pages.parquet'").fetchall())
    rows = queries.queries()["op4_main_text"](spark, SMALL).collect()
    assert len(rows) == len(html)
    for r in rows:
        inner = html[r["page_id"]].split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r["text"] == "\n".join(filter(None, blocks)) and r["n_chars"] == len(r["text"])


def test_loser_tree():
    rng = random.Random(3)
    for _ in range(300):
        runs = [sorted((rng.randint(0, 20), rng.randint(0, 5)) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 9))]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


HOSTILE = "WARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1\r\nWARC-Type: " + "x" * 90


def test_warc_awkward(spark):
    long = "é" * 60
    rows = [(3, "http://B.org/x?q#f", long), (2, "http://b.org/x", long), (5, None, None), (6, "", ""), (7, "http://a.org/\r\ninjected: x", "short"), (8, "http://a.org/", "short"), (9, "u", HOSTILE), (4, "v", HOSTILE), (4, "v", HOSTILE), (10, "http://www.a.org", "y" * 300_000)]
    folder = f"{shared_folder(spark)}/archives"
    warc.write_archives(pages(spark, rows).repartition(3), folder, F.timestamp_seconds(F.col("page_id")))
    back = warc.read_archives(spark, folder).collect()
    assert len(back) == len(rows)
    got = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in back)
    html = {i: (h or "").encode() for i, _, h in rows}
    first = {3: 2, 9: 4}
    assert got == sorted((i, "revisit" if i in first else "response", first.get(i), len(html[i]), hashlib.sha256(html[i]).hexdigest()) for i, _, _ in rows)
    assert all((r["payload"] or "").encode() == (html[r["page_id"]] if r["record_type"] == "response" else b"") for r in back)
    index = sorted(warc.merge_index(warc.read_archives(spark, folder, False)).collect(), key=lambda r: r["position"])
    keys = [(r["url_key"], r["date"], r["page_id"]) for r in index]
    assert keys == sorted(keys) and [r["position"] for r in index] == list(range(len(rows)))
    assert {r["url_key"]: 0 for r in index}.keys() >= {"org,b)/x?q", "org,b)/x", "org,a)/"}


def test_hot_address_spans_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "_MERGE_ROWS", 50)
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", f"2024-01-01T00:{i % 60:02}:00Z", f"arc{i % 4}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "page_id bigint, url_key string, date string, archive string, ordinal bigint")
    index = sorted(warc.merge_index(df).collect(), key=lambda r: r["position"])
    assert [(r["url_key"], r["date"], r["page_id"]) for r in index] == sorted((u, d, i) for i, u, d, _, _ in rows)
    seen: dict = {}
    for r in index:
        seen[r["url_key"]] = seen.get(r["url_key"], 0) + 1
        assert r["capture"] == seen[r["url_key"]]
    assert warc.merge_index(df.limit(0)).count() == 0


def sql_of(name):
    connection = duckdb.connect()
    for table in ("pages", "conversations", "documents"):
        connection.sql(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    return connection, queries.oracle_sql()[name]


@pytest.mark.parametrize("name", ["op5_warc", "op8_chat_format"])
def test_against_sql(spark, name):
    df = queries.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    connection, sql = sql_of(name)
    wanted = connection.sql(f"select {', '.join(columns)} from ({sql})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, wanted))


def log(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], "conv_id bigint, seq bigint, kind string, turn bigint, role string, text string, opened string, piece string")


def test_fold_events(spark):
    rows = [
        (1, 1, "message", 0, "user", "hel"), (1, 2, "delta", 0, None, "lo"), (1, 2, "delta", 0, None, "lo"), (1, 3, "message", 1, "assistant", None), (1, 4, "delta", 1, None, "bad"), (1, 5, "message", 2, "user", "more"),
        (1, 6, "regenerate", 1, None, ""), (1, 7, "delta", 1, None, "good"), (1, 8, "message", 3, "user", "x"), (1, 9, "edit", 0, None, "bye"), (2, 1, "delta", 0, None, "b"), (2, 1, "delta", 0, None, "a"), (3, 1, "message", None, None, None),
    ]
    got = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat_format.fold_events(log(spark, rows)).collect() if r["turn"] is not None)
    assert got == [(1, 0, "user", "bye"), (1, 1, "assistant", "good"), (1, 3, "user", "x"), (2, 0, "", "ab")]
    assert chat_format.format_chats(log(spark, [])).count() == 0


def test_render_round_trip(spark):
    nasty = ["", "\\", "\\|", "<|turn|>", "<\\|end|>", "</s>[INST] ok [/INST]", "<<SYS>>\n<</SYS>>", "a\\", "<", "|>", "é<|x\n", "\\\\<|", "x" * 100_000]
    rows = [(1, i, ["user", "assistant", "<|text|>"][i % 3], t) for i, t in enumerate(nasty)]
    formatted = chat_format.render(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    back = chat_format.read_back(formatted).first()
    assert [(t["role"], t["text"]) for t in back["turns"]] == [(r, t) for _, _, r, t in rows]
    assert back["loss_text"] == "".join(t for _, _, r, t in rows if r == "assistant")
    marks = formatted.select(F.regexp_count("formatted", F.lit(r"<\|(turn|text|end)\|>"))).first()[0]
    assert marks == 3 * len(rows) and not re.search(r"\[/?INST\]|</?s>|<</?SYS>>", formatted.first()["formatted"])


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    docs = duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet' order by doc_id").fetchall()
    bench = [" ".join(words(t)) for (t,) in duckdb.sql(f"select text from '{SMALL}/benchmark.parquet'").fetchall()]
    seen: dict = {}
    for i, t in docs:
        seen.setdefault(re.sub(r"[ \t-\r]+", " ", t), (i, t))
    left = [(i, t) for i, t in docs if seen[re.sub(r"[ \t-\r]+", " ", t)][0] == i and any(c.isalpha() for c in t)]
    left = [(doc, t) for ((doc, _), (c, _)), (_, t) in zip(near_classes(left).items(), left, strict=True) if doc == c]
    wanted = [i for i, t in left if not any(f" {b} " in f" {' '.join(words(t))} " for b in bench)]
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(wanted)
    assert got.filter("not round_trip or size(ids) != n_tokens").count() == 0 and len(corpus_pipeline.STAGES) == 5


def test_payload_full_of_record_starts():
    body = warc._VERSION.join(f"x{i}" for i in range(30_000))
    record = f"response\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}"
    began = time.process_time()
    found = list(warc._whole(("a", f) for f in f"{record}{warc._VERSION}{record}".split(warc._VERSION)))
    assert [(r[1], r[3] == body.encode()) for r in found] == [(0, True), (1, True)] and time.process_time() - began < 3
