"""Entities from models: token windows, label decoding, tokenizers, and answers in JSON."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Entity type of a model's label.
LABELS = {
    "PERSON": "personName", "PER": "personName", "GIVENNAME": "personName", "SURNAME": "personName", "TITLE": "personName", "NAME": "personName",
    "ORG": "customCompany", "ORGANIZATION": "customCompany", "EMAIL": "email", "TELEPHONENUM": "phone", "PHONE": "phone",
    "CREDITCARDNUMBER": "creditCardLike", "CITY": "streetAddress", "STREET": "streetAddress", "ADDRESS": "streetAddress", "LOCATION": "streetAddress",
    "LOC": "streetAddress", "SOCIALNUM": "governmentId", "PASSPORTNUM": "governmentId", "SSN": "governmentId", "MISC": "customSensitiveTerm",
}
#: Further labels of a language model's answers.
ANSWER_LABELS = LABELS | {"COMPANY": "customCompany", "CREDIT_CARD": "creditCardLike", "CARD": "creditCardLike", "SENSITIVE_TERM": "customSensitiveTerm"}
LEAST_CONFIDENCE = 0.5


def chunks(df: DataFrame, id_col: str, text_col: str, size: int = 4000, overlap: int = 200) -> DataFrame:
    """(doc_id, n, start, chunk): texts in overlapping pieces of `size` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text_col) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return df.select(F.col(id_col).alias("doc_id"), F.posexplode(starts).alias("n", "start"), F.col(text_col).alias("whole")).select("doc_id", "n", "start", F.col("whole").substr(F.col("start") + 1, F.lit(size)).alias("chunk"))


def token_windows(df: DataFrame, id_col: str, tokens_col: str, size: int = 512, overlap: int = 128, first: int | None = None, last: int | None = None) -> DataFrame:
    """(doc_id, n, start, tokens): token arrays in overlapping windows that hold `size` tokens with their first and last mark."""
    room = size - (first is not None) - (last is not None)
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens_col) - overlap - 1, F.lit(0)), F.lit(room - overlap))
    # cut before they are dealt out, so that a window's row holds its own tokens only
    windows = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(tokens_col, s + 1, F.lit(room)).alias("window")))
    rows = df.select(F.col(id_col).alias("doc_id"), F.posexplode(windows).alias("n", "w"))
    parts = [F.array(F.lit(first))] * (first is not None) + [F.col("w.window")] + [F.array(F.lit(last))] * (last is not None)
    return rows.select("doc_id", "n", "w.start", F.concat(*parts).alias("tokens"))


def best_label(logits: Column) -> Column:
    """struct<label (from 0), confidence>: the first largest logit and its softmax."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp((x - top).cast("double")))
    return F.struct((F.array_position(logits, top) - 1).cast("int").alias("label"), (1.0 / total).alias("confidence"))


def _entity(label: Column) -> Column:
    plain = F.trim(label)
    return F.when(~plain.isin("", "O", "0"), F.regexp_replace(plain, "^(?:[BI][-_]|[ES]-)", ""))


def decode_labels(tokens: DataFrame, text: DataFrame | None = None) -> DataFrame:
    """Spans (doc, start, end, label, confidence) from tokens (doc, pos, start, end, label, confidence).

    A token goes on with the span before it if its label is inside (I or E), names the same entity, and that
    span was not closed (E or S); O ends a span. A span's confidence is its weakest token's. All conditions look one
    token back, so spans are islands of a window.
    """
    order = Window.partitionBy("doc").orderBy("pos")
    rows = tokens.withColumn("entity", _entity(F.col("label"))).withColumn("plain", F.trim("label"))
    goes_on = F.col("plain").rlike("^(?:I[-_]|E-)") & (F.lag("entity").over(order) == F.col("entity")) & ~F.lag("plain").over(order).rlike("^[ES]-")
    rows = rows.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("span", F.sum("new").over(order))
    spans = rows.filter("entity is not null").groupBy("doc", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("entity").alias("label"), F.min("confidence").alias("confidence"))
    return spans.filter("end > start").drop("span")


def inherit_words(tokens: DataFrame) -> DataFrame:
    """Tokens (doc, pos, label, is_continuation, is_special) with the label of a word's first token on its later ones;
    special tokens end words and are left out."""
    order = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("is_special"), F.struct(F.lit(None).cast("string").alias("e"))).when(~F.col("is_continuation"), F.struct(_entity(F.col("label")).alias("e")))
    inherited = F.last(head, True).over(order)["e"]
    label = F.when(F.col("is_continuation"), F.coalesce(F.concat(F.lit("I-"), inherited), F.lit("O"))).otherwise(F.col("label"))
    return tokens.withColumn("label", label).filter(~F.col("is_special"))


def decode_entities(tokens: DataFrame, labels: list[str]) -> DataFrame:
    """Entities (doc, start, end, entity_type, confidence) from token logits (doc, pos, start, end, logits, is_continuation, is_special)."""
    best = best_label(F.col("logits"))
    named = tokens.withColumn("best", best).withColumn("label", F.element_at(F.array(*map(F.lit, labels)), F.col("best.label") + 1)).withColumn("confidence", F.col("best.confidence"))
    spans = decode_labels(inherit_words(named).filter("end > start"))
    kind = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[F.upper("label")]
    return spans.filter(F.col("confidence") >= LEAST_CONFIDENCE).withColumn("entity_type", kind).filter("entity_type is not null").select("doc", "start", "end", "entity_type", "confidence")


def _words(text: str) -> list[tuple[str, int]]:
    """Words and single punctuation marks with their places; blanks separate."""
    out: list[tuple[str, int]] = []
    open_word = False
    for i, c in enumerate(text):
        if c.isspace():
            open_word = False
        elif unicodedata.category(c).startswith("P"):
            out.append((c, i))
            open_word = False
        elif open_word:
            out[-1] = (out[-1][0] + c, out[-1][1])
        else:
            out.append((c, i))
            open_word = True
    return out


def longest_pieces(word: str, vocabulary: set[str], mark: str = "##", unknown: str = "[UNK]") -> list[str]:
    """Greedy longest pieces; the whole word is unknown if a part is."""
    out, at = [], 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if (mark if at else "") + word[at:e] in vocabulary), None)
        if end is None:
            return [unknown]
        out.append((mark if at else "") + word[at:end])
        at = end
    return out


def merged_pieces(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Characters merged pair by pair, the lowest rank (then the first) each time."""
    parts = list(word)
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
        if not pairs:
            return parts
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def likeliest_pieces(word: str, scores: dict[str, float], unknown_score: float, unknown: str = "<unk>") -> list[str]:
    """The split with the largest sum of scores; ties to the shorter first piece, unknown characters one by one."""
    longest = max(map(len, scores), default=1)
    best: list[tuple[float, int, bool]] = [(0.0, len(word), False)] * (len(word) + 1)
    for at in range(len(word) - 1, -1, -1):
        choice = (float("-inf"), at + 1, True)
        for end in range(at + 1, min(len(word), at + longest) + 1):
            score = scores.get(word[at:end])
            if score is not None and score + best[end][0] > choice[0]:
                choice = (score + best[end][0], end, False)
        if unknown_score + best[at + 1][0] > choice[0]:
            choice = (unknown_score + best[at + 1][0], at + 1, True)
        best[at] = choice
    out, at = [], 0
    while at < len(word):
        _, end, missing = best[at]
        out.append(unknown if missing else word[at:end])
        at = end
    return out


def tokenize(df: DataFrame, id_col: str, text_col: str, split_word: Callable[[str], list[str]]) -> DataFrame:
    """(doc_id, tokens array<struct<piece, start, is_continuation>>) with one of the splitters above, its tables in the closure."""

    @F.pandas_udf("array<struct<piece: string, start: int, is_continuation: boolean>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"piece": p, "start": at, "is_continuation": n > 0} for w, at in _words(t or "") for n, p in enumerate(split_word(w))])

    return df.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("tokens"))


def answer_entities(df: DataFrame, id_col: str, text_col: str, answer_col: str) -> DataFrame:
    """Spans (doc_id, start, end, entity_type, value) of a model's answer {"entities": [{"type", "text"}]}, each at the first
    place in the text that no earlier one took; confidence 0.7, source ai."""

    @F.pandas_udf("array<struct<start: int, end: int, entity_type: string, value: string>>")
    def locate(texts: pd.Series, answers: pd.Series) -> pd.Series:
        def one(text: str | None, answer: str | None) -> list[dict]:
            answer = (answer or "").strip()
            try:
                items = json.loads(answer[answer.index("{") : answer.rindex("}") + 1])["entities"]
                items = [(str(i["type"]).upper(), i["text"].strip()) for i in items]
            except (ValueError, KeyError, TypeError, AttributeError):
                return []
            taken: list[tuple[int, int]] = []
            out = []
            for kind, value in items:
                kind = ANSWER_LABELS.get(kind)
                at = (text or "").find(value) if kind and value else -1
                while at >= 0 and any(at < e and s < at + len(value) for s, e in taken):
                    at = text.find(value, at + len(value))
                if at >= 0:
                    taken.append((at, at + len(value)))
                    out.append({"start": at, "end": at + len(value), "entity_type": kind, "value": value})
            return out

        return pd.Series([one(t, a) for t, a in zip(texts, answers, strict=True)])

    rows = df.select(F.col(id_col).alias("doc_id"), F.inline(locate(F.col(text_col), F.col(answer_col))))
    return rows.withColumn("confidence", F.lit(0.7)).withColumn("source", F.lit("ai"))
