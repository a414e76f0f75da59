"""Masked texts restored with the mapping that held at their time, found by an index of placeholders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilmark.operators.rewrite import restore
from veilmark.streaming.ordered import OrderedFold, _micros, _time, fold_batch

PLACEHOLDER = r"\{\{[A-Z][A-Z0-9_]*_[0-9]+\}\}"
#: A placeholder's mappings are dealt out over this many parts, as some (the first address of a text) are in nearly all.
SALT = 16


class _Newest(OrderedFold):
    """Mappings that come and expire, to the points from which another one is the newest live one (null: none).

    State: live mappings (id, expiry), newest last; one that expires no later than a newer one is never the answer
    again and goes, so each is put in and taken out once.
    """

    reads, gives = ("mapping_id", "expires_at"), "at timestamp, mapping_id string"

    def due(self, state):
        return state[-1][1]

    def advance(self, state, now):
        out = []
        while state and state[-1][1] is not None and state[-1][1] <= now:
            at = state[-1][1]
            state = state[:-1]
            out.append((_time(at), state[-1][0] if state else None))
        return state or None, out

    def step(self, state, now, event):
        state, out = self.advance(state, now)
        mapping_id, expires = event
        end = _micros(expires) if expires is not None else None
        if end is not None and end <= now:
            return state, out
        state = [m for m in state or [] if end is not None and (m[1] is None or m[1] > end)] + [[mapping_id, end]]
        return state, [*out, (_time(now), mapping_id)]


def placeholders_of(text):
    """The different placeholders of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))))


def holding(needs: DataFrame, mappings: DataFrame) -> DataFrame:
    """(needs, mapping_id, created_at, expires_at): the mappings that hold all placeholders of each array `needs`.

    Mappings are found by the rarest placeholder of an array and then hold the rest or don't, so a placeholder that
    nearly all of them have is followed only where nothing else is asked for, and then over SALT tasks.
    """
    held = mappings.select("mapping_id", "created_at", "expires_at", F.map_keys("mapping").alias("keys")).filter("mapping_id is not null and created_at is not null")
    index = held.select("mapping_id", "created_at", "expires_at", "keys", F.explode("keys").alias("placeholder"), F.pmod(F.xxhash64("mapping_id"), F.lit(SALT)).alias("salt"))
    often = index.groupBy("placeholder").agg(F.count("*").alias("often"))
    wanted = needs.select("needs", F.explode("needs").alias("placeholder")).join(often, "placeholder", "left")
    rarest = wanted.groupBy("needs").agg(F.min(F.struct(F.coalesce("often", F.lit(0)), "placeholder")).alias("r")).select("needs", F.col("r.placeholder").alias("placeholder"))
    rarest = rarest.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
    met = rarest.join(index, ["placeholder", "salt"]).filter(F.size(F.array_except("needs", "keys")) == 0)
    return met.select("needs", "mapping_id", "created_at", "expires_at")


def restore_as_of(texts: DataFrame, mappings: DataFrame, time: str = "ts", text_col: str = "text", bucket_seconds: int = 3600) -> DataFrame:
    """`texts` with their text restored by the newest mapping that was live at their time and holds all their placeholders, and its `mapping_id`.

    Mappings are (mapping_id string, created_at, expires_at or null, mapping map<placeholder, value>): live from
    created_at until before expires_at; of two of one time the larger id is the newer. Texts without placeholders,
    without a time, or with placeholders that no live mapping holds together stay as they are, with mapping_id null.

    Texts with equal placeholders share one history of newest mappings. It is joined as of their time in buckets of
    `bucket_seconds`, each of which begins with what held before it, so a hot set of placeholders spreads over many
    tasks. The columns needs, bucket, at and mapping_id must not be among those of `texts`.
    """
    rows = texts.withColumn("needs", F.when(F.col(time).isNotNull(), placeholders_of(F.col(text_col))))
    rows = rows.withColumn("needs", F.coalesce("needs", F.array().cast("array<string>")))
    plain, masked = rows.filter(F.size("needs") == 0), rows.filter(F.size("needs") > 0)
    found = holding(masked.select("needs").distinct(), mappings)
    keyed = found.select(F.to_json("needs").alias("set_of"), F.col("created_at").alias("ts"), F.col("mapping_id").cast("string"), "expires_at")
    points = fold_batch(keyed, _Newest(), "set_of", to_end=True)

    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / bucket_seconds)
    points = points.withColumn("bucket", bucket("at")).withColumn("seq", F.monotonically_increasing_id())
    newest = points.groupBy("set_of", "bucket").agg(F.max_by(F.struct("mapping_id"), F.struct("at", "seq")).alias("last"))
    masked = masked.withColumns({"set_of": F.to_json("needs"), "bucket": bucket(time)})
    asked = masked.select("set_of", "bucket").distinct().withColumn("last", F.lit(None).cast("struct<mapping_id: string>")).withColumn("asked", F.lit(True))
    by_bucket = newest.withColumn("asked", F.lit(False)).unionByName(asked).groupBy("set_of", "bucket").agg(F.max("last").alias("last"), F.bool_or("asked").alias("asked"))
    before = Window.partitionBy("set_of").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_bucket.select("set_of", "bucket", "asked", F.last("last", ignorenulls=True).over(before).alias("m")).filter("asked and m is not null")
    first = F.timestamp_seconds(F.col("bucket") * bucket_seconds)
    marks = points.select("set_of", "bucket", F.col("at").alias("mark"), F.struct("mapping_id").alias("m"), F.col("seq")).unionByName(carried.select("set_of", "bucket", first.alias("mark"), "m", F.lit(-1).cast("bigint").alias("seq")))
    marks = marks.join(masked.select("set_of", "bucket").distinct(), ["set_of", "bucket"], "left_semi")
    line = masked.withColumn("mark", F.col(time).cast("timestamp")).withColumn("seq", F.lit((1 << 63) - 1)).unionByName(marks.withColumn("is_mark", F.lit(True)), allowMissingColumns=True)
    as_of = Window.partitionBy("set_of", "bucket").orderBy("mark", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = line.withColumn("held", F.last("m", ignorenulls=True).over(as_of)).filter("is_mark is null")
    chosen = chosen.select(*texts.columns, F.col("held.mapping_id").alias("mapping_id"))
    values = mappings.select(F.col("mapping_id").cast("string").alias("mapping_id"), F.col("mapping").alias("held_values"))
    done = chosen.join(values, "mapping_id", "left")
    text = F.when(F.col("held_values").isNotNull(), restore(F.col(text_col), F.col("held_values"))).otherwise(F.col(text_col))
    done = done.select(*[text.alias(c) if c == text_col else F.col(c) for c in texts.columns], "mapping_id")
    return done.unionByName(plain.select(*texts.columns, F.lit(None).cast("string").alias("mapping_id")))
