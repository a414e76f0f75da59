"""Row numbers over tables of any size: a range sort, and where each range starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilmark.llm.common import written

#: Starts of ranges up to this number are broadcast (some 50 bytes each); more are joined by a shuffle.
BROADCAST_STARTS = 100_000


def numbered(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """`df` with `at`, a row's place from 0 in its group by `order`, and `group_rows`, the rows of its group.

    Rows are dealt out by ranges of (group, order), so a group that holds a third of all rows spans many tasks; the
    only window runs over one row for each range and group. `order` should end in a column without repeats: rows
    that tie in all of it can't be split. Null groups are one group. `df` is read twice (the ranges are sampled), so
    it should be a written table; the sorted rows are written, as two sorts of tied rows need not agree.
    """
    keys = [F.col(c).asc_nulls_first() for c in group] + order
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = written(ranged.withColumn("range_no", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()))
    starts = rows.groupBy(*group, "range_no").agg(F.count("*").alias("in_range"), F.min("seq").alias("first_seq"))
    before = Window.partitionBy(*group).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumns({
        "before": F.coalesce(F.sum("in_range").over(before), F.lit(0)),
        "group_rows": F.sum("in_range").over(Window.partitionBy(*group)),
    })
    starts = written(starts.drop("in_range").withColumnsRenamed({c: f"start_{c}" for c in [*group, "range_no"]}))
    side = F.broadcast(starts) if starts.count() <= BROADCAST_STARTS else starts
    on = rows["range_no"] == side["start_range_no"]
    for c in group:
        on &= rows[c].eqNullSafe(side[f"start_{c}"])
    return rows.join(side, on).select(*[rows[c] for c in df.columns], (F.col("before") + F.col("seq") - F.col("first_seq")).alias("at"), "group_rows")
