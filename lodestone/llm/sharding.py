"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows get a seeded hash; within each source the rows are ranked by it, and the fractional rank
(2 * rank - 1) / (2 * rows of the source) spreads each source evenly over [0, 1). All rows are put in the order
of that fraction and cut into shards of equal counts, so that each shard, and each run of slots in it, has the
mixture of the whole table.

Ranks come from counts by hash range, and these from counts of `WIDE` ranges together: no window holds more than one small range
of one source, or the counts of `WIDE` ranges, or one count for some two million rows, however large the source. The law that holds is
`rows`: counts of shards differ by one at most.

Nulls: a null source is a source of its own; a null text has size 16 and crc32 0; rows without an id take their hash from the
text. Rows that repeat an id, or have neither id nor text, share one hash and are ranked by what else differs, in one range. Rows that are
equal in every column are interchangeable. An empty table gives no rows. Other columns are ignored.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

ROWS_IN_RANGE, WIDE = 2000, 1024


def _offsets(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows before each range, and rows in all, by group; counts of WIDE ranges are summed first."""
    counts = counts.withColumn("wide", F.floor(F.col(order) / WIDE))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sofar = lambda w, x: F.coalesce(F.sum("n").over(w.orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wide = counts.groupBy(*by, "wide").agg(F.sum("n").alias("n")).select(*by, "wide", sofar(w, "wide").alias("ahead"), F.sum("n").over(w).alias("total"))
    within = counts.select(*by, "wide", order, sofar(Window.partitionBy(*by, "wide"), order).alias("inside"))
    return within.join(wide, [*by, "wide"]).select(*by, order, (F.col("ahead") + F.col("inside")).alias("before"), "total")


def interleave(docs: DataFrame, shards: int, seed: int = 17, strata: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), and position in the whole order."""
    rows = docs.count()
    bits = max(8, math.ceil(math.log2(max(1, rows / ROWS_IN_RANGE))))
    ranges = 1 << bits
    key = docs.select(
        "doc_id", "text",
        F.when(F.col(strata).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(strata).cast("string"))).alias("stratum"),
        F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "text")).otherwise(F.xxhash64(F.lit(seed), "doc_id")).alias("h"),
    ).withColumn("part", F.shiftrightunsigned("h", 64 - bits))
    before = _offsets(key.groupBy("stratum", "part").agg(F.count("*").alias("n")), ["stratum"], "part")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = key.select("doc_id", "stratum", "h", "part", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    local = F.row_number().over(Window.partitionBy("stratum", "part").orderBy("h", "doc_id", "text_crc32", "size"))
    ranked = (
        sized.withColumn("local", local)
        .join(before, ["stratum", "part"])
        .withColumn("share", (2 * (F.col("before") + F.col("local")) - 1) / (2 * F.col("total")))
        .select("doc_id", "size", "text_crc32", "stratum", "h", "share", F.least(F.floor(F.col("share") * ranges), F.lit(ranges - 1)).alias("slice"))
    )
    ranked = stored(ranked, "shard-ranks")
    ahead = _offsets(ranked.groupBy("slice").agg(F.count("*").alias("n")), [], "slice")
    place = F.row_number().over(Window.partitionBy("slice").orderBy("share", F.xxhash64("stratum"), "stratum", "h", "doc_id", "text_crc32", "size"))
    at = ranked.withColumn("local", place).join(ahead, "slice").withColumn("position", F.col("before") + F.col("local") - 1)
    shard = F.expr(f"position * {shards} div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return at.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("position") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "position",
    )
