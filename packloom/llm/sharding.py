"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packloom.llm.common import written

#: Each shard's slots are numbered in so many independent pieces, so that no shard is sorted by one task.
PIECES = 1024


def _score(key: Column, shard: Column, weight: Column) -> Column:
    """Smaller is better. u is a number in (0, 1) fixed by key and shard; -ln(u)/weight is least for a shard in proportion to its weight."""
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.log(u) / weight


def rendezvous(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown_weight: float = 1.0) -> DataFrame:
    """Put every row into the shard with the best score for its key, and say where it goes with one more shard.

    Key and shard alone fix a score, so a new shard can only take rows from others. Slots are 0, 1, ... without gaps in
    each shard. Texts are read once, and only key, size and checksum are kept and shuffled; of a key that many rows have,
    unlike texts are numbered by many tasks.

    Null text: no bytes, checksum 0. Null key: a key of its own, like any other. Rows that repeat a key go to one shard
    and get slots of their own. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    n = len(weights)
    shards = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    k = F.col("doc_id")
    body = F.coalesce(F.encode(docs[text], "UTF-8"), F.lit(b""))
    rows = docs.select(docs[key].alias("doc_id"), (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body).alias("text_crc32"))
    best = F.array_min(F.transform(shards, lambda s: F.struct(_score(k, s["id"], s["w"]).alias("score"), s["id"].alias("id"))))
    rows = rows.withColumn("best", best).withColumn("shard", F.col("best.id"))
    grown = F.when(_score(k, F.lit(n), F.lit(float(grown_weight))) < F.col("best.score"), n).otherwise(F.col("shard"))
    piece = F.pmod(F.xxhash64(k, "text_crc32", "size", F.lit("piece")), F.lit(PIECES)).cast("int")
    rows = written(rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", piece.alias("piece"), grown.cast("int").alias("grown_shard")), "shards")
    counts = rows.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # at most shards * PIECES rows
    own = Window.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("nth", F.row_number().over(own)).join(starts, ["shard", "piece"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard"
    )
