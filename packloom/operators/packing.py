"""Cleaning, the size budget, and the packed document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packloom.functions import text as X
from packloom.functions import udfs
from packloom.operators.tracing import cut

# Fixed values
HEADER = "# Codebase Context\n\n"
TRAILER = "\n*Output truncated: reached configured output size limit.*\n"
DEFAULT_MAX_MB, LARGE_TOKENS = 100, 100_000
#: A document of more bytes is not made as one row.
MAX_ROW_BYTES = 1 << 30
#: Files of one piece of the running sum; a piece is summed by one task.
PIECE = 100_000


def process(files: DataFrame, minify: bool = False) -> DataFrame:
    """Redact, then, with minify, strip comments (of known languages) and blank space."""
    out = X.redact_secrets(F.col("text"))
    return files.withColumn("processed", X.minify(udfs.strip_comments(out, F.col("ext"))) if minify else out)


def sized(files: DataFrame) -> DataFrame:
    """path, seq if there is one, nbytes and block_bytes of processed files, made once: what follows moves these few numbers, not texts."""
    own = ["seq"] if "seq" in files.columns else []
    return cut(files.select("path", *own, F.octet_length("processed").cast("long").alias("nbytes"), F.octet_length(blocks()).cast("long").alias("block_bytes")))


def with_budget(sizes: DataFrame, max_bytes: int = DEFAULT_MAX_MB << 20) -> DataFrame:
    """cum_bytes (the header included) and whether the file is in, in the order of seq, for rows with seq and nbytes.

    Two levels, so that no task orders everything: sums of pieces of seq, then sums inside each piece.
    """
    pieced = sizes.withColumn("_piece", F.floor(F.col("seq") / PIECE))
    pieces = pieced.groupBy("_piece").agg(F.sum("nbytes").alias("_all"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("_piece", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("_piece").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = pieced.join(starts, "_piece").withColumn("cum_bytes", F.col("_start") + F.sum("nbytes").over(own) + len(HEADER))
    return out.withColumn("included", F.col("cum_bytes") <= max_bytes).drop("_piece", "_start")


def blocks() -> Column:
    return X.render_block(F.col("path"), F.col("ext"), F.col("processed"))


def document_blocks(files: DataFrame, budgeted: DataFrame, minify: bool = False) -> DataFrame:
    """seq and block of the files that are in, in order, for a document of any size. files: path, ext and text; only those that are in are processed again."""
    keys = ["path", "seq"] if "seq" in files.columns else ["path"]
    chosen = files.select(*keys, "ext", "text").join(budgeted.where("included").select("path", "seq"), keys)
    return process(chosen, minify).select("seq", blocks().alias("block")).orderBy("seq")


def document(files: DataFrame, budgeted: DataFrame, minify: bool = False) -> DataFrame:
    """One row: the document. More than MAX_ROW_BYTES of it raise an error before any text is gathered; see document_blocks()."""
    size, truncated = budgeted.agg(F.coalesce(F.sum(F.when(F.col("included"), F.col("block_bytes"))), F.lit(0)), F.coalesce(F.bool_or(~F.col("included")), F.lit(False))).first()
    if size > MAX_ROW_BYTES:
        raise ValueError(f"a document of {size} bytes is too large for one row")
    made = document_blocks(files, budgeted, minify).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "block"))), lambda x: x["block"]), "").alias("body"))
    return made.select(F.concat(F.lit(HEADER), "body", F.lit(TRAILER if truncated else "")).alias("document"), F.lit(truncated).alias("truncated"))


def stats(budgeted: DataFrame, skipped: DataFrame) -> DataFrame:
    """files, skipped, output_bytes, tokens, truncated and large_payload, without making the document."""
    cut_off = F.coalesce(F.bool_or(~F.col("included")), F.lit(False))
    size = len(HEADER) + F.coalesce(F.sum(F.when(F.col("included"), F.col("block_bytes"))), F.lit(0)) + F.when(cut_off, len(TRAILER)).otherwise(0)
    made = budgeted.agg(F.count_if("included").alias("files"), size.cast("long").alias("output_bytes"), cut_off.alias("truncated"))
    made = made.withColumn("tokens", F.floor(F.col("output_bytes") / X.BYTES_PER_TOKEN)).withColumn("large_payload", F.col("tokens") > LARGE_TOKENS)
    return made.crossJoin(skipped.agg(F.count(F.lit(1)).alias("skipped"))).select("files", "skipped", "output_bytes", "tokens", "truncated", "large_payload")


def merge_ranges(ranges: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Ranges of each key that overlap or touch, merged."""
    order = Window.partitionBy(key).orderBy(start, end)
    upto = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = ranges.withColumn("_new", F.when(upto.isNull() | (F.col(start) > upto), 1).otherwise(0))
    island = new.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
