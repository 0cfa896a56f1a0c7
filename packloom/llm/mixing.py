"""Mixing sources to target weights along a curriculum, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packloom.llm.common import WORD, written

#: Hex digits of the hash that cut a source into pieces whose running sums are made apart: 16 ** 3 pieces a source.
PIECE_DIGITS = 3
#: Weights by the source's rank, repeating, and how far each weight leans to the end (> 0) or start (< 0) of training.
WEIGHTS, LEANS = (1, 2, 3), (0.5, 0.0, -0.5)
MOST = 3


def plan_mixture(docs: DataFrame, weights=WEIGHTS, leans=LEANS, most: int = MOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its size, its source's size and target, its copies in the mix and their positions in training.

    A source's weight at time t in [0, 1] is w * (1 + lean * (2 t - 1)), whose integral over the whole training is w.
    Targets share the size of all sources by w; none is above `most` times its source's size, the excess going to the
    others by weight (water filling, solved in closed form over the sources by the order in which they fill up). Within
    a source, documents stand in the order of md5(doc_id). With c the words of the source up to the middle of a document,
    its copy e stands at demand e * source_size + c, and is taken if that is at most the target; the demand of the source
    up to time t is target * (t + lean * (t * t - t)), and its inverse is the copy's position.

    Null text or no word: size 0; such a document is taken (adding nothing) like its neighbours. Null sources are one
    source, the last. Rows that repeat a doc_id are documents of their own; ties are broken by size. An empty table gives
    no rows. Only the columns doc_id, source, text and those in `keep` are read; these come back in the struct `kept`.
    """
    digest = F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit("")))
    # One key that is never null for source and piece, so that the join with the starts and the running sum share one shuffle of the rows.
    piece = F.concat(F.substring(digest, 1, PIECE_DIGITS), F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit("")))
    rows = docs.select(
        docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        digest.alias("key"), piece.alias("piece"), *([F.struct(*[docs[c] for c in keep]).alias("kept")] if keep else []),
    )
    pieces = written(rows.groupBy("source", "piece").agg(F.sum("size").alias("words")), "mix-pieces")
    before = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("source", "piece", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))

    n = len(weights)
    ranked = pieces.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), (F.col("rank") % n + 1).cast("int"))
    ranked = ranked.withColumn("weight", pick([int(w) for w in weights]).cast("long")).withColumn("lean", pick([float(x) for x in leans]))
    everything = Window.partitionBy()
    fills = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("rank").asc())
    earlier = fills.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    ranked = ranked.withColumn("spent", F.coalesce(F.sum(F.col("source_size") * most).over(earlier), F.lit(0))).withColumn("used", F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    # The first source, in the order of filling up, whose share stays within its cap sets the level for itself and all later ones.
    level = (F.col("all_size") - F.col("spent")).cast("double") / (F.col("all_weight") - F.col("used")).cast("double")
    fits = level * F.col("weight") <= F.col("source_size") * most
    ranked = ranked.withColumn("level", F.when(fits, level)).withColumn("level", F.first("level", ignorenulls=True).over(fills.rowsBetween(Window.unboundedPreceding, 0)))
    cap = (F.col("source_size") * most).cast("double")
    sources = ranked.select(F.col("source").alias("of"), "source_size", "lean", F.coalesce(F.least(cap, F.col("level") * F.col("weight")), cap).alias("target"))

    # What is known of a piece is found on the pieces, of which there are at most 16 ** 3 a source.
    starts = starts.join(sources, starts["source"].eqNullSafe(sources["of"])).drop("source", "of")
    own = Window.partitionBy("piece").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(starts, "piece").withColumn("middle", F.col("start") + F.sum("size").over(own) - F.col("size") / 2.0)
    copies = F.least(F.lit(most), F.greatest(F.lit(0), F.floor((F.col("target") - F.col("middle")) / F.col("source_size")) + 1))
    placed = placed.withColumn("copies", F.when(F.col("source_size") > 0, copies).otherwise(F.when(F.col("target") >= F.col("middle"), 1).otherwise(0)).cast("int"))
    share = lambda e: F.when(F.col("target") > 0, (e * F.col("source_size") + F.col("middle")) / F.col("target")).otherwise(0.0)
    rest = 1 - F.col("lean")
    when = lambda y: 2 * y / (rest + F.sqrt(rest * rest + 4 * F.col("lean") * y))
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda e: when(share(e)))).otherwise(F.array().cast("array<double>"))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", positions.alias("positions"), *(["kept"] if keep else []))


def in_order(plan: DataFrame) -> DataFrame:
    """The documents of the plan range-sorted by their first position; those left out come last."""
    return plan.orderBy(F.asc_nulls_last(F.try_element_at("positions", F.lit(1))), "doc_id")


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, range-sorted by position; the columns are those of docs.

    Every column of docs must have a name of its own. Nulls, empty tables and ties are as in plan_mixture().
    """
    plan = plan_mixture(docs, keep=tuple(docs.columns), **options)
    return plan.select(F.explode("positions").alias("position"), "kept").orderBy("position", "kept.doc_id").select("kept.*")
