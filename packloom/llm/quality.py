"""Quality rules: fixed base rules, and thresholds that adapt to each language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packloom.llm import text as T
from packloom.llm.common import drop, written

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
REPEAT_WORDS, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: The rates that are held against thresholds: numerator and denominator.
RATES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "word_length": ("word_chars", "n_words")}
#: A document is an outlier beyond REACH times the spread between the quartiles, outside of them; the spread counts as LEAST at least.
REACH, LEAST = 6, {"symbols": 0.01, "dup_lines": 0.1, "word_length": 0.5}
#: A sketch's bucket i counts the values from GAMMA ** (i - 1) to GAMMA ** i, so that quantiles are right to ACCURACY of their value.
ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: The bucket of 0, and the lowest and highest of the others, in which all beyond are counted: at most so many buckets a sketch.
ZERO, LOWEST, HIGHEST = -10_000, -1_100, 1_100
#: Smaller groups share the sketch of their language, then of all documents.
MIN_GROUP = 50
#: Up to so many pairs of language and source, their thresholds are broadcast.
MAX_BROADCAST_GROUPS = 50_000


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in T.blocks(batches):
        rows = len(batch)
        starts, ends, first = T.words(data, offsets)
        sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])
        prefix = T.Prefix(data)
        row_of = lambda at: np.searchsorted(offsets, at, "right") - 1

        breaks = np.flatnonzero(data == 10)
        line_starts = np.unique(np.concatenate([breaks + 1, offsets[:-1][offsets[:-1] < offsets[1:]]]))
        line_starts = line_starts[line_starts < len(data)]
        row = row_of(line_starts)
        line_ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, line_starts)], offsets[row + 1])
        has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        row, lines = row[has_word], prefix.of(line_starts[has_word], line_ends[has_word])
        order = np.lexsort((lines, row))
        again = np.zeros(len(lines), bool)
        again[1:] = (lines[order][1:] == lines[order][:-1]) & (row[order][1:] == row[order][:-1])
        n_dup = np.bincount(row[order][again], minlength=rows)

        grams, inside = T.windows(prefix.of(starts, ends), first, REPEAT_WORDS)
        at = np.flatnonzero(inside)
        word_row = np.repeat(np.arange(rows), np.diff(first))
        keys = T.mix(grams[at] + word_row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + REPEAT_WORDS, -1)
        n_repeat = np.bincount(word_row[np.cumsum(cover[:-1]) > 0], minlength=rows)

        found = (np.diff(first), sums(~T.SPACE[data] & ((data & 0xC0) != 0x80)), sums(SYMBOL[data]), n_dup, n_repeat, np.bincount(row, minlength=rows))
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x.astype(np.int64)) for x in found]], names=[*batch.schema.names, *MEASURES])


def measure(df: DataFrame) -> DataFrame:
    """The rows of df with the counts of MEASURES for each whole `text` (null: none of anything); df has no columns of these names."""
    fields = ", ".join(f"`{c}` {t}" for c, t in [*df.dtypes, *[(m, "bigint") for m in MEASURES]])
    return df.mapInArrow(_measure, fields)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _rate(name: str) -> F.Column:
    a, b = RATES[name]
    return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(0.0)


def _bucket(value: F.Column) -> F.Column:
    return F.when(value > 0, F.greatest(F.least(F.ceil(F.log(value) / math.log(GAMMA)), F.lit(HIGHEST)), F.lit(LOWEST))).otherwise(ZERO).cast("int")


def _middle(bucket: F.Column) -> F.Column:
    """The value that stands for a bucket: off by ACCURACY of any value in it at most."""
    return F.when(bucket > ZERO, 2 * F.pow(F.lit(GAMMA), bucket) / (GAMMA + 1)).otherwise(0.0)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): quantile sketches of the rates of the documents that pass the base rules.

    A sketch counts values in buckets whose bounds grow by a fixed ratio, so that each of its quantiles is right to a fixed
    part of its value. Sketches of parts are merged by adding counts, in any order and with the same result, and have a
    bounded number of buckets, however many values they hold.
    """
    rates = F.create_map(*[x for m in RATES for x in (F.lit(m), _bucket(_rate(m)))])
    long = measured.where(~base_failed()).select("lang", "source", F.explode(rates).alias("metric", "bucket"))
    return written(long.groupBy("lang", "source", "metric", "bucket").agg(F.count(F.lit(1)).alias("n")), "quality-sketch")


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, metric, low, high) from the sketches.

    A group with less than MIN_GROUP documents gets the thresholds of its language's merged sketch, or those of all.
    """

    def quartiles(rows: DataFrame, keys: list[str]) -> DataFrame:
        merged = rows.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*keys, "metric")
        ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(group))
        at = lambda q: _middle(F.min(F.when(4 * F.col("upto") >= q * F.col("all"), F.col("bucket"))))
        out = ranked.groupBy(*keys, "metric").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("all").alias("size"))
        least = F.create_map(*[x for m, v in LEAST.items() for x in (F.lit(m), F.lit(v))])[F.col("metric")]
        reach = REACH * F.greatest(F.col("q3") - F.col("q1"), least)
        return out.select(*keys, "metric", "size", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))

    groups = quartiles(sketch, ["lang", "source"])
    langs = quartiles(sketch, ["lang"]).select(F.col("lang").alias("l_lang"), F.col("metric").alias("l_metric"), F.col("size").alias("l_size"), F.col("low").alias("l_low"), F.col("high").alias("l_high"))
    whole = quartiles(sketch, []).select(F.col("metric").alias("w_metric"), F.col("low").alias("w_low"), F.col("high").alias("w_high"))
    joined = groups.join(langs, groups["lang"].eqNullSafe(langs["l_lang"]) & (groups["metric"] == langs["l_metric"])).join(whole, F.col("metric") == F.col("w_metric"))
    pick = lambda x: F.when(F.col("size") >= MIN_GROUP, F.col(x)).when(F.col("l_size") >= MIN_GROUP, F.col(f"l_{x}")).otherwise(F.col(f"w_{x}")).alias(x)
    return joined.select("lang", "source", "metric", pick("low"), pick("high"))


def _held(rows: DataFrame, small: DataFrame) -> DataFrame:
    """rows, measured, with base_failed and kept, by the thresholds of the measures in `small`."""
    sketch = sketches(small)
    limits = thresholds(sketch).groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("low", "high")))).alias("limits"))
    limits = written(limits.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), "limits"), "quality-limits")
    drop(sketch)
    if limits.count() <= MAX_BROADCAST_GROUPS:  # a checked bound: about 200 bytes a group
        limits = F.broadcast(limits)
    rows = rows.join(limits, rows["lang"].eqNullSafe(limits["t_lang"]) & rows["source"].eqNullSafe(limits["t_source"]), "left")
    inside = F.lit(True)
    for m in RATES:
        limit = F.col("limits")[m]
        inside = inside & F.coalesce(_rate(m).between(limit["low"], limit["high"]), F.lit(True))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside).drop("t_lang", "t_source", "limits")


def judged(docs: DataFrame) -> DataFrame:
    """Every document with its measures, base_failed and kept (false if base_failed or if a rate is outside the thresholds).

    The texts are measured once; the measures are written, counted into sketches, and held against the thresholds of
    their language and source. Null or empty text: no words, so base_failed. Null lang or source: a group of its own.
    Rows that repeat are judged alike. An empty table gives no rows. Only doc_id, lang, source and text are read.
    """
    small = written(measure(docs.select(*[docs[c] for c in ("doc_id", "lang", "source", "text")])).drop("text"), "quality-measures")
    return _held(small, small)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judged() keeps, with all their columns. The texts are measured twice instead of being shuffled.

    Null or empty texts fail the base rules and go. Null lang or source: a group of its own. Rows that repeat are judged
    alike, and all stay or go. An empty table stays empty. Other columns may have any names, those of the measures too.
    """
    small = written(measure(docs.select(*[docs[c] for c in ("doc_id", "lang", "source", "text")])).drop("text"), "quality-measures")
    names = [c if c in ("doc_id", "lang", "source", "text") else f"_other{i}" for i, c in enumerate(docs.columns)]
    return _held(measure(docs.toDF(*names)), small).where("kept").select(*names).toDF(*docs.columns)
