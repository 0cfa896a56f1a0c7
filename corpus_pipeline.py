"""A corpus pipeline: filter, deduplicate, cut repeats, mix, encode. Each stage works on what the one before kept."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from packloom.llm import jaccard, mixing, pieces, quality, repeats
from packloom.llm.common import drop, made, release, table, written
from packloom.llm.queries import tokenizer

#: Shorter than in op7's contract. Passages are measured in bytes: fifty-one words of one to three letters can be shorter, and then stay.
PASSAGE_BYTES = 200


#: Rows that go to a Python worker at once: texts are worked on by blocks of about 1 MB, and what waits beside them only takes memory.
ROWS_AT_ONCE = 1_000
#: The intermediate tables behind the result of the stage that was called last.
_behind: list[str] = []


def stage(make):
    """A stage: when it begins, its predecessor's result is written, so the intermediate tables behind that go."""

    @functools.wraps(make)
    def run(spark, docs, sf_dir):
        docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)
        release(docs, _behind)
        before = made()
        out = make(spark, docs, sf_dir)
        _behind[:] = [x for x in made() if x not in before]
        return out

    return run


@stage
def quality_rules(spark, docs, sf_dir):
    """Documents that the rules reject go, those with null or empty texts among them; copies are judged alike. All columns stay as they are."""
    return quality.keep_good(docs)


@stage
def jaccard_join(spark, docs, sf_dir):
    """One document of each class of near copies stays (five-word shingles, similarity 0.8): that with the smallest doc_id, null last.

    Of rows that repeat one stays; rows that share a doc_id but not a class all stay, as do texts without a word or null.
    """
    return jaccard.keep_one(docs, 5, 80)


@stage
def suffix_dedup(spark, docs, sf_dir):
    """Passages that occur more than once are cut from texts; n_chars follows. No row goes, null texts stay null, and texts that several rows have become empty."""
    return repeats.without_repeats(docs, PASSAGE_BYTES)


@stage
def source_mix(spark, docs, sf_dir):
    """Documents as often, and in the order, as the mix takes them. Null sources are one source; texts without a word or null count as size 0."""
    return mixing.curriculum(docs)


@stage
def sentencepiece(spark, docs, sf_dir):
    """The ids of every document, and whether they decode to its text; null or empty text: no ids, and round_trip true."""
    rows = pieces.decode(pieces.encode(docs, tokenizer()), tokenizer())
    return rows.select("doc_id", "n_bytes", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.xxhash64("decoded") == F.col("text_hash")).alias("round_trip"))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", jaccard_join), ("suffix-array dedup", suffix_dedup), ("mixing sources", source_mix), ("SentencePiece encoding", sentencepiece)]

#: SQL can express neither the suffix-array stage nor the encoding; tests hold each stage's operator, with these parameters, against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (_, make) in enumerate(STAGES):
        before, docs = docs, make(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "stage")
            drop(before)
    return docs
