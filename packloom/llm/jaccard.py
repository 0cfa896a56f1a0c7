"""Exact Jaccard joins of word shingles with multi-match prefixes.

Two sets with a Jaccard similarity of t or more share at least O = ceil(t * n) tokens, n the size of either. In any
common order of tokens, the first n - O + 1 tokens of both then share a token. Short sets offer these. Of longer ones, a
token alone has too many candidates, more and more as the corpus grows. So their prefix is lengthened, up to the whole
set, until so many tokens must be shared that some of them stand next to each other: the at most (1 - t) / (1 + t) * S
tokens that only one of two sets has, S the sum of their sizes, cut the shared ones into runs, of which the longest has RUN
tokens at least, neighbours in the order of both sets. A set offers grams of neighbours, the least of each window of grams,
and a run has a whole window, so that two linked sets offer a common gram.

Most sets that offer a common gram do so by chance or for a passage, and the more of them the larger the corpus is, until
nearly all are connected. But two linked sets have a share of their grams in common, so that sets that have fewer in common
with all others together are left out, again and again. Each of the others is compared with the one set, of the least ones
of its offers, that it shares most offers with; offers that only one class has then lead nowhere, and sets with too few
others are left out again. What is left falls into connected parts, in which full sets are compared through an inverted
index; the sets of a part that is too large for one task are compared with hubs first, and what that leaves open by pairs
of blocks.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packloom.llm import text as T
from packloom.llm.common import WORD, components, drop, written

#: Tokens, and sets, that one task compares at most. Larger parts are compared with hubs first, and what is left by pairs of blocks.
BLOCK_TOKENS, BLOCK_SETS = 1_000_000, 2_000
#: Hubs that the sets of a large part are compared with, one after the other.
HUBS = 2
#: Sets of so many tokens and less may offer single tokens, so that longer ones have longer runs.
SHORT = 40
#: Added to single tokens, so that no gram is taken for one.
SINGLE = np.uint64(0x5851F42D4C957F2D)


def overlap(n, percent: int):
    return (percent * n + 99) // 100


@functools.cache
def scheme(percent: int) -> tuple[int, int, int]:
    """(sets longer than this offer grams, tokens of a gram, grams of a window).

    Two linked sets of n tokens and more share a run of more than r - 1 tokens if n * (t - (r - 1) * (1 - t)) > r - 1.
    """
    run, least = 1, 0
    for r in range(2, SHORT + 1):
        left = percent - (r - 1) * (100 - percent)
        if left > 0 and 100 * (r - 1) // left <= SHORT:
            run, least = r, max(r - 1, 100 * (r - 1) // left)
    gram = -(-3 * run // 8)
    return least, gram, run - gram + 1


def offers(tokens: np.ndarray, percent: int) -> np.ndarray:
    """What a set offers, from its tokens in order: two linked sets offer something in common."""
    least, gram, window = scheme(percent)
    n, out = len(tokens), []
    if n > least:
        grams = np.zeros(n - gram + 1, np.uint64)
        for i in range(gram):
            grams = grams * np.uint64(0xD1342543DE82EF95) + tokens[i : i + len(grams)]
        out.append(np.lib.stride_tricks.sliding_window_view(T.mix(grams), window).min(axis=1))
    if 100 * least >= percent * n:  # a partner may be too short for grams
        out.append(T.mix(tokens[: n - overlap(n, percent) + 1] + SINGLE))
    return np.unique(np.concatenate(out)) if out else tokens


def _sets(n_words: int, percent: int, with_offers: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in T.blocks(batches):
            sets = T.shingles(data, offsets, n_words)
            n = [len(x) for x in sets]
            mixed = [T.mix(x + np.uint64(0x632BE59BD9B4E019)) for x in sets]
            columns = [pa.array(n, pa.int64()), pa.array(np.array([x.sum(dtype=np.uint64) for x in mixed], np.uint64).view(np.int64)), pa.array(np.array([np.bitwise_xor.reduce(x) for x in mixed], np.uint64).view(np.int64))]
            if with_offers:
                found = [offers(x, percent).view(np.int64) for x in sets]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["doc_id", "key", "n", "node", "check", *(["offers"] if with_offers else [])])

    return run


def _full_sets(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in T.blocks(batches):
            sets = T.shingles(data, offsets, n_words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["label", "node", "n", "tokens"])

    return run


def join_sets(sets: list[np.ndarray], percent: int, group: np.ndarray | None = None) -> np.ndarray:
    """For each set the smallest index of a set that it is linked with over any links.

    group (optional): sets of one group above 0 are linked already. Of two such groups only the smaller's sets are looked up.
    """
    m = len(sets)
    group = np.zeros(m, np.int64) if group is None else group
    root = np.arange(m)
    for g in np.unique(group[group > 0]):
        root[group == g] = np.flatnonzero(group == g)[0]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    sizes = np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), sizes)
    order = np.argsort(ids, kind="stable")
    postings, counts = row[order], np.bincount(ids)
    first = np.concatenate([[0], np.cumsum(counts)])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    parts = len(np.unique(root))
    most = np.bincount(group)[1:].argmax() + 1 if group.any() else 0
    for i in np.flatnonzero((group == 0) | (group != most)):
        if parts == 1:
            break
        t = ids[ends[i] : ends[i + 1]]
        t = t[counts[t] > 1]
        if not len(t):
            continue
        n = counts[t]
        at = np.repeat(first[t] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(postings[at], minlength=m)
        for j in np.flatnonzero(100 * shared >= percent * (sizes[i] + sizes - shared)):
            a, b = find(i), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
                parts -= 1
    return np.array([find(i) for i in range(m)])


def _compared(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "node"])
        nodes = pdf["node"].to_numpy()
        found = join_sets([np.frombuffer(x, np.uint64) for x in pdf["tokens"]], percent, pdf["hub"].to_numpy())
        return pd.DataFrame({"a": nodes, "b": nodes[found]})

    return run


def _linked_with_hub(percent: int, nth: int):
    """Sets (label, node, n, tokens, hub, the hub's tokens) with hub set to nth where they are linked with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, hubs, hub = batch.column(3), batch.column(5), batch.column(4).to_numpy(zero_copy_only=False).copy()
            for i in np.flatnonzero(hub == 0):
                a, b = np.frombuffer(tokens[i].as_py(), np.uint64), np.frombuffer(hubs[i].as_py() or b"", np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    hub[i] = nth
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hub)], names=batch.schema.names[:5])

    return run


def _classes_of_large_parts(large: DataFrame, percent: int) -> DataFrame:
    """(node, label), a number for the class, for the sets (label, node, n, tokens) of parts that are too large for one task.

    Each set is compared with up to HUBS hubs of its part. Sets linked with a hub are one class with it, so only pairs of
    different hubs' sets, and all pairs of those linked with none, are left. These are compared by pairs of blocks. A block
    holds sets of one part, one hub and one class of sizes; only neighbouring classes of sizes can have links.
    """
    kind = "label bigint, node bigint, n bigint, tokens binary, hub bigint"
    rows, hubs = large.withColumn("hub", F.lit(0).cast("long")), []
    for nth in range(1, HUBS + 1):
        chosen = rows.where("hub = 0").groupBy("label").agg(F.min_by(F.struct("node", "tokens"), "node").alias("h"))
        hubs.append(written(chosen.select("label", F.lit(nth).cast("long").alias("hub"), F.col("h.node").alias("h_node"), F.col("h.tokens").alias("h_tokens")), "hubs"))
        joined = rows.join(hubs[-1].drop("hub"), "label", "left").select("label", "node", "n", "tokens", "hub", "h_tokens")
        after = written(joined.mapInArrow(_linked_with_hub(percent, nth), kind), "large")
        drop(large if nth == 1 else rows)
        rows = after
    to_hubs = [rows.join(h.select("label", "hub", "h_node"), ["label", "hub"]).select(F.col("node").alias("a"), F.col("h_node").alias("b")) for h in hubs]
    # A little over the ratio of sizes that links allow, so that rounding can't put two linked sets two steps apart.
    step = f"cast(ln(n) / {math.log(max(100 / percent, 1.01)) * (1 + 1e-9)} as int)"
    sized = rows.withColumn("step", F.expr(step))
    blocks = sized.groupBy("label", "hub", "step").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_TOKENS, F.count(F.lit(1)) / BLOCK_SETS) * 2).cast("int").alias("parts"))
    blocks = written(blocks, "blocks")
    each = blocks.select("label", "hub", "step", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    one = each.select("label", F.struct("hub", "step", "part").alias("x"))
    two = each.select(F.col("label").alias("l2"), F.struct("hub", "step", "part").alias("y"))
    near = (F.col("label") == F.col("l2")) & (F.col("x") <= F.col("y")) & (F.abs(F.col("x.step") - F.col("y.step")) <= 1)
    pairs = one.join(two, near & ((F.col("x.hub") != F.col("y.hub")) | (F.col("x.hub") == 0))).select("label", "x", "y")
    sides = pairs.select("label", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("z")).select("label", "x", "y", "z.hub", "z.step", "z.part")
    placed = sized.join(blocks, ["label", "hub", "step"]).withColumn("part", F.expr("cast(pmod(xxhash64(node), parts) as int)")).drop("parts")
    cut = placed.join(sides, ["label", "hub", "step", "part"])
    stars = cut.select("label", "x", "y", "node", "n", "tokens", "hub").groupBy("label", "x", "y").applyInPandas(_compared(percent), "a bigint, b bigint")
    out = components(functools.reduce(DataFrame.unionByName, to_hubs, stars))
    for t in (rows, blocks, *hubs):
        drop(t)
    return out


def _least_shared(percent: int, total: F.Column) -> F.Column:
    """How many offers two linked sets, longer than those that offer single tokens, share at least; total: their sizes' sum, or less.

    Of the runs of their shared tokens, one of r tokens has r - run + 1 windows of grams, and a gram is the least of `window` of them at most.
    """
    _, gram, window = scheme(percent)
    run = gram + window - 1
    left = percent - (run - 1) * (100 - percent)
    return F.greatest(F.lit(1), F.ceil((total * left / (100 + percent) - (run - 1)) / window - 1e-9))


def _enough(percent: int, n: F.Column, count: F.Column) -> F.Column:
    """Whether a set of n tokens that has `count` offers in common with others can be linked with any of them."""
    return (n * percent <= 100 * scheme(percent)[0]) | (count >= _least_shared(percent, n * (100 + percent) / 100))


def _open(rows: DataFrame, percent: int) -> DataFrame:
    """Those of the offers (node, n, top, offer) that sets of several tops have, of the sets that have enough of them; the others have no link to another top.

    What goes leaves others with fewer, so this is done again while it takes away a tenth.
    """
    while True:
        several = rows.groupBy("offer").agg(F.min("top").alias("lo"), F.max("top").alias("hi")).where("lo < hi").select("offer")
        left = written(rows.join(several, "offer", "left_semi"), "open")
        enough = written(left.groupBy("node", "n").agg(F.count(F.lit(1)).alias("count")).where(_enough(percent, F.col("n"), F.col("count"))).select("node"), "enough")
        after = written(left.join(enough, "node", "left_semi").select("node", "n", "top", "offer"), "open")
        done = after.count() * 10 >= rows.count() * 9
        for t in (rows, left, enough):
            drop(t)
        if done:
            return after
        rows = after


def _nearest_hubs(rows: DataFrame, percent: int) -> DataFrame:
    """(node, b): of the sets that are the least of an offer's, that with which a set shares the most offers, if enough of them."""
    least = rows.groupBy("offer").agg(F.min(F.struct(F.col("node").alias("b"), F.col("n").alias("m"))).alias("h")).select("offer", "h.b", "h.m")
    met = rows.join(written(least, "least"), "offer").where("node <> b").groupBy("node", "n", "b", "m").agg(F.count(F.lit(1)).alias("count"))
    small, large = F.least("n", "m"), F.greatest("n", "m")
    short = small * percent <= 100 * scheme(percent)[0]
    may = (large * percent <= small * 100) & (short | (F.col("count") >= _least_shared(percent, small + large)))
    return met.where(may).groupBy("node").agg(F.max_by("b", F.struct("count", "b")).alias("b"))


def _linked(percent: int):
    """(a, b) for those sets (node, tokens, b, the tokens of b) that are linked with b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(1), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * shared >= percent * (len(a) + len(b) - shared))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["a", "b"])
            yield out.filter(pa.array(linked, pa.bool_()))

    return run


def _compared_parts(full: DataFrame, rows: DataFrame, percent: int) -> tuple[DataFrame | None, list[DataFrame]]:
    """(a, b) for links that connect what links among the sets (node, n, tokens) with the offers (node, offer) connect, and the tables behind it."""
    least = written(rows.groupBy("offer").agg(F.min("node").alias("b")), "least")
    parts = components(rows.join(least, "offer").select(F.col("node").alias("a"), "b"))
    drop(least)
    placed = written(full.join(parts, "node").select("label", "node", "n", "tokens"), "placed")
    drop(parts)
    totals = written(placed.groupBy("label").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("members")), "totals")
    is_large = (F.col("all") > BLOCK_TOKENS) | (F.col("members") > BLOCK_SETS)
    both = placed.join(totals, "label")
    small = both.where(~is_large).select("label", "node", "n", "tokens", F.lit(0).cast("long").alias("hub"))
    links = written(small.groupBy("label").applyInPandas(_compared(percent), "a bigint, b bigint"), "stars")
    tables = [links]
    if not totals.where(is_large).isEmpty():
        of_large = _classes_of_large_parts(written(both.where(is_large).select("label", "node", "n", "tokens"), "large"), percent)
        links, tables = links.unionByName(of_large.select(F.col("node").alias("a"), F.col("label").alias("b"))), [links, of_large]
    drop(placed)
    drop(totals)
    return links, tables


def _labelled(docs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """doc_id, key (of doc_id and text), n (the set's size) and top (a number for the class, null where n is 0) for every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"], docs["text"], _key(docs).alias("key"))
    fields = f"doc_id {kind}, key binary, n bigint, node bigint, `check` bigint"
    slim = written(rows.mapInArrow(_sets(n_words, percent, False), fields), "sets")
    offered = rows.mapInArrow(_sets(n_words, percent, True), f"{fields}, offers array<bigint>").where("n > 0")
    # The row whose text stands for a set: a doc_id alone does not tell which, as rows may share it or have none.
    heads = written(offered.groupBy("node", "n", "check").agg(F.min("key").alias("rep"), F.first("offers").alias("offers")).drop("check"), "heads")
    each = heads.select("node", F.explode("offers").alias("offer"))
    # Tables of one row an offer: then Spark can split the rows of a frequent offer in the join with it.
    several = written(each.groupBy("offer").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("offer"), "several")
    shared = written(each.join(several, "offer", "left_semi"), "shared")
    names = written(heads.select("node", "n", "rep"), "names")
    drop(heads)
    drop(several)
    offers = _open(written(shared.join(names, "node").select("node", "n", F.col("node").alias("top"), "offer"), "offers"), percent)
    drop(shared)

    # Most sets that are linked are so with the nearest hub. What offers then still lead from class to class is compared by parts.
    near = written(_nearest_hubs(offers, percent), "near")
    hubs = near.select(F.col("b").alias("node"), F.lit(True).alias("is_hub")).distinct()
    chosen = offers.select("node").distinct().join(names.drop("n"), "node").join(near, "node", "left").join(hubs, "node", "left")
    texts = rows.join(chosen, rows["key"] == F.col("rep")).select("key", "node", "b", F.coalesce("is_hub", F.lit(False)).alias("is_hub"), "text").dropDuplicates(["key"])
    full = texts.select(F.struct("node", "b", "is_hub").alias("label"), "node", "text").mapInArrow(_full_sets(n_words), "label struct<node: bigint, b: bigint, is_hub: boolean>, node bigint, n bigint, tokens binary")
    full = written(full.dropDuplicates(["node"]).select("node", "n", "tokens", "label.b", "label.is_hub"), "full")
    drop(names)
    drop(near)
    to_hubs = full.where("b is not null").select("node", "tokens", "b").join(full.where("is_hub").select(F.col("node").alias("b"), F.col("tokens").alias("h_tokens")), "b")
    links = written(to_hubs.select("node", "tokens", "b", "h_tokens").mapInArrow(_linked(percent), "a bigint, b bigint"), "links")
    tops = components(links)
    placed = offers.drop("top").join(tops.select("node", F.col("label").alias("top")), "node", "left")
    left = _open(written(placed.select("node", "n", F.coalesce("top", "node").alias("top"), "offer"), "offers"), percent)
    tables = [slim, links, offers, left, tops]
    if not left.isEmpty():
        more, behind = _compared_parts(full.select("node", "n", "tokens"), left, percent)
        tops, tables = components(links.unionByName(more)), [*tables, *behind]
        tables.append(tops)
    drop(full)
    out = slim.join(tops.where("node <> label").select("node", F.col("label").alias("top")), "node", "left").select("doc_id", "key", "n", F.when(F.col("n") > 0, F.coalesce("top", "node")).alias("top"))
    out = written(out, "classes")
    for t in tables:
        drop(t)
    return out


def _key(docs: DataFrame) -> F.Column:
    """Half of the SHA-256 of a row's doc_id and text."""
    said = F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("?")), F.lit(":"), F.coalesce(docs["text"], F.lit("")))
    return F.substring(F.unhex(F.sha2(F.encode(said, "UTF-8"), 256)), 1, 16)


def classes(docs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reached over links) for every document.

    Documents link when 100 * intersection >= percent * union of their sets of n_words-word shingles (A-Z lower-cased;
    with fewer words, the whole sequence is one; without words or text, the set is empty and links with nothing, and the
    component is the document itself). Documents of equal sets are one node, compared once and never with each other.
    Rows that repeat are alike. Null doc_id: never the smallest unless all are null. An empty table gives no rows. Only
    doc_id and text are read. Sets are compared through 64-bit hashes of their shingles.
    """
    rows = _labelled(docs, n_words, percent)
    least = written(rows.where("n > 0").groupBy("top").agg(F.min("doc_id").alias("least")), "least")
    return rows.join(least, "top", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each class of near copies, that with the smallest doc_id, and every row without words. All columns are kept.

    Rows that share a doc_id but not a class are documents of their own. Among rows of one class and doc_id one text is
    chosen by its hash, and among equal ones one row. Null doc_id: comes last in its class. Null text has no words, so
    that its row stays. An empty table stays empty. Columns may have any names, as long as they differ.
    """
    rows = _labelled(docs, n_words, percent)
    best = rows.where("n > 0").groupBy("top").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
    best = written(best.select(F.col("best.key").alias("key")), "best")
    drop(rows)
    names = [f"c{i}" for i in range(len(docs.columns))]
    keyed = docs.select(_key(docs).alias("key"), F.coalesce(docs["text"].rlike(WORD), F.lit(False)).alias("worded"), *[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)])
    hashable = [n for n, f in zip(names, docs.schema, strict=True) if not {"map", "variant"} & set(re.findall("[a-z]+", f.dataType.simpleString()))]
    order = Window.partitionBy("key").orderBy(F.xxhash64(*hashable))
    kept = keyed.where("worded").join(best, "key", "left_semi").withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return kept.select(*names).unionByName(keyed.where("not worded").select(*names)).toDF(*docs.columns)
