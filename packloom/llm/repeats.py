"""Removal of long byte strings that occur more than once, by column-wise construction over many strings at once.

Every string of `least` bytes has a minimiser, its K bytes with the smallest hash; equal strings have equal minimisers at
equal places. So only strings around minimisers that occur twice can repeat (an exact filter), and the stretches around one
minimiser, aligned by it, have their equal strings in equal columns. On these stretches the collection's Burrows-Wheeler
order is built column by column: each round inserts one symbol of every stretch, sorts the order stably by it, and updates
the common prefixes (here: the column from which on a stretch agrees with its neighbour in the order). A string ending in
this column repeats if the agreement with a neighbour is at least `least` long. Stretches, columns, order, agreements
and the runs found lie in files that are read and written from front to back, round by round; a task holds some numbers
for each stretch (sizes, places of columns, the open run) and one column, but no texts.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm import text as T
from packloom.llm.common import drop, written

K = 32
#: Stretches that are worked on at once, unless one minimiser has more.
AT_ONCE = 16_384
#: Entries of the order that are read at once.
ROUND = 16_384
#: Places of a minimiser from which on its stretches are split, and into how many parts at a time.
HOT, PARTS = 65_536, 8
#: Bits of a packed minimiser that hold its place in a window of a block of texts.
PLACE_BITS = 27


def minimizers(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings of `least` bytes that share their minimiser: first start, last start, place and hash of the minimiser."""
    n, span = len(data), least - K + 1
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none, none.view(np.uint64)
    if n > 1 << PLACE_BITS:  # windows that overlap, so that places fit and every start is in one of them
        windows = range(0, n - least + 1, (1 << PLACE_BITS) - least + 1)
        parts = [(a, minimizers(data[a : a + (1 << PLACE_BITS)], np.clip(offsets - a, 0, min(n - a, 1 << PLACE_BITS)), least)) for a in windows]
        return tuple(np.concatenate([x[i] + (a if i < 3 else np.uint64(0)) for a, x in parts]) for i in range(4))
    hashes = T.Rolling(data).every(K)
    bits = np.uint64((1 << PLACE_BITS) - 1)
    packed = (hashes & ~bits) | np.arange(n - K + 1, dtype=np.uint64)
    padded = np.full(-(-len(packed) // span) * span, np.iinfo(np.uint64).max)
    padded[: len(packed)] = packed
    grid = padded.reshape(-1, span)
    up = np.minimum.accumulate(grid, axis=1).ravel()
    down = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - least + 1)
    place = (np.minimum(down[: n - least + 1], up[span - 1 : n - least + span]) & bits).view(np.int64)
    starts = starts[starts + least <= np.repeat(offsets[1:], np.diff(offsets))[: n - least + 1]]
    if not len(starts):
        return none, none, none, none.view(np.uint64)
    place = place[starts]
    new = np.flatnonzero((np.diff(place) != 0) | (np.diff(starts) != 1)) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(starts)]]) - 1
    return starts[first], starts[last], place[first], hashes[place[first]]


def _anchors(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in T.blocks(batches):
            first, _, place, hashes = minimizers(data, offsets, least)
            row = np.searchsorted(offsets, first, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(hashes.view(np.int64)), pa.array(place - offsets[row])], names=["key", "anchor", "place"])

    return run


def _stretches(least: int):
    """For every wanted minimiser of the texts the stretch around it; equal stretches of a block are one row with all their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in T.blocks(batches):
            first, last, place, hashes = minimizers(data, offsets, least)
            row = np.searchsorted(offsets, first, "right") - 1
            wanted = batch.column(2)
            flat = np.asarray(wanted.flatten()) + offsets[:-1].repeat(np.diff(np.asarray(wanted.offsets)))
            keys, raw, found = batch.column(0).to_pylist(), data.tobytes(), {}
            for i in np.flatnonzero(np.isin(place, flat)):
                a = int(first[i])
                found.setdefault((int(hashes[i].view(np.int64)), raw[a : last[i] + least], int(place[i]) - a), []).append((int(row[i]), a - int(offsets[row[i]])))
            for part in range(0, len(found), 2000):
                items = list(found.items())[part : part + 2000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([k[0] for k, _ in items], pa.int64()), pa.array([k[1] for k, _ in items], pa.binary()), pa.array([k[2] for k, _ in items], pa.int32()),
                    pa.array([[keys[r] for r, _ in v] for _, v in items], pa.list_(pa.binary())), pa.array([[s for _, s in v] for _, v in items], pa.list_(pa.int64())),
                    pa.array([len(v) > 1 for _, v in items], pa.bool_()),
                ], names=["anchor", "bytes", "lead", "keys", "starts", "several"])

    return run


def _split(least: int):
    """From stretches (or pieces of them) with the places lo to hi that their minimiser may have in a string, pieces for PARTS parts of these places.

    Strings of one part share the bytes that all its strings have, its core. So equal strings lie in pieces of one group,
    named by part and core; a group's pieces have fewer columns that differ, and equal pieces have one id. At one place a
    part the core is the whole string, and a group has one id.
    """
    named = lambda *x: hashlib.blake2b(b"%d %d " % x[:2] + x[2], digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, len(batch), 256):
                out = []
                for r in batch.slice(part, 256).to_pylist():
                    data, lead, step = r["bytes"], r["lead"], -(-(r["hi"] - r["lo"] + 1) // PARTS)
                    for lo in range(r["lo"], r["hi"] + 1, step):
                        hi = min(lo + step - 1, r["hi"])
                        if max(lo, lead + least - len(data)) <= min(hi, lead):
                            a, b = max(0, lead - hi), min(len(data), lead + least - lo)
                            group, piece = named(lo, hi, data[lead - lo : lead + least - hi]), data[a:b]
                            out.append({"group": group, "id": named(lead - a, 0, group + piece), "lo": lo, "hi": hi, "bytes": piece, "lead": lead - a, "keys": r["keys"], "starts": [x + a for x in r["starts"]]})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("group", pa.binary()), ("id", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32()), ("bytes", pa.binary()), ("lead", pa.int32()), ("keys", pa.list_(pa.binary())), ("starts", pa.list_(pa.int64()))]))

    return run


def repeated_columns(flat: np.ndarray, sizes: np.ndarray, leads: np.ndarray, least: int) -> np.ndarray:
    """(piece, from, to) of the runs of strings of `least` bytes of the pieces, aligned by their leads, that another piece has in the same columns.

    flat has the pieces one after the other and may be mapped from a file. Columns, order, agreements and runs go through
    files too; in memory are a column, some numbers of each piece, and ROUND entries of the order.
    """
    shift = leads.max() - leads
    width, m = int((shift + sizes).max()), len(sizes)
    since, upto_ = np.full(m, -1, np.int64), np.full(m, -2, np.int64)  # the first and the last start of each piece's open run
    with contextlib.ExitStack() as files:
        columns, runs, *numbers = (files.enter_context(tempfile.TemporaryFile()) for _ in range(6))
        rows = max(1, (1 << 20) // m)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]) - shift
        for c in range(0, width, rows):  # the columns c to c + rows, one after the other
            at = np.arange(c, min(width, c + rows))[:, None]
            inside = (at >= shift) & (at < shift + sizes)
            columns.write(np.where(inside, flat[np.where(inside, begin + at, 0)], 0).astype(np.uint8).tobytes())
        columns.seek(0)

        def close(which: np.ndarray) -> None:
            which = which[since[which] >= 0]
            runs.write(np.stack([which, since[which] - shift[which], upto_[which] - shift[which] + least], axis=1).tobytes())

        def repeats_at(at: int, which: np.ndarray) -> None:
            which = np.unique(which[upto_[which] != at])
            started = which[upto_[which] != at - 1]
            close(started)
            since[started] = at
            upto_[which] = at

        for f in numbers:
            f.truncate(4 * m)
        # The order, and agree[i]: the column from which on order[i] agrees with order[i - 1]. They are read and written from column to column.
        order, agree, next_order, next_agree = (np.memmap(f, np.int32, "r+", shape=(m,)) for f in numbers)
        entering = np.argsort(shift, kind="stable")
        entered, leaving, count, n_in = shift[entering], shift + sizes, 0, 0
        for c in range(width):
            symbols, upto = np.frombuffer(columns.read(m), np.uint8), int(np.searchsorted(entered, c, "right"))
            order[count : count + upto - n_in], agree[count : count + upto - n_in] = entering[n_in:upto], c
            count, n_in = count + upto - n_in, upto
            count = _insert(symbols, leaving > c, c, order[:count], agree[:count], next_order, next_agree, functools.partial(repeats_at, c + 1 - least) if c + 1 >= least else None, least)
            order, agree, next_order, next_agree = next_order, next_agree, order, agree
        close(np.arange(m))
        runs.seek(0)
        found = np.frombuffer(runs.read(), np.int64).reshape(-1, 3)
    return found[np.lexsort((found[:, 1], found[:, 0]))]


def _insert(symbols: np.ndarray, stays: np.ndarray, c: int, order: np.ndarray, agree: np.ndarray, next_order: np.ndarray, next_agree: np.ndarray, repeats, least: int) -> int:
    """One round: the pieces that stay are dealt out by their symbol in column c, in the order they have, and how many they are.

    Blocks of the order are read one after the other, and each symbol's pieces are written one after the other. Between
    blocks, for each symbol, its last piece and the largest agreement since are carried on. repeats is told of pieces that
    agree with a neighbour in `least` columns.
    """
    blocks = range(0, len(order), ROUND)
    totals = sum((np.bincount(symbols[o[stays[o]]], minlength=256) for o in (order[i : i + ROUND] for i in blocks)), np.zeros(256, np.int64))
    ends_at = np.cumsum(totals)
    place_of = ends_at - totals
    since, last, left = np.full(256, c + 1, np.int32), np.full(256, -1, np.int64), 0
    for i in blocks:
        o, a = np.array(order[i : i + ROUND]), np.array(agree[i : i + ROUND])
        keep = np.flatnonzero(stays[o])
        if not len(keep):
            left = max(left, int(a.max()))
            continue
        after = int(a[keep[-1] + 1 :].max(initial=0))
        if len(keep) < len(o):
            a, o = np.maximum.reduceat(a[: keep[-1] + 1], np.concatenate([[0], keep[:-1] + 1])), o[keep]
        a[0], left = max(int(a[0]), left), after
        place = np.argsort(symbols[o], kind="stable")
        symbol, pieces = symbols[o][place], o[place]
        new = np.concatenate([[True], symbol[1:] != symbol[:-1]])
        starts, ends = np.flatnonzero(new), np.flatnonzero(np.concatenate([new[1:], [True]]))
        own = symbol[starts]
        agreed = np.maximum.reduceat(np.append(a, np.int32(0)), np.concatenate([[0], place + 1]))[:-1]
        agreed[starts] = np.maximum(since[own], np.maximum.accumulate(a)[place[starts]])
        before = np.concatenate([[-1], pieces[:-1]])
        before[starts] = last[own]
        to = np.arange(len(pieces)) + np.repeat(place_of[own] - starts, ends - starts + 1)
        next_order[to], next_agree[to] = pieces, agreed
        place_of[own] += ends - starts + 1
        since = np.maximum(since, a.max())
        since[own], last[own] = np.append(np.maximum.accumulate(a[::-1])[::-1], np.int32(0))[place[ends] + 1], pieces[ends]
        if repeats:
            long = agreed <= c + 1 - least
            repeats(np.concatenate([pieces[long], before[long]]))
    return int(ends_at[-1])


class _Held:
    """Stretches that are worked on at once: their bytes and places in files, their sizes and leads in memory."""

    def __init__(self):
        self.bytes, self.places = tempfile.TemporaryFile(), tempfile.TemporaryFile()
        self.sizes, self.leads, self.several, self.anchor = array("q"), array("q"), array("b"), None

    def add(self, r: dict) -> None:
        self.bytes.write(r["bytes"])
        pickle.dump((r["keys"], r["starts"]), self.places)
        self.sizes.append(len(r["bytes"]))
        self.leads.append(r["lead"])
        self.several.append(r["several"])
        self.anchor = r["anchor"]

    def found(self, least: int) -> Iterator[pa.RecordBatch]:
        """The places (key, from, to) of texts that are covered by repeated strings."""
        sizes, runs = np.array(self.sizes), np.zeros((0, 3), np.int64)
        if len(sizes) > 1:
            self.bytes.flush()
            runs = repeated_columns(np.memmap(self.bytes, np.uint8, "r"), sizes, np.array(self.leads), least)
        ends = np.searchsorted(runs[:, 0], np.arange(len(sizes)), "right")
        self.places.seek(0)
        out: list[tuple[bytes, int, int]] = []
        for i, several in enumerate(self.several):
            places = pickle.load(self.places)
            own = [(0, int(sizes[i]))] if several else runs[ends[i - 1] if i else 0 : ends[i], 1:].tolist()
            if own:
                out += [(key, start + a, start + b) for key, start in zip(*places, strict=True) for a, b in own]
            if len(out) >= 10_000:
                yield _spans(out)
                out = []
        if out:
            yield _spans(out)
        self.bytes.close()
        self.places.close()


def _spans(rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    keys, starts, ends = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["key", "from", "to"])


def _repeated(least: int):
    """From stretches sorted by minimiser, the places (key, start, end) of texts that are covered by repeated strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            for a in range(0, len(batch), 4096):
                for r in batch.slice(a, 4096).to_pylist():
                    if len(held.sizes) >= AT_ONCE and r["anchor"] != held.anchor:
                        yield from held.found(least)
                        held = _Held()
                    held.add(r)
        yield from held.found(least)

    return run


def _without(data: bytes, spans: list[dict]) -> tuple[bytes, int]:
    """The bytes outside the spans, and how many runs go."""
    rest, at, end, runs = [], 0, -1, 0
    for s in sorted(spans, key=lambda x: x["from"]):
        if s["from"] > end:
            rest.append(data[at : s["from"]])
            runs += 1
            end = at = s["to"]
        elif s["to"] > end:
            end = at = s["to"]
    return b"".join([*rest, data[at:]]), runs


CUT = "key binary, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_bytes bigint, kept_text string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, text, spans, passages), what goes with the spans, and the text without the passages."""
    for batch in batches:
        for a in range(0, len(batch), 256):
            out = []
            for r in batch.slice(a, 256).to_pylist():
                data = r["text"].encode()
                kept, runs = _without(data, r["spans"] or [])
                rest, _ = _without(data, r["passages"])
                out.append({"key": r["key"], "n_removed": len(data) - len(kept), "n_spans": runs, "kept_sha256": hashlib.sha256(kept).hexdigest(), "n_passage_bytes": len(data) - len(rest), "kept_text": rest.decode("utf-8", "ignore")})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passage_bytes", pa.int64()), ("kept_text", pa.string())]))


def _fragments(least: int):
    """From (key, text, passages) the runs of passages of `least` bytes and more, which have all longer strings that repeat: key and place, and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                out = []
                for r in batch.slice(a, 256).to_pylist():
                    data, runs = r["text"].encode(), []
                    for s in sorted(r["passages"], key=lambda x: x["from"]):
                        if runs and s["from"] <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], s["to"])
                        else:
                            runs.append([s["from"], s["to"]])
                    out += [{"key": r["key"] + x.to_bytes(8), "text": data[x:y]} for x, y in runs if y - x >= least]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.binary()), ("text", pa.binary())]))

    return run


def _key(docs: DataFrame) -> F.Column:
    """Half of the text's SHA-256: copies are texts of equal keys."""
    return F.substring(F.unhex(_sha(docs)), 1, 16)


def _sha(docs: DataFrame) -> F.Column:
    return F.sha2(F.encode(F.coalesce(docs["text"], F.lit("")), "UTF-8"), 256)


SPANS = "key binary, `from` bigint, `to` bigint"


def _hot_spans(stretches: DataFrame, least: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """What _repeated finds, for the stretches of frequent minimisers, split until no group has more than HOT unlike pieces; and the tables behind it."""
    out, tables, rows = [], [], stretches.select(F.lit(0).alias("lo"), F.lit(least - K).alias("hi"), "bytes", "lead", "keys", "starts")
    while True:
        fields = "group binary, id binary, lo int, hi int, bytes binary, lead int, keys array<binary>, starts array<bigint>"
        pieces = written(rows.mapInArrow(_split(least), fields), "pieces")
        first = [F.first(c).alias(c) for c in ("lo", "hi", "bytes", "lead")]
        unlike = written(pieces.groupBy("group", "id").agg(*first, (F.sum(F.size("keys")) > 1).alias("several")), "unlike")
        large = written(unlike.groupBy("group").count().where(F.col("count") > HOT).select("group"), "large")
        done = unlike.join(large, "group", "left_anti").select(F.xxhash64("group").alias("anchor"), "bytes", "lead", F.array("id").alias("keys"), F.array(F.lit(0).cast("long")).alias("starts"), "several")
        found = written(done.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_repeated(least), SPANS).withColumnRenamed("key", "id"), "found")
        places = pieces.select("id", F.explode(F.arrays_zip("keys", "starts")).alias("at"))
        out.append(found.join(places, "id").select(F.col("at.keys").alias("key"), (F.col("from") + F.col("at.starts")).alias("from"), (F.col("to") + F.col("at.starts")).alias("to")))
        tables += [pieces, unlike, large, found]
        if large.isEmpty():
            return out, tables
        rows = pieces.join(large, "group", "left_semi").select("lo", "hi", "bytes", "lead", "keys", "starts")


def _repeats(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """For (key, text), where equal keys have equal texts: tables of the suspects (key, text) and of the repeats (key, spans) among them."""
    texts = texts.where(F.octet_length("text") >= least)
    anchors = written(texts.mapInArrow(_anchors(least), "key binary, anchor bigint, place bigint").distinct(), "anchors")
    twice = written(anchors.groupBy("anchor").count().where("count > 1"), "twice")  # a table: then Spark can split the rows of a frequent minimiser
    wanted = anchors.join(twice, "anchor", "left_semi").groupBy("key").agg(F.collect_list("place").alias("places"))
    once = texts.groupBy("key").agg(F.first("text").alias("text"))
    suspects = written(once.join(wanted, "key").select("key", "text", "places"), "suspects")
    drop(anchors)
    stretches = suspects.mapInArrow(_stretches(least), "anchor bigint, bytes binary, lead int, keys array<binary>, starts array<bigint>, several boolean")
    tables = [twice, written(twice.where(F.col("count") > HOT).select("anchor"), "hot")]
    hot = tables[-1]
    any_hot = not hot.isEmpty()
    usual = stretches.join(hot, "anchor", "left_anti") if any_hot else stretches
    spans = usual.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_repeated(least), SPANS)
    if any_hot:
        found, more = _hot_spans(stretches.join(hot, "anchor", "left_semi"), least)
        spans, tables = functools.reduce(DataFrame.unionByName, found, spans), tables + more
    per_text = written(spans.groupBy("key").agg(F.collect_list(F.struct("from", "to")).alias("spans")), "spans")
    for t in tables:
        drop(t)
    return suspects, per_text


def _cleaned(docs: DataFrame, least: int, passage: int | None = None) -> DataFrame:
    """CUT for the texts, by key, that lose bytes to other places than whole copies: spans of `least` bytes and passages of `passage` (as `least`, if None).

    Longer strings that repeat lie in runs of shorter ones, so that only these are looked through again.
    """
    suspects, short = _repeats(docs.select(_key(docs).alias("key"), docs["text"].alias("text")), passage or least)
    passages = suspects.select("key", "text").join(short.withColumnRenamed("spans", "passages"), "key")
    tables = [suspects, short]
    if passage is None or passage == least:
        both = passages.withColumn("spans", F.col("passages"))
    else:
        fragments = written(passages.mapInArrow(_fragments(least), "key binary, text binary"), "fragments")
        again, long = _repeats(fragments, least)
        placed = long.select(F.substring("key", 1, 16).alias("whole"), F.conv(F.hex(F.substring("key", 17, 8)), 16, 10).cast("long").alias("place"), "spans")
        moved = F.transform("spans", lambda s: F.struct((s["from"] + F.col("place")).alias("from"), (s["to"] + F.col("place")).alias("to")))
        long_spans = placed.select(F.col("whole").alias("key"), moved.alias("spans")).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        both = passages.join(long_spans, "key", "left")
        tables += [fragments, again, long]
    cleaned = written(both.select("key", "text", "spans", "passages").mapInArrow(_cut, CUT), "cleaned")
    for t in tables:
        drop(t)
    return cleaned


def _marks(docs: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row a key: n for the keys that several rows of docs have, the columns of cleaned for the others.

    Copies go wholly if they are long enough, and lose nothing if not, so that nothing else need be known of them. As one
    side of one join, it lets Spark split the rows of a key that many have.
    """
    copies = docs.select(_key(docs).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return copies.unionByName(cleaned.join(copies, "key", "left_anti"), allowMissingColumns=True)


def removals(docs: DataFrame, least: int = 400, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every document; with `passage` (at most `least`) also n_passage_bytes and kept_text.

    A byte goes if a string of `least` bytes that covers it also starts anywhere else, in the same document or another;
    strings overlap, are judged on the input, and never cross documents. Texts that several rows have go wholly if they
    have `least` bytes. Texts are shuffled once, to bring copies together, and once more for kept_text; what else follows
    moves suspects only. n_passage_bytes counts, and kept_text leaves out, what is covered by strings of `passage` bytes
    in the same way; of characters that are cut in two, kept_text has nothing.

    Null text: empty. Rows that repeat are copies of each other. An empty table gives no rows. Only doc_id and text are
    read. A span is a maximal run of removed bytes.
    """
    text = [docs["text"].alias("text")] if passage else []
    rows = docs.select(docs["doc_id"], _key(docs).alias("key"), _sha(docs).alias("sha"), F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long").alias("n_bytes"), *text)
    cleaned = _cleaned(docs, least, passage)
    both = rows.join(_marks(docs, cleaned if passage else cleaned.drop("kept_text")), "key", "left")
    gone = lambda size: (F.col("n") > 1) & (F.col("n_bytes") >= size)
    pick = lambda whole, name, none, size=least: F.when(gone(size), whole).otherwise(F.coalesce(F.col(name), none)).alias(name)
    more = [pick(F.col("n_bytes"), "n_passage_bytes", F.lit(0).cast("long"), passage), pick(F.lit(""), "kept_text", F.coalesce("text", F.lit("")), passage)] if passage else []
    return both.select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), "n_removed", F.lit(0).cast("long")), pick(F.lit(1).cast("long"), "n_spans", F.lit(0).cast("long")),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), "kept_sha256", F.col("sha")), *more,
    )


def without_repeats(docs: DataFrame, least: int) -> DataFrame:
    """docs with the repeated bytes taken out of text, and n_chars, where there is such a column, set anew.

    Characters of which a byte goes are dropped whole. No row is dropped; null texts stay null, and texts that several
    rows have become empty. An empty table stays empty. Columns may have any names, as long as they differ.
    """
    cleaned = _cleaned(docs, least).select("key", "kept_text")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    keyed = docs.select(_key(docs).alias("key"), *[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)])
    text = names[docs.columns.index("text")]
    both = keyed.join(_marks(docs, cleaned), "key", "left")
    kept = F.when((F.col("n") > 1) & (F.octet_length(text) >= least), F.lit("")).otherwise(F.coalesce("kept_text", text))
    value = lambda c, n: kept if c == "text" else F.coalesce(F.char_length(kept), F.lit(0)).cast(docs.schema[c].dataType) if c == "n_chars" else F.col(n)
    return both.select(*[value(c, n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
