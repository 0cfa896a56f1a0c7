"""SentencePiece encoding and decoding, with a max-plus parallel scan over the chunks of giant documents.

A state at a cut is a piece that ends at the cut or reaches over it. The matrix of a chunk holds, for a state s at its
start and t at its end, the best sum of scores of the pieces after s up to t, or minus infinity where no run of pieces
leads from s to t. In a BPE model a run is allowed only if each pair of neighbours is the segmentation of its joined text
(see bpe.Bpe), so that the one allowed run through the whole document is the library's segmentation. Matrices are
multiplied in the (max, +) semiring, which is associative: groups of chunks, then groups of groups, up to one matrix a
document; the way back fixes the states at every cut, and each chunk then writes its own pieces. Its segmentation is made once and kept for that.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm import bpe
from packloom.llm import text as T
from packloom.llm.common import drop, written

#: Texts of more bytes are split into chunks of CHUNK bytes; FAN chunks or groups make a group of the next level.
GIANT, CHUNK, FAN, NEAR = 1 << 15, 1 << 13, 64, 128
MATRIX = "key binary, no long, n_in int, n_out int, m binary"


def _states(m: bpe.Bpe, data: bytes, cut: int) -> list[tuple[int, int]]:
    """Pieces (begin, end) with begin < cut <= end that the model can produce; unknown characters are pieces of their own."""
    found = []
    for b in range(max(0, cut - m.longest), cut):
        if data[b] & 0xC0 == 0x80:
            continue
        for e in range(cut, min(len(data), b + m.longest) + 1):
            if e < len(data) and data[e] & 0xC0 == 0x80:
                continue
            piece = data[b:e]
            if piece in m.ids and list(m.encode(piece)) == [m.ids[piece]]:
                found.append((b, e))
            elif e == cut and bpe.edge(data, b + 1) == cut and piece not in m.ids:
                found.append((b, e))
    return found


class Chunk:
    """A chunk [c0, c1) of `data`, which has some bytes before and after it; the document's start and end have one state."""

    def __init__(self, m: bpe.Bpe, data: bytes, c0: int, c1: int, first: bool, last: bool, inner: bytes | None = None):
        self.m, self.data, self.c0, self.c1 = m, data, c0, c1
        self.ins = [None] if first else _states(m, data, c0)
        self.outs = [None] if last else _states(m, data, c1)
        self.inner = m.spans(data[c0:c1], c0) if inner is None else m.placed(np.frombuffer(inner, np.int32).astype(np.int64), c0)
        self.sums = np.concatenate([[0.0], np.cumsum(m.score[self.inner[0]])])
        self._heads, self._tails = {}, {}

    def head(self, i: int):
        """What _head says of state i, made when it is asked for: a run needs one state of each side."""
        if i not in self._heads:
            self._heads[i] = self._head(self.ins[i])
        return self._heads[i]

    def tail(self, j: int):
        if j not in self._tails:
            self._tails[j] = self._tail(self.outs[j])
        return self._tails[j]

    def _head(self, s):
        """(ids after s, index in the inner pieces from where on those are used); ids None: s can't stand before those; (): no joint."""
        if s is None:
            return np.zeros(0, np.int64), 0
        near = NEAR
        while True:
            stop = bpe.edge(self.data, min(self.c1, self.c0 + near))
            got = self.m.spans(self.data[s[0] : stop], s[0])
            if found := self.m.joint(got, self.inner, last=False):
                k = int(np.searchsorted(got[2], s[1]))
                return got[0][k + 1 : found[0] + 1] if self._alone(got, 0, s) else None, found[1] + 1
            if stop >= self.c1:
                return ()
            near *= 4

    def _tail(self, t):
        if t is None:
            return np.zeros(0, np.int64), len(self.inner[0])
        near = NEAR
        while True:
            start = bpe.edge(self.data, max(self.c0, self.c1 - near))
            got = self.m.spans(self.data[start : t[1]], start)
            if found := self.m.joint(got, self.inner):
                k = int(np.searchsorted(got[1], t[0]))
                return got[0][found[0] + 1 :] if k < len(got[1]) and got[1][k] == t[0] and self._alone(got, k, t) else None, found[1] + 1
            if start <= self.c0:
                return ()
            near *= 4

    def _alone(self, got, k: int, s) -> bool:
        """Whether s is one piece of the segmentation, its k-th, or one unknown character, in bytes."""
        return got[1][k] == s[0] and (got[2][k] == s[1] or (self.data[s[0] : s[1]] not in self.m.ids and s[1] in got[2]))

    def run(self, i: int, j: int) -> np.ndarray | None:
        """The ids after state i up to state j, or None."""
        s, t, head, tail = self.ins[i], self.outs[j], self.head(i), self.tail(j)
        if head and tail and head[1] <= tail[1]:
            return None if head[0] is None or tail[0] is None else np.concatenate([head[0], self.inner[0][head[1] : tail[1]], tail[0]])
        a, b = s[0] if s else self.c0, t[1] if t else self.c1
        got = self.m.spans(self.data[a:b], a)
        k = int(np.searchsorted(got[2], s[1])) + 1 if s else 0
        ok = (not s or self._alone(got, 0, s)) and (not t or (t[0] in got[1] and self._alone(got, int(np.searchsorted(got[1], t[0])), t)))
        return got[0][k:] if ok else None

    def matrix(self) -> np.ndarray:
        out = np.full((len(self.ins), len(self.outs)), -np.inf)
        for i, head in enumerate(map(self.head, range(len(self.ins)))):
            for j, tail in enumerate(map(self.tail, range(len(self.outs)))):
                if head and tail and head[1] <= tail[1]:
                    if head[0] is not None and tail[0] is not None:
                        out[i, j] = self.m.score[head[0]].sum() + self.sums[tail[1]] - self.sums[head[1]] + self.m.score[tail[0]].sum()
                elif (ids := self.run(i, j)) is not None:
                    out[i, j] = self.m.score[ids].sum()
        return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1) if a.shape[1] else np.full((a.shape[0], b.shape[1]), -np.inf)


def _matrices(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(r.m).reshape(r.n_in, r.n_out) for r in pdf.sort_values("no").itertuples()]


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    all_ = _matrices(pdf)
    out = all_[0]
    for x in all_[1:]:
        out = product(out, x)
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "no": [pdf["no"].min() // FAN], "n_in": [out.shape[0]], "n_out": [out.shape[1]], "m": [out.tobytes()]})


def _parted(pdf: pd.DataFrame) -> pd.DataFrame:
    """The states at the cuts inside a group whose outer states are known."""
    pdf = pdf.sort_values("no")
    all_, i, j = _matrices(pdf), int(pdf["s"].iloc[0]), int(pdf["t"].iloc[0])
    best, back = all_[0][i], []
    for x in all_[1:]:
        sums = best[:, None] + x
        back.append(sums.argmax(axis=0))
        best = sums.max(axis=0)
    ends = [j]
    for x in reversed(back):
        ends.append(int(x[ends[-1]]))
    ends.reverse()
    return pd.DataFrame({"key": pdf["key"], "no": pdf["no"], "s": [i, *ends[:-1]], "t": ends})


def _states_at_cuts(matrices: DataFrame) -> DataFrame:
    """(key, no, s, t): for every chunk the indexes of its first and last state on the best run."""
    levels, most = [matrices], matrices.agg(F.max("no")).first()[0] or 0
    while most > 0:
        levels.append(written(levels[-1].groupBy("key", F.expr(f"no div {FAN}")).applyInPandas(_joined, MATRIX), "scan"))
        most //= FAN
    found = levels.pop().select("key", F.col("no").alias("group"), F.lit(0).alias("s"), F.lit(0).alias("t"))
    while levels:
        below = levels.pop().withColumn("group", F.expr(f"no div {FAN}"))
        found = below.join(found, ["key", "group"]).groupBy("key", "group").applyInPandas(_parted, "key binary, no long, s int, t int")
        found = found.withColumnRenamed("no", "group")
    return found.withColumnRenamed("group", "no")


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32))


def _chunks(model: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bpe.load(model)
        for batch, _, _ in T.blocks(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = m.raw(text)
                cuts = sorted({bpe.edge(data, c) for c in range(0, len(data), size)} | {len(data)})
                for no, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    lead, end = max(0, a - 2 * m.longest), bpe.edge(data, b + 2 * m.longest)
                    lead = bpe.edge(data, lead)
                    yield pa.RecordBatch.from_pylist([{"key": key, "no": no, "body": data[lead:end], "c0": a - lead, "c1": b - lead, "last": b == len(data)}])

    return run


def _matrix_rows(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bpe.load(model)
        for batch in batches:
            for r in batch.to_pylist():
                chunk = Chunk(m, r["body"], r["c0"], r["c1"], r["no"] == 0, r["last"])
                x, inner = chunk.matrix(), chunk.inner[0].astype(np.int32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([r["key"]], pa.binary()), pa.array([r["no"]], pa.int64()), pa.array([x.shape[0]], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([inner], pa.binary())], names=["key", "no", "n_in", "n_out", "m", "inner"])

    return run


def _backtrace(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bpe.load(model)
        for batch in batches:
            for r in batch.to_pylist():
                ids = Chunk(m, r["body"], r["c0"], r["c1"], r["no"] == 0, r["last"], r["inner"]).run(r["s"], r["t"])
                yield pa.RecordBatch.from_arrays([pa.array([r["key"]], pa.binary()), pa.array([r["no"]], pa.int64()), _lists([ids])], names=["key", "no", "ids"])

    return run


def encode(docs: DataFrame, model: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """Every document's ids as the model's library gives them: doc_id, n_bytes, n_chunks, text_hash, ids.

    Documents up to `giant` bytes are encoded where they are, without a shuffle. Larger texts are taken once each (equal
    texts share their work), split into chunk rows and dealt out; matrices, states and pieces are made chunk by chunk, so
    that no task needs a whole document until its ids are put together as one row.

    Null or empty text: no ids. Rows that repeat are encoded alike. An empty table gives no rows. Only doc_id and text are
    read, so other columns may have any names. text_hash is the xxhash64 of the text that decoding gives back, in which
    the blank mark U+2581 is a blank.
    """
    size = F.coalesce(F.octet_length(docs["text"]), F.lit(0))
    rows = docs.select(docs["doc_id"], docs["text"], size.cast("long").alias("n_bytes"), F.xxhash64(F.replace(F.coalesce(docs["text"], F.lit("")), F.lit(bpe.BLANK), F.lit(" "))).alias("text_hash"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bpe.load(model)
        for batch, _, _ in T.blocks(batches):
            ids = m.whole.encode([t or "" for t in batch.column(1).to_pylist()], num_threads=1)
            ends = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(ends.astype(np.int32), np.fromiter(itertools.chain.from_iterable(ids), np.int32, ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.ones(len(ids), np.int64)), batch.column(3), lists], names=["doc_id", "n_bytes", "n_chunks", "text_hash", "ids"])

    fields = f"doc_id {kind}, n_bytes bigint, n_chunks bigint, text_hash bigint, ids array<int>"
    if not bpe.load(model).cuttable:
        return rows.mapInArrow(direct, fields)
    large = rows.where(F.col("n_bytes") > giant).withColumn("key", F.unhex(F.sha2(F.col("text"), 256)))
    texts = large.select("key", "text").dropDuplicates(["key"])
    chunks = written(texts.mapInArrow(_chunks(model, chunk), "key binary, no long, body binary, c0 long, c1 long, last boolean"), "chunks")
    matrices = written(chunks.mapInArrow(_matrix_rows(model), f"{MATRIX}, inner binary"), "matrices")
    ends = _states_at_cuts(matrices.drop("inner"))
    parts = chunks.join(matrices.select("key", "no", "inner"), ["key", "no"]).join(ends, ["key", "no"]).mapInArrow(_backtrace(model), "key binary, no long, ids array<int>")
    whole = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts"))
    whole = whole.select("key", F.size("parts").cast("long").alias("n_chunks"), F.flatten(F.col("parts.ids")).alias("ids"))
    whole = written(whole, "ids")  # a table: then Spark can split the rows of a text that many have
    drop(chunks)
    drop(matrices)
    scanned = large.select("doc_id", "n_bytes", "text_hash", "key").join(whole, "key").select("doc_id", "n_bytes", "n_chunks", "text_hash", "ids")
    return rows.where(F.col("n_bytes") <= giant).mapInArrow(direct, fields).unionByName(scanned)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The rows with `decoded`, the text of their ids (null or empty: an empty text). `encoded` has no column of that name."""
    place = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bpe.load(model)
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                texts = m.whole.decode([x or [] for x in part.column(place).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])
        T.give_back()

    return encoded.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in [*encoded.dtypes, ("decoded", "string")]))
