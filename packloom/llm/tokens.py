"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from packloom.llm import bpe
from packloom.llm import text as T

#: Texts of more bytes are encoded in overlapping chunks of CHUNK bytes.
HUGE, CHUNK, OVERLAP = 1 << 15, 1 << 14, 256


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and n_chunks for every document, as the model's library counts.

    Rows are independent: no shuffle. A text of more than `huge` bytes is encoded in overlapping chunks, spliced at pieces
    that both chunks have (see bpe.Bpe), which bounds the work of one call; models whose normaliser changes texts take
    every text whole. Null or empty text: 0 bytes, 0 tokens. Rows that repeat count alike; no rows for an empty table;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bpe.load(model)
        for batch, _, offsets in T.blocks(batches):
            sizes = offsets[1:] - offsets[:-1]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            long = [m.cuttable and n > huge for n in sizes]
            counts = [0 if x else len(ids) for x, ids in zip(long, m.whole.encode(["" if x else t for t, x in zip(texts, long, strict=True)], num_threads=1), strict=True)]
            for i, x in enumerate(long):
                if x:
                    counts[i] = len(m.encode_long(m.raw(texts[i]), chunk, overlap))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts]), pa.array([-(-int(n) // chunk) if x else 1 for x, n in zip(long, sizes, strict=True)], pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks"])

    rows = docs.select(docs["doc_id"], docs["text"])
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chunks bigint")
