"""SentencePiece models of the BPE kind: their vocabulary, and encoding of huge texts from pieces of them.

A BPE segmentation has a local test: a sequence of pieces is the segmentation of its text exactly if each pair of
neighbours is the segmentation of their joined text. So two segmentations of overlapping stretches that have a piece in
common (same place, same end) can be joined there: left of it all pairs come from one, right of it from the other.
Pieces made of blanks alone have equal scores in some models, and are not used as such joints.
"""

from __future__ import annotations

import functools

import numpy as np
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

BLANK = "▁"


class Bpe:
    def __init__(self, path: str):
        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        #: Only where texts are taken as they are can a text be cut before it is normalised.
        self.cuttable = proto.trainer_spec.model_type == 2 and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and proto.trainer_spec.byte_fallback and not proto.trainer_spec.treat_whitespace_as_suffix
        self.prefix = b" " if spec.add_dummy_prefix else b""
        spec.add_dummy_prefix = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        n = self.plain.get_piece_size()
        pieces = [self.plain.id_to_piece(i) for i in range(n)]
        raw = [b"?" if self.plain.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.length = np.array([len(x) for x in raw], np.int64)
        self.blank = np.array([not x.strip(b" ") for x in raw])
        self.score = np.array([self.plain.get_score(i) for i in range(n)])
        self.ids = {x: i for i, x in enumerate(raw) if not (self.plain.is_byte(i) or self.plain.is_control(i) or self.plain.is_unknown(i))}
        self.longest = max(map(len, self.ids))

    def raw(self, text: str) -> bytes:
        """The bytes that are segmented: a blank before the text, and the mark for blanks as a blank."""
        return self.prefix + text.replace(BLANK, " ").encode() if text else b""

    def encode(self, data: bytes) -> np.ndarray:
        return np.array(self.plain.encode(data.decode()), np.int64) if data else np.zeros(0, np.int64)

    def spans(self, data: bytes, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, begins and ends of the pieces of a stretch that starts at byte `at`."""
        return self.placed(self.encode(data), at)

    def placed(self, ids: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for pieces that are known."""
        ends = at + np.cumsum(self.length[ids])
        return ids, ends - self.length[ids], ends

    def joint(self, left, right, last: bool = True) -> tuple[int, int] | None:
        """Indexes of a piece, not of blanks alone, that both segmentations have at one place; the last or the first one."""
        ids, begins, ends = left
        key = lambda b, e: (b << 8) | (e - b)
        _, i, j = np.intersect1d(key(begins, ends), key(right[1], right[2]), assume_unique=True, return_indices=True)
        ok = ~self.blank[ids[i]]
        return (int(i[ok][-1 if last else 0]), int(j[ok][-1 if last else 0])) if ok.any() else None

    def encode_long(self, data: bytes, chunk: int, overlap: int) -> np.ndarray:
        """The ids of a long stretch from overlapping chunks of it. Where two chunks have no piece in common, the overlap is doubled; at last both are encoded as one."""
        start, stop = 0, edge(data, chunk)
        left, done = self.spans(data[:stop], 0), []
        while stop < len(data):
            wide = overlap
            while True:
                a, b = max(start, edge(data, stop - wide)), edge(data, stop + chunk)
                right = self.spans(data[a:b], a) if a > start else self.spans(data[start:b], start)
                if a <= start:
                    left = right
                    break
                if found := self.joint(left, right):
                    i, j = found
                    done.append(left[0][: i + 1])
                    start = int(left[2][i])
                    left = tuple(x[j + 1 :] for x in right)
                    break
                wide *= 2
            stop = b
        return np.concatenate([*done, left[0]])


def edge(data: bytes, at: int) -> int:
    """The first place from `at` on where a character starts."""
    at = max(0, at)
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(data))


@functools.lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)
