"""Edge cases of the pipeline operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from packloom.llm import bpe, chat, jaccard, media, mixing, pieces, quality, repeats, sharding, text, tokens, warc
from packloom.llm.common import components
from packloom.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, token string, node long, key string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(9000))
TEXTS = [None, "", " \n\t", "one", "One two three four", LONG, LONG, "a b c d e f g h " * 40, "#$% " * 30, "x" * 40_000, "é梦 " * 50, "same text here", "same text here"]


def table(spark, texts=TEXTS):
    rows = [(i, t, ["en", None][i % 2], [None, "s1", "s2"][i % 3], len(t or ""), 7, "t", 1, "k") for i, t in enumerate(texts)]
    rows += [(0, None, None, None, None, None, None, None, None), (4, TEXTS[4], "en", "s1", 1, 1, "", 1, ""), (None, "no id", "en", "s2", 1, 1, "", 1, "")] if rows else []
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


OPERATORS = {
    "encode": lambda d: pieces.decode(pieces.encode(d, tokenizer(), 1000, 300), tokenizer()), "shard": lambda d: sharding.rendezvous(d, [1.0] * 24), "mix": mixing.plan_mixture, "curriculum": mixing.curriculum, "quality": quality.judged,
    "keep_good": quality.keep_good, "tokens": lambda d: tokens.count_tokens(d, tokenizer(), huge=1000, chunk=400, overlap=32), "removals": lambda d: repeats.removals(d, 40), "without_repeats": lambda d: repeats.without_repeats(d, 40),
    "media": lambda d: media.features(media.stored(d)), "jaccard": lambda d: jaccard.classes(d, 3, 90), "keep_one": jaccard.keep_one,
}
PER_ROW = {"encode", "shard", "mix", "quality", "tokens", "removals", "without_repeats", "media", "jaccard"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_table(spark, name):
    d = table(spark)
    rows = OPERATORS[name](d).collect()
    assert len(rows) == d.count() if name in PER_ROW else 0 < len(rows) <= 3 * d.count()
    assert OPERATORS[name](table(spark, [])).collect() == []


def test_encoding_is_the_librarys(spark):
    m = bpe.load(tokenizer())
    texts = {i: t for i, t in enumerate(TEXTS)}
    for r in OPERATORS["encode"](table(spark)).where("doc_id is not null").collect():
        assert list(r.ids) == m.whole.encode(texts[r.doc_id] or "") and r.decoded == (texts[r.doc_id] or "")
    for r in OPERATORS["tokens"](table(spark)).where("doc_id is not null").collect():
        assert r.n_tokens == len(m.whole.encode(texts[r.doc_id] or ""))


def _fuzz(n):
    rng = random.Random(n)
    bits = ["the", " ", "  ", "a", "b", "an", "ing", "é", "梦", "\n", "①", "x", "1", "▁", "<s>", "aaaa", "    ", " t", "om"]
    for _ in range(n):
        yield "".join(rng.choice(bits) for _ in range(rng.randint(1, 120))) if rng.random() < 0.7 else rng.choice(["a", "ab", " ", "the", "①", " a"]) * rng.randint(1, 120)


def test_splices_and_scan_on_random_texts():
    m, rng = bpe.load(tokenizer()), random.Random(5)
    for t in _fuzz(60):
        want = m.whole.encode(t)
        assert list(m.encode_long(m.raw(t), rng.choice([16, 40]), rng.choice([4, 8]))) == want
        rows = [r for b in pieces._chunks(tokenizer(), rng.choice([30, 60]))(iter([pa.RecordBatch.from_pylist([{"key": b"k", "text": t}])])) for r in b.to_pylist()]
        chunks = [pieces.Chunk(m, r["body"], r["c0"], r["c1"], r["no"] == 0, r["last"]) for r in rows]
        left = [c.matrix() for c in chunks]
        whole = left[0]
        for x in left[1:]:
            whole = pieces.product(whole, x)
        assert whole.shape == (1, 1) and np.isclose(whole[0, 0], m.score[want].sum(), rtol=1e-9)


def test_sharding_moves_little(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("é").alias("text"))
    now = sharding.rendezvous(d, [1.0] * 24).collect()
    more = {r.doc_id: r.shard for r in sharding.rendezvous(d, [1.0] * 25).collect()}
    assert all(r.grown_shard == more[r.doc_id] and r.grown_shard in (r.shard, 24) for r in now) and 50 < sum(r.grown_shard == 24 for r in now) < 200
    for shard, n in Counter(r.shard for r in now).items():
        assert sorted(r.slot for r in now if r.shard == shard) == list(range(n))
    assert now[0].size == 10 and now[0].text_crc32 == zlib.crc32("é".encode())
    weighted = Counter(r.shard for r in sharding.rendezvous(d, [1.0, 3.0]).collect())
    assert 2.5 < weighted[1] / weighted[0] < 3.6


def test_mix_targets(spark):
    d = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 3}" if i % 50 else "tiny") for i in range(600)], "doc_id long, text string, source string")
    plan = mixing.plan_mixture(d).collect()
    by = {r.source_size: r.target for r in plan}
    assert abs(sum(by.values()) - sum(r.size for r in plan)) < 1e-6 and all(t <= 3 * s + 1e-9 for s, t in by.items())
    for s, t in by.items():
        assert abs(sum(r.taken for r in plan if r.source_size == s) - t) <= 7
    assert all(r.taken <= 3 * r.size and list(r.positions) == sorted(r.positions) and all(0 <= x <= 1.0001 for x in r.positions) for r in plan)
    assert mixing.curriculum(d).count() == sum(r.copies for r in plan)


def test_quality_keeps_clean_texts(spark):
    rng = random.Random(1)
    clean = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 999)) for _ in range(60)) for _ in range(200)]
    rows = [(i, t, "en", "s") for i, t in enumerate(clean)] + [(900, "#$% &|< " * 8 + clean[0], "en", "s"), (901, "short", "en", "s")]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[900] == (False, False) and got[901] == (True, False) and all(got[i] == (False, True) for i in range(200))


def _brute_removals(texts, least):
    data, seen = [(t or "").encode() for t in texts], Counter()
    for b in data:
        seen.update(b[i : i + least] for i in range(len(b) - least + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                gone[i : i + least] = [True] * least
        out.append((len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_removals_match_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé \n") for _ in range(300)) for _ in range(4)]
    part = lambda: (b := rng.choice(base))[(a := rng.randint(0, 250)) : a + rng.randint(10, 120)] if rng.random() < 0.5 else "".join(rng.choice("abcd") for _ in range(rng.randint(0, 80)))
    texts = ["".join(part() for _ in range(rng.randint(0, 4))) for _ in range(80)]
    texts += ["a" * 150, "ab" * 100, "abc" * 60 + "x", None, "", texts[0], texts[1], "a" * 39, "a" * 40, "a" * 41]
    got = repeats.removals(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), 40).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == _brute_removals(texts, 40)
    both = repeats.removals(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), 60, 40).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in both] == _brute_removals(texts, 60)
    assert [r.n_passage_bytes for r in both] == [r.n_removed for r in got] and all(len(r.kept_text.encode()) <= r.n_bytes - r.n_passage_bytes for r in both)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == g.kept_sha256 for r, g in zip(both, got, strict=True) if len(r.kept_text.encode()) == g.n_bytes - g.n_removed)


def test_removals_split_frequent_minimisers(spark, monkeypatch):
    rng = random.Random(8)
    some = lambda n, letters="abcdef": "".join(rng.choice(letters) for _ in range(n))
    passage, line = some(130), some(61)
    texts = [some(rng.randint(0, 60)) + passage[rng.randint(0, 20) : rng.randint(90, 130)] + some(rng.randint(0, 60)) for _ in range(60)]
    texts += [some(20, "ab") + line + some(20, "ab") for _ in range(60)] + [(some(3) + line[:50]) * 4 for _ in range(10)] + ["a" * 120, "ab" * 70, None, ""]
    for hot in (3, 40, 65_536):
        monkeypatch.setattr(repeats, "HOT", hot)
        got = repeats.removals(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), 60).orderBy("doc_id").collect()
        assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == _brute_removals(texts, 60)


@pytest.mark.parametrize("entries", [1, 3, 7, 16_384])
def test_rounds_over_blocks_of_the_order(monkeypatch, entries):
    monkeypatch.setattr(repeats, "ROUND", entries)
    rng = random.Random(entries)
    for _ in range(40):
        core, least, pieces = bytes(rng.choices(b"ab", k=24)), rng.randint(3, 16), []
        for _ in range(rng.randint(2, 25)):
            middle = bytearray(core)
            middle[rng.randrange(24)] = rng.choice(b"abc")
            lead = rng.randint(0, 9)
            pieces.append((bytes(rng.choices(b"ab", k=lead)) + middle + bytes(rng.choices(b"ab", k=rng.randint(0, 9))), lead))
        shift = [max(x for _, x in pieces) - lead for _, lead in pieces]
        found = lambda i, c: pieces[i][0][c - shift[i] : c - shift[i] + least] if 0 <= c - shift[i] <= len(pieces[i][0]) - least else None
        want = []
        for i, (data, _) in enumerate(pieces):
            at = [c for c in range(shift[i], shift[i] + len(data)) if found(i, c) and any(found(j, c) == found(i, c) for j in range(len(pieces)) if j != i)]
            firsts, lasts = [c for c in at if c - 1 not in at], [c for c in at if c + 1 not in at]
            want += [[i, a - shift[i], b - shift[i] + least] for a, b in zip(firsts, lasts, strict=True)]
        flat = np.frombuffer(b"".join(d for d, _ in pieces), np.uint8)
        assert repeats.repeated_columns(flat, np.array([len(d) for d, _ in pieces]), np.array([x for _, x in pieces]), least).tolist() == want


def test_one_minimisers_stretches_lie_in_files():
    rng = np.random.default_rng(1)
    core, schema = rng.bytes(300), pa.schema([("anchor", pa.int64()), ("bytes", pa.binary()), ("lead", pa.int32()), ("keys", pa.list_(pa.binary())), ("starts", pa.list_(pa.int64())), ("several", pa.bool_())])

    def batches():
        for a in range(0, 3000, 500):
            yield pa.RecordBatch.from_pylist([{"anchor": 7, "bytes": rng.bytes(150) + core + rng.bytes(150), "lead": 300, "keys": [b"%d" % i], "starts": [i], "several": False} for i in range(a, a + 500)], schema=schema)

    tracemalloc.start()
    got = [tuple(r.values()) for b in repeats._repeated(100)(batches()) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [k for k, _, _ in got] == [b"%d" % i for i in range(3000)] and all(a <= i + 150 and b >= i + 450 for i, (_, a, b) in enumerate(got)) and peak < 60e6, peak


def test_minimizers_of_texts_beyond_the_place_bits(monkeypatch):
    rng = np.random.default_rng(4)
    data, offsets, least = rng.integers(97, 101, 5000, dtype=np.uint8), np.array([0, 900, 900, 4200, 5000]), 60
    each = lambda x: [(s, p, h) for a, b, p, h in zip(*x, strict=True) for s in range(a, b + 1)]
    want = each(repeats.minimizers(data, offsets, least))
    monkeypatch.setattr(repeats, "PLACE_BITS", 10)
    assert each(repeats.minimizers(data, offsets, least)) == want and len(want) == 5000 - 3 * 59


def test_jaccard_blocks_and_classes(spark, monkeypatch):
    rng = random.Random(2)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(80)] for _ in range(6)]
    texts = []
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 5)}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(78)} for t in texts]
    root = list(range(len(sets)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = [(len(s), find(i)) for i, s in enumerate(sets)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (4_000_000, 500):
        monkeypatch.setattr(jaccard, "BLOCK_TOKENS", block)
        assert [(r.n_shingles, r.component_id) for r in jaccard.classes(d, 3, 90).orderBy("doc_id").collect()] == want


def test_jaccard_chance_offers_make_no_large_part(spark, monkeypatch):
    """Each text has a passage of its neighbour's, so all of them are connected by common offers, but none can be linked by so few."""
    own = [[f"{i}_{j}" for j in range(150)] for i in range(60)]
    docs = [(i, " ".join(own[i] + own[(i + 1) % 60][:60])) for i in range(60)]
    docs += [(100 + i, t + " x") for i, t in docs[:10]] + [(200, docs[0][1] + " y")]
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    monkeypatch.setattr(jaccard, "_classes_of_large_parts", lambda large, percent: pytest.fail(f"{large.count()} sets in large parts"))
    got = jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string"), 5, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 0 if i == 200 else i % 100 for i, _ in docs}


def test_chunks_are_segmented_once(monkeypatch):
    """The way back takes the pieces that the matrices were made of: only what lies about its two ends is encoded again."""
    m, sizes = bpe.load(tokenizer()), []
    data = m.raw("some words of a long text, one after the other. " * 400)
    whole = pieces.Chunk(m, data, 0, 8192, True, False)
    runs = [j for j, x in enumerate(whole.matrix()[0]) if np.isfinite(x)]
    monkeypatch.setattr(bpe.Bpe, "encode", lambda self, x, f=bpe.Bpe.encode: sizes.append(len(x)) or f(self, x))
    again = pieces.Chunk(m, data, 0, 8192, True, False, whole.inner[0].astype(np.int32).tobytes())
    assert runs and all(again.run(0, j).tolist() == whole.run(0, j).tolist() for j in runs) and max(sizes) < 2000


def test_minimizers_of_every_window():
    """Against the least hash of each window, one by one, with empty and short rows between."""
    rng = np.random.default_rng(3)
    sizes = [0, 300, 30, 0, 0, 150, 64, 63, 1, 0]
    data, offsets, least = rng.integers(97, 101, sum(sizes), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)]), 64
    at = np.arange(len(data) - repeats.K + 1)
    hashes = text.Rolling(data).of(at, at + repeats.K)
    assert (text.Rolling(data).every(repeats.K) == hashes).all()
    want = {s: s + int(np.argmin(hashes[s : s + least - repeats.K + 1] >> np.uint64(repeats.PLACE_BITS))) for a, b in zip(offsets, offsets[1:]) for s in range(a, b - least + 1)}
    first, last, place, _ = repeats.minimizers(data, offsets, least)
    assert {s: int(p) for a, b, p in zip(first, last, place) for s in range(a, b + 1)} == want


def test_jaccard_least_shared_offers(spark):
    """Linked sets share as many offers as _least_shared says, for differences spread as evenly as they can be, and by chance."""
    rng = np.random.default_rng(7)
    for percent in (80, 90):
        rows = []
        for n in range(40, 700, 60):
            for evenly in (True, False):
                union = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                differ = n - -(-percent * n // 100)
                at = np.linspace(0, n - 1, differ).astype(int) if evenly else rng.choice(n, differ, replace=False)
                a, b = np.delete(union, at[::2]), np.delete(union, at[1::2])
                shared = len(np.intersect1d(jaccard.offers(a, percent), jaccard.offers(b, percent)))
                rows.append((len(a) + len(b), shared))
        d = spark.createDataFrame(rows, "total long, shared long").withColumn("least", jaccard._least_shared(percent, F.col("total")))
        assert d.where("shared < least").count() == 0 and d.agg(F.max("least")).first()[0] > 10


def test_jaccard_shared_and_missing_ids(spark):
    w = [[f"{k}{i}" for i in range(60)] for k in "abcdef"]
    near = lambda x, *at: [f"v{i}" if i in at else y for i, y in enumerate(x)]
    words = [(1, w[0]), (1, w[1]), (5, near(w[0], 59)), (7, near(w[1], 59)), (1, w[2]), (9, near(w[2], 0))]
    words += [(20, near(w[3], 0, 1)), (None, near(w[3], 0)), (None, w[3]), (22, near(w[3], 59)), (None, w[4]), (30, near(w[4], 59)), (None, w[5])]
    sets = [{tuple(x[i : i + 3]) for i in range(58)} for _, x in words]
    label = list(range(len(words)))
    for _ in words:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 95 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    least = {k: min((d for (d, _), x in zip(words, label, strict=True) if x == k and d is not None), default=None) for k in label}
    want = Counter((d, 58, least[k]) for (d, _), k in zip(words, label, strict=True))
    got = jaccard.classes(spark.createDataFrame([(d, " ".join(x)) for d, x in words], "doc_id long, text string").repartition(3), 3, 95)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 51), (60, 60)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 51: 50}


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://a/{i}", h) for i, h in enumerate(["<p>x</p>" * 50, None, "", "<p>x</p>" * 50, "é"] + [f"<i>{i}</i>" * 20 for i in range(60)])] + [(None, None, "é"), (None, None, "only")]
    listed = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read_archives(listed).collect() if r.page_id is not None}
    assert len(got) == 65 and (got[3].record_type, got[3].refers_to, got[3].payload_bytes, got[3].payload_digest) == ("revisit", 0, 400, got[0].payload_digest)
    assert (got[2].record_type, got[2].refers_to, got[1].record_type, got[4].payload) == ("revisit", 1, "response", "é".encode())
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_warc_checks():
    records = [warc.record(i, None, (f"<p>{i}</p>" * 80).encode(), None) for i in range(300)]
    data = warc.pack(records)
    assert data[:4] == bytes.fromhex("5d2a4d18") and [r for _, r in warc.frames(data)] == records
    assert [r for _, r in warc.frames(warc.pack(records[:1]))] == records[:1]
    for broken in (data[:-3], data + b"junk", data[:8] + b"x" * 16):
        with pytest.raises(warc.InvalidArchive):
            list(warc.frames(broken))
    for bad in (records[0][:-1], records[0].replace(b"Content-Length: ", b"Content-Length: 1", 1), records[0].replace(b"<p>", b"<b>", 1), b"HTTP/1.1"):
        with pytest.raises(warc.InvalidArchive):
            warc.parse(bad)


def test_media_forms_and_carving():
    payload = bytes(range(256)) * 9
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 128, 0, 0]) + bytes(6) + b"," + bytes([0, 0, 0, 0, 1, 0, 1, 0, 0]) + bytes([2, 2, 76, 1, 0]) + b";"
    for kind, make in media.FORMS.items():
        form = make(payload)
        assert media.samples(form, kind) == payload
        blob = b"BM text RIFF \x89PNG " + form + b" tail " + gif
        assert media.sniff(blob)[1] == [(18, len(form), kind), (18 + len(form) + 6, len(gif), "image/gif")]
        assert media.sniff(form[:-1])[1] == []


def test_preference_pairs(spark):
    rows = [(1, 0, 0, "user", "q"), (1, 0, 1, "assistant", "yes"), (1, 1, 0, "user", "q"), (1, 1, 1, "assistant", "no"), (2, 0, 0, None, None), (3, 0, 0, "user", "s"), (3, 1, 0, "user", "s"), (None, 0, 0, "user", "x"), (4, 1, None, "user", "late"), (4, 1, 3, "user", "early")]
    got = {r.pair_id: r for r in chat.preference_pairs(spark.createDataFrame(rows, "pair_id long, side int, turn long, role string, text string")).collect()}
    assert got[1].prompt == "<|user|>\nq<|end|>\n" and got[1].chosen == "<|assistant|>\nyes<|end|>\n" and got[1].rejected_mask == "14:10"
    assert got[1].chosen[14:25] == "yes<|end|>\n" and (got[2].rejected, got[2].prompt, got[3].chosen, got[3].rejected) == (None, "", "", "")
    assert got[4].rejected.index("early") < got[4].rejected.index("late") and set(got) == {1, 2, 3, 4}
    assert chat.preference_pairs(spark.createDataFrame([], "pair_id long, side int, turn long, role string, text string")).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), out.schema)
        else:
            assert out.count() == docs.count() and out.where("not round_trip").count() == 0
    assert 0 < docs.select("doc_id").distinct().count() < n
