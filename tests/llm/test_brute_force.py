"""The queries and the pipeline's stages against plain Python over whole small tables, and against their SQL."""

import base64
import glob
import hashlib
import io
import math
import os
import random
import struct
import wave
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

from packloom.llm import jaccard, media, mixing, quality, queries, repeats, sharding, warc

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, nth long, _nth long"
ODD = [None, "", " \n\t ", "one", "Two words", "x" * 3000, "é梦 " * 40, "a b c d e f g h " * 30]


def words(text):
    out, one = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            out, one = out + [one] * bool(one), ""
        else:
            one += c
    return out + [one] * bool(one)


def shingles(text, n):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def classes_of(texts, n, percent):
    """For each text a number of its class, or None without words."""
    sets, label = [shingles(t, n) for t in texts], list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return [find(i) if s else None for i, s in enumerate(sets)]


def read(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def saved(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, db, name):
    got, want = queries.QUERIES[name](spark, SF), db.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


def _shards(rows, n):
    """(doc_id, size, crc32, shard, slot, grown_shard) of op2 for (doc_id, text)."""

    def score(key, shard):
        h = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), h)
        return -math.log(((h >> 11) + 0.5) * 2.0**-53)

    out, members = [], defaultdict(list)
    for key, text in rows:
        body, scores = (text or "").encode(), [score(key, s) for s in range(n + 1)]
        shard = min(range(n), key=lambda s: (scores[s], s))
        h = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<q", len(body) + 8), xxhash.xxh64_intdigest(struct.pack("<q", zlib.crc32(body)), h))
        piece = xxhash.xxh64_intdigest(b"piece", h) % sharding.PIECES
        members[shard].append((piece, key is not None, key or 0, zlib.crc32(body), len(body) + 8))
        out.append([key, len(body) + 8, zlib.crc32(body), shard, None, n if scores[n] < scores[shard] else shard])
    for shard, own in members.items():
        for slot, (_, has, key, crc, size) in enumerate(sorted(own)):
            next(r for r in out if r[:4] == [key if has else None, size, crc, shard] and r[4] is None)[4] = slot
    return Counter(map(tuple, out))


def test_sharding_matches_brute_force(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in read(spark, "documents").collect()]
    odd = [*rows[:40], *enumerate(ODD), (3, "again"), (3, "again"), (None, "no id"), (None, None)]
    for i, table in enumerate((rows, odd, [])):
        sf = saved(spark, tmp_path / str(i), "documents", table, "doc_id long, text string")
        got = queries.op2_rendezvous_shards(spark, sf).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot, r.grown_shard) for r in got) == _shards(table, 24)
        assert {r.law for r in got} <= {"key"}


def test_warc_matches_brute_force(spark, tmp_path):
    rows = [tuple(r) for r in read(spark, "pages").select("page_id", "url", "html").collect()]
    odd = [(i, None if i % 4 else f"http://x/{i}\r\nX: y", t) for i, t in enumerate([*ODD, *ODD, "é" * 100_000])]
    for i, table in enumerate((rows + [(r[0] + 10_000, r[1], r[2]) for r in rows[:20]], odd, [])):
        sf = saved(spark, tmp_path / str(i), "pages", table, "page_id long, url string, html string")
        first = {}
        for page, _, html in sorted(table, key=lambda r: r[0]):
            first.setdefault(html or "", page)
        want = set()
        for page, _, html in table:
            body, of = (html or "").encode(), first[html or ""]
            want.add((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if of == page else "revisit", None if of == page else of))
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op6_zstd_warc(spark, sf).collect()]
        assert len(got) == len(table) and set(got) == want
        listed = warc.write_archives(read(spark, "pages", sf))
        assert {(r.page_id, r.payload) for r in warc.read_archives(listed).collect() if r.record_type == "response"} == {(p, (h or "").encode()) for p, _, h in table if first[h or ""] == p}


def test_broken_archives_are_named(spark, tmp_path):
    records = [warc.record(i, None, (f"<p>{i}</p>" * 80).encode(), None) for i in range(300)]
    data = warc.pack(records)
    skip = lambda size, there: struct.pack("<II", 0x184D2A50, size) + bytes(there)
    assert [r for _, r in warc.frames(data + skip(9, 9) + data[8 + struct.unpack("<I", data[4:8])[0] :])] == records * 2
    for broken in (data[:-3], data + b"junk", data[:8], data[:6], data + skip(9, 8), data + skip(1 << 31, 0), data + b"\x50\x2a\x4d\x18\x01"):
        with pytest.raises(warc.InvalidArchive):
            list(warc.frames(broken))
    for old, new in ((b"Content-Length: ", b"Content-Length: x"), (b"Content-Length: ", b"Content-Length: -"), (b"<urn:page:7>", b"<urn:page:seven>"), (b"WARC/1.1", b"WARC/0.9"), (b"WARC-Type: response", b"WARC-Type: other"), (b"WARC-Date", b"\xff\xfe")):
        with pytest.raises(warc.InvalidArchive):
            warc.parse(records[7].replace(old, new, 1))
    path = tmp_path / "a.warc.zst"
    path.write_bytes(warc.pack([records[0], records[1].replace(b"Content-Length: ", b"Content-Length: x", 1)]))
    with pytest.raises(Exception, match=r"a\.warc\.zst, record 1, at .*content-length is no number"):
        warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}", str(path), 2)], "folder string, path string, n_records long")).collect()


def _samples(blob, kind):
    """The media file's samples, read with other code than the operator's."""
    if kind == "audio/wav":
        with wave.open(io.BytesIO(blob)) as w:
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1)
            return w.readframes(w.getnframes())
    if kind == "image/bmp":
        size, start, width, height = (struct.unpack_from("<i", blob, i)[0] for i in (2, 10, 18, 22))
        assert size == len(blob) and len(blob) - start == width * -height
        return blob[start:]
    assert kind == "image/png" and blob[16:24] == struct.pack(">II", 576, len(raw := zlib.decompress(blob[41 : 41 + struct.unpack(">I", blob[33:37])[0]])) // 577)
    return b"".join(raw[i + 1 : i + 577] for i in range(0, len(raw), 577))


def test_media_match_brute_force(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in read(spark, "documents").collect()]
    odd = [*enumerate(ODD), (3, "again"), (None, "no id"), (9, "RIFF BM GIF89a \x89PNG"), (10, "y" * 576), (11, "long é " * 300_000)]
    for i, table in enumerate((rows, odd, [])):
        sf = saved(spark, tmp_path / str(i), "documents", table, "doc_id long, text string")
        want, payloads = Counter(), {}
        for doc_id, text in table:
            body = (text or "").encode()
            payload = body + b"\xff" * (-len(body) % 576 if body else 576)
            payloads[hashlib.sha256(payload).hexdigest()] = payload
            want[doc_id, len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
        got = queries.op8_media_sniffing(spark, sf).collect()
        assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
        blobs = {hashlib.sha256(b := bytes(r.media)[a : a + n]).hexdigest(): (b, kind) for r in media.stored(read(spark, "documents", sf)).collect() for a, n, kind in media.sniff(bytes(r.media))[1]}
        for r in got:
            blob, kind = blobs[r.media_sha256]
            payload, (said, told, start, hits, found, total, high) = payloads[r.payload_sha256], r.feature.split(";")
            assert _samples(blob, kind) == payload and len(blob) == r.media_bytes and said == kind
            assert (int(total), int(high)) == (sum(payload), sum(x > 127 for x in payload)) and int(hits) >= int(found) >= 1 and (int(start) == 0 or int(hits) > 3)
        assert not got or {r.feature.split(";")[1][:8] for r in got} == {"declared", "correcte"}


def _measured(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(lines)


def _good(rows):
    """Which (text, lang, source) the quality rules keep: quantiles of the rates' buckets, by group, language or all."""
    log = math.log(quality.GAMMA)
    bucket = lambda x: -10_000 if x == 0 else math.ceil(math.log(x) / log)
    value = lambda b: 0.0 if b == -10_000 else 2 * quality.GAMMA**b / (quality.GAMMA + 1)
    judged, groups = [], defaultdict(list)
    for text, lang, source in rows:
        n, chars, symbols, dup, rep, lines = _measured(text)
        rates, failed = (symbols / chars if chars else 0, dup / lines if lines else 0, chars / n if n else 0), n < 20 or 100 * rep > 30 * n
        judged.append((failed, rates, lang, source))
        if not failed:
            for k in ((lang, source), lang, "all"):
                groups[str(k), isinstance(k, tuple)].append(rates)
    out = []
    for failed, rates, lang, source in judged:
        own = next((g for g in (groups[str((lang, source)), True], groups[str(lang), False]) if len(g) >= 50), groups["all", False])
        ok = not failed
        for i, least in enumerate((0.01, 0.1, 0.5)):
            if ok:
                b = sorted(bucket(r[i]) for r in own)
                q1, q3 = (value(b[math.ceil(q * len(b) / 4) - 1]) for q in (1, 3))
                reach = 6 * max(q3 - q1, least)
                ok = q1 - reach <= rates[i] <= q3 + reach
        out.append(ok)
    return out


def _documents(spark, seed):
    """Whole small documents and odd ones, with repeated, shared and missing ids, and columns that operators use inside."""
    rng = random.Random(seed)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in read(spark, "documents").collect()]
    rows += [(900 + i, "#$% " * 30 + t[:200], "en", "s1") for i, (_, t, _, _) in enumerate(rows[:3])] + [(800 + i, t, None, None) for i, t in enumerate(ODD)]
    rows += [(rows[3][0], rows[4][1], "en", "s1"), (None, rows[5][1], "en", "s2"), (None, rows[6][1] + " more", "en", "s2"), rows[7], rows[7], (None, None, None, None)]
    rows += [(None, "alone without any number " + " ".join(f"q{rng.random()}" for _ in range(40)), "en", "s1")]
    return [(a, b, c, d, len(b or ""), rng.randrange(3), 1) for a, b, c, d in rows]


def test_keep_good_matches_brute_force(spark):
    rows = _documents(spark, 1)
    got = quality.keep_good(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want = Counter(r for r, ok in zip(rows, _good([r[1:4] for r in rows]), strict=True) if ok)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "nth", "_nth"] and Counter(map(tuple, got.collect())) == want and len(want) > 100


@pytest.mark.parametrize("name", ["op3_curriculum_mix", "op4_adaptive_quality"])
@pytest.mark.parametrize("some", [True, False])
def test_sql_on_odd_rows(spark, tmp_path, name, some):
    rows = _documents(spark, 4)[-40:] if some else []
    sf, con = saved(spark, tmp_path, "documents", rows, SCHEMA), duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLES[name])
    order = [want.columns.index(c) for c in got.columns]
    found = sorted(map(str, map(tuple, got.collect())))
    assert found == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall()) and len(found) == len(rows)


def test_curriculum_gives_rows_as_planned(spark):
    rows = _documents(spark, 5)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mixing.curriculum(docs)
    mixed = [tuple(r) for r in got.collect()]
    plan = mixing.plan_mixture(docs, keep=tuple(docs.columns)).collect()
    assert got.columns == docs.columns and Counter(mixed) == Counter({k: v for k, v in sum((Counter({tuple(r.kept): r.copies}) for r in plan), Counter()).items() if v})
    at = defaultdict(list)
    for r in plan:
        at[tuple(r.kept)] += r.positions
    at = {k: sorted(v, reverse=True) for k, v in at.items()}
    places = [at[r].pop() for r in mixed]
    assert places == sorted(places) and all(0 <= x <= 1 + 1e-9 for x in places)


@pytest.mark.parametrize("n,percent", [(5, 80), (3, 90), (2, 50)])
def test_keep_one_and_classes_match_brute_force(spark, n, percent):
    rows = _documents(spark, 2)
    label = classes_of([r[1] for r in rows], n, percent)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    members = defaultdict(list)
    for r, k in zip(rows, label, strict=True):
        members[k].append(r)
    got = jaccard.keep_one(docs, n, percent)
    kept = [tuple(r) for r in got.collect()]
    assert got.columns == docs.columns and not Counter(kept) - Counter(rows)
    of = dict(zip(rows, label, strict=True))
    assert Counter(r for r in kept if of[r] is None) == Counter(members[None])
    chosen = {of[r]: r for r in kept if of[r] is not None}
    assert len(chosen) == sum(of[r] is not None for r in kept) == len(members) - 1
    least = {k: min((r[0] for r in m if r[0] is not None), default=None) for k, m in members.items()}
    assert all(r[0] == least[k] for k, r in chosen.items())
    want = Counter((r[0], len(shingles(r[1], n)), r[0] if k is None else least[k]) for r, k in zip(rows, label, strict=True))
    assert Counter(map(tuple, jaccard.classes(docs, n, percent).select("doc_id", "n_shingles", "component_id").collect())) == want


def test_hubs_and_blocks_lose_no_link(spark, monkeypatch):
    rng = random.Random(6)
    base = [[f"w{rng.randint(0, 99)}" for _ in range(rng.choice([30, 45, 60]))] for _ in range(4)]
    texts = []
    for i in range(150):
        w = list(base[i % 4 if i < 60 else 0])
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 9)}"
        texts.append(" ".join(w[: len(w) - rng.randint(0, 6)]))
    for percent in (50, 80):
        want = classes_of(texts, 2, percent)
        for block in (300, 2000):
            monkeypatch.setattr(jaccard, "BLOCK_TOKENS", block)
            got = jaccard.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2, percent)
            assert [r.component_id for r in got.orderBy("doc_id").collect()] == want


def test_unlike_words_of_equal_weak_hashes_stay_apart(spark):
    signs = b"\0"
    while len(signs) < 4096:
        signs += bytes(1 - x for x in signs)
    one, other = ("".join("ab"[x ^ y] for x in signs) for y in (0, 1))
    rows = [(1, one), (2, other), (3, one.upper())]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == [1, 2, 1]
    lines = spark.createDataFrame([(1, f"{one}\n{other}\n{one}", "en", "s")], "doc_id long, text string, lang string, source string")
    assert quality.measure(lines).first().n_dup_lines == 1


@pytest.mark.parametrize("least", [40, 200])
def test_without_repeats_matches_brute_force(spark, least):
    rows = _documents(spark, 3)
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    want = Counter()
    for r, t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        rest = bytes(x for x, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
        text = None if r[1] is None else rest
        want[(r[0], text, r[2], r[3], len(rest), *r[5:])] += 1
    got = repeats.without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), least)
    assert Counter(map(tuple, got.collect())) == want
