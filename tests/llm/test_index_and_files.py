"""Search, archives, token files, BPE: against brute force, exact round trips and damage."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vellum.llm import bpe, forest, records, warc
from vellum.llm.shared import over, pack_arrays, partition_keys, rolling, sliding_argmin, task, unpack_arrays, words

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


# Shared parts:
def test_rolling_and_argmin():
    v = np.random.default_rng(0).integers(0, 2**63, 300, dtype=np.uint64)
    for k in (1, 2, 5, 13, 32):
        base, want = 7, []
        for i in range(len(v) - k + 1):
            h = 0
            for x in v[i : i + k].tolist():
                h = (h * base + x) % 2**64
            want.append(h)
        assert rolling(v, k, base).tolist() == want
    x = np.random.default_rng(1).integers(0, 9, 200).astype(np.uint64) << np.uint64(32)
    assert sliding_argmin(x, 7).tolist() == [i + int(np.argmin(x[i : i + 7])) for i in range(194)]


def test_words_split_as_the_pattern_says():
    texts = [b"foo  bar\n", b"", b"baz\x1cq", b" \t", b"end"]
    off = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    s, e, before = words(data, off)
    assert [bytes(data[a:b]) for a, b in zip(s, e)] == [b"foo", b"bar", b"baz\x1cq", b"end"]
    assert before.tolist() == [0, 2, 2, 3, 3, 4]


def test_packing_and_keys(spark):
    arrays = [np.arange(5, dtype=np.uint64), np.array([3], np.int32), np.zeros(0, np.uint8)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, unpack_arrays(pack_arrays(*arrays))))
    keys = partition_keys(13)
    got = spark.createDataFrame([(int(k),) for k in keys], "k int").repartition(13, "k").rdd.glom().map(lambda p: [r.k for r in p]).collect()
    assert [p[0] for p in got] == keys.tolist()


# Nearest neighbours:
def brute(ids, vs, q, k):
    s = vs @ vs[q]
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(s[i])) for i in order]


def test_forest_recall_order_and_scores(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((3000, 32)).astype(np.float32)
    v[100:110] = v[50]  # ties
    d = spark.createDataFrame([(i, x.tolist(), "q") for i, x in enumerate(v)], "vec_id long, embedding array<float>, block string")
    got: dict[int, list] = {}
    for r in sorted(forest.nearest(d, d.where("vec_id % 50 = 0")).collect()):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    exact = v.astype(np.float64)
    hits = total = 0
    for q in range(0, 3000, 50):
        want = brute(np.arange(3000), exact, q, 20)
        assert [r[0] for r in got[q]] == list(range(1, 21))
        assert [r[2] for r in got[q]] == sorted((r[2] for r in got[q]), reverse=True)
        assert all(abs(s - exact[i] @ exact[q]) < 1e-9 for _, i, s in got[q])
        hits += len({r[1] for r in got[q]} & {i for i, _ in want})
        total += 20
    assert hits / total >= 0.9
    assert [i for _, i, _ in got[50]][:10] == list(range(100, 110))


def test_recall_on_the_given_vectors_over_several_shards(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in d.collect() if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got: dict[int, set] = {}
    for r in forest.nearest(d, d.where("vec_id % 20 = 0"), shard=max(1, len(rows) // 4)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0).tolist():
        want = {i for i, _ in brute(ids, v, q, 20)}
        hits, total = hits + len(want & got[int(ids[q])]), total + len(want)
    assert total and hits / total >= 0.9


def test_forest_lengths_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 3.0]), (2, [2.0, 1.0]), (3, [1.0, 1.0, 1.0]), (4, [2.0, 0.0, 0.0])] + [(2, [2.0, 1.0])] * 5
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, forest.nearest(d, d).collect())) == [(1, 1, 2, 3.0), (2, 1, 1, 3.0), (3, 1, 4, 2.0), (4, 1, 3, 2.0)]


def test_forest_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [2.0, 1.0]), (8, []), (7, [2.0, 1.0]), (None, [1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in forest.nearest(d, d).collect()) == [(1, 1, 7, 2.0), (7, 1, 1, 2.0)]
    assert forest.nearest(d.limit(0), d).count() == 0


# Archives:
def test_archives_round_trip(spark):
    long = "<p>" + "é" * 200
    rows = [(3, "u", long, "x"), (1, None, long, "y"), (2, "u\r\nv", long, "z"), (4, "u", "short", ""), (5, "u", "short", ""), (6, "u", None, ""), (7, "u", "", ""), (None, "u", long, ""), (1, "u", long, "")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(spark, d).collect()), key=str)
    n, h = len(long.encode()), hashlib.sha256(long.encode()).hexdigest()
    short = (5, hashlib.sha256(b"short").hexdigest(), "response", None)
    none = (0, hashlib.sha256(b"").hexdigest(), "response", None)
    assert got == sorted([(1, n, h, "response", None), (1, n, h, "response", None), (2, n, h, "revisit", 1), (3, n, h, "revisit", 1), (4, *short), (5, *short), (6, *none), (7, *none), (None, n, h, "response", None)], key=str)
    assert warc.archive_round_trip(spark, d.limit(0)).count() == 0


def record(i: int) -> bytes:
    p = f"payload {i} ".encode() * 20
    return warc.record_bytes(i, "http://x", p, hashlib.sha256(p).hexdigest(), None)


def test_salvage_goes_on_after_damage():
    a, b, c = map(record, (1, 2, 3))
    plain = zlib.decompress(record(4), 31)
    spoiled = bytearray(b)
    spoiled[len(b) // 2] ^= 0xFF
    s = warc.Salvage(a + bytes(spoiled) + b"junk" + c + plain + a[:30])
    got = list(s)
    assert [r.headers["warc-record-id"] for r in got] == ["<urn:page:1>", "<urn:page:3>", "<urn:page:4>"]
    assert [(g.offset, g.length) for g in s.gaps] == [(len(a), len(b) + 4), (len(a) + len(b) + 4 + len(c) + len(plain), 30)]


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 2))
def test_salvage_keeps_what_is_whole(junk, where):
    parts = [record(1), record(2)]
    parts.insert(where, junk)
    s = warc.Salvage(b"".join(parts))
    assert len(list(s)) == 2 and sum(g.length for g in s.gaps) == len(junk)


def test_members_of_several_records_and_other_digests():
    import base64

    plain = [zlib.decompress(record(i), 31) for i in (1, 2)]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    s = warc.Salvage(squeeze.compress(b"".join(plain) + b"rest") + squeeze.flush() + record(3))
    assert len(list(s)) == 3 and len(s.gaps) == 1 and "after 2 records" in s.gaps[0].reason
    p = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>x</p>"
    sha = "sha1:" + base64.b32encode(hashlib.sha1(b"<p>x</p>").digest()).decode()
    head = lambda d: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Payload-Digest: {d}\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {len(p)}\r\n\r\n".encode() + p + b"\r\n\r\n"
    assert len(list(warc.Salvage(head(sha)))) == 1 and len(list(warc.Salvage(head("sha1:" + "A" * 32)))) == 0
    assert "WARC-Date: " in plain[0].decode()


def test_revisits_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = [(i, "u", ("x" * 200 if i % 3 else "short")) for i in range(30)]
    got = warc.archive_round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 30 and sorted(r.page_id for r in got if r.record_type == "revisit") == [i for i in range(2, 30) if i % 3]


def test_gaps_are_reported(spark, tmp_path):
    (tmp_path / "x.warc.gz").write_bytes(record(1) + b"noise" + record(2))
    m = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", 2, 9)], warc.MANIFEST)
    assert [(r.offset, r.length) for r in warc.read_archives(m, gaps=True).collect()] == [(len(record(1)), 5)]
    assert {r.page_id for r in warc.read_archives(m).collect()} == {1, 2}


# BPE and token files:
ODD = ["", " ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|", "it's I'LL don't 'S", "İstanbul ΣΑΣ ς", "\x1c\x1da b", "x" * 3000, "!!!'s??'ll", "１２ ½ ²", "ǅ ǆ", "ﬁ Å 中文 😀", "é"]


def test_bpe_equals_the_library():
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choice("abcdefghilmnorstu 's") for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    for text, (ids, shown), want in zip(texts, bpe.Codec(PATH).encode(texts), LIBRARY.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert shown.decode() == LIBRARY.decode(want.ids, skip_special_tokens=False)


def test_compatibility_is_what_merging_says():
    s = bpe.Speculative(PATH)
    rng = np.random.default_rng(0)
    plain = np.array([i for t, i in s.ids.items() if t.isascii() and t.isalpha()])
    a, b = rng.choice(plain, 3000), rng.choice(plain, 3000)
    texts = {i: t for t, i in s.ids.items()}
    want = [s.merge(texts[x] + texts[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert s.compatible(a, b).tolist() == want


def test_round_trip_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "Hello world", 7), (3, "Hello world", 8), (None, "Hi", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_tokens): r for r in bpe.round_trip(d, PATH).collect()}
    assert {k for k in got} == {(1, 0), (2, 0), (3, 2), (None, 1)}
    assert got[1, 0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3, 2].decoded_sha256 == hashlib.sha256(LIBRARY.decode(LIBRARY.encode("hello world").ids).encode()).hexdigest()
    assert bpe.round_trip(d.limit(0), PATH).count() == 0


def test_token_files(spark, tmp_path):
    rows = [(9, "the end", "a"), (1, None, "b"), (4, "x" * 50_000, "c"), (2, "", "d"), (4, "again", "e")]
    d = spark.createDataFrame(rows, "doc_id long, text string, start string")
    m = records.write_records(d, PATH, f"file://{tmp_path}/r")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in records.read_records(m).collect())
    want, at = [], 0
    fours = [g[2] for g in got if g[1] == 4]
    for i, t in sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0], len(LIBRARY.encode(r[1]).ids) + 1 != fours[0] if r[0] == 4 else 0)):
        ids = np.array([*LIBRARY.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((at, i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    path = m.orderBy("n_records", ascending=False).first().path
    assert len(list(records.read_at(path, [0]))) == 1
    assert records.read_records(records.write_records(d.limit(0), PATH, f"file://{tmp_path}/e")).count() == 0


def test_damaged_records_are_found():
    import io

    good = records.frame(records.pack(7, np.array([1, 70_000], "<u4")))
    assert records.unpack(records.read_frame(io.BytesIO(good)))[1].tolist() == [1, 70_000]
    for at in (2, 9, 15, len(good) - 2):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(records.Corrupt):
            records.read_frame(io.BytesIO(bytes(bad)))


def test_tables_of_another_operator_are_dropped():
    bpe.codec(PATH)
    list(over("a long", lambda batch: [], keep=bpe.codec)(iter([])))
    assert bpe.codec.cache_info().currsize == 1
    list(task(lambda batches: batches)(iter([])))
    assert bpe.codec.cache_info().currsize == 0


class Counted:
    """A model that notes what it is asked for."""

    def __init__(self, model):
        self.model, self.asked = model, []

    def tokenize(self, word: str):
        self.asked.append(word)
        return self.model.tokenize(word)


def test_whole_texts_are_encoded_as_by_the_library_each_word_once(monkeypatch):
    texts = ["It's ONE thing, it's 2 things<|endoftext|>İ 中文's \x00\x1f\x7f", "ſtraße éÉ  ĲĿ\x85\xa0x", "", "one 'thing' 'STUFF é ǅ 𝒜-ﬁ"]
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    for most in (300_000, 3):
        monkeypatch.setattr(records, "MEMO", most)
        enc = records.Encoder(PATH)
        enc.memo.model = Counted(enc.memo.model)
        for again in (1, 2):
            assert [np.frombuffer(raw, "<u4").tolist() for raw in enc.encode(texts)] == want
            if most > 3:
                assert len(enc.memo.model.asked) == len(set(enc.memo.model.asked)) == sum(isinstance(w, str) for w in enc.memo)
        assert len(enc.memo) <= max(most, 3)
