import hashlib
import zlib

import numpy as np
import pytest

from sectorframe.llm import media, topk

SCHEMA = "doc_id bigint, text string, media string, n_bytes int"


def test_media_round_trip(spark):
    texts = [None, "", "x", "a" * 64, "é" * 33, "word " * 3000, "x"]
    rows = [(None if k == 2 else k, t, "clash", 1) for k, t in enumerate(texts)]
    got = media.features(media.media(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == len(texts)
    by_digest = {r.payload_sha256: r for r in got}
    for text in texts:
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = by_digest[hashlib.sha256(payload).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(media.to_wav(payload)) and r.media_sha256 == hashlib.sha256(media.to_wav(payload)).hexdigest()
        assert media.from_wav(media.to_wav(payload)) == payload and r.codes == sorted(r.codes)
    assert len({(r.media_sha256, r.feature) for r in got}) == len({r.media_sha256 for r in got})
    assert media.features(media.media(spark.createDataFrame([], SCHEMA))).count() == 0


def test_a_tones_peak_is_its_bin():
    tone = (128 + 60 * np.sin(2 * np.pi * 10 * np.arange(1024) / media.FRAME)).astype(np.uint8).tobytes()
    bins, frames = media.peaks([tone, b"\x80" * 300, b""])
    assert (bins[:7, 0] == 10).all() and frames.tolist() == [7, 2, 1] and (bins[7:] == -1).all()


def test_fingerprints_equal_a_plain_loop(monkeypatch):
    """Frame by frame and pair by pair, with the transforms cut anywhere; equal slices of sound have equal codes."""
    monkeypatch.setattr(media, "TOGETHER", 5)
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(32, 120, n, np.uint8)) for n in (64, 1280, 4096)]
    texts.append(texts[1] + texts[1])
    bins, frames = media.peaks(texts)
    found, counts = media.codes(bins, frames)
    expected = []
    for text in texts:
        own = []
        for t in range(max(1, -(-max(0, len(text) - 256) // 128) + 1)):
            x = np.array([text[k] - 128.0 if k < len(text) else 0.0 for k in range(128 * t, 128 * t + 256)])
            power = np.append(np.abs(np.fft.rfft(x * np.hanning(256))), 0)
            best = [max(range(lo, hi), key=power.__getitem__) for lo, hi in media.BANDS]
            own.append([k if power[k] > max(media.FLOOR * power.mean(), power[k - 1], power[k + 1]) else -1 for k in best])
        pairs = [(t, own[t][i], own[t + d][j], d) for d in range(3) for t in range(len(own) - d) for i in range(3) for j in range(3) if (d or i < j) and own[t][i] >= 0 and own[t + d][j] >= 0]
        expected.append(sorted((t << 24) | (a << 14) | (b << 4) | d for t, a, b, d in pairs))
    assert counts.tolist() == [len(x) for x in expected] and found.tolist() == [c for x in expected for c in x]
    shifted = {(c & 0xFFFFFF, (c >> 24) - 10) for c in expected[3] if c >> 24 >= 10}
    assert {(c & 0xFFFFFF, c >> 24) for c in expected[1] if c >> 24 < 7} <= shifted


def _brute(vectors, queries, k):
    out = []
    for q, v in queries:
        best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "ties", "negative", "few"])
def test_top_k_equals_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    n = 4 if kind == "few" else 300
    low, high = {"spread": (-60, 60), "ties": (0, 2), "negative": (-9, -1), "few": (-5, 5)}[kind]
    rows = [(int(i), rng.integers(low, high, 8).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    asks = [r for r in rows if r[0] % 50 == 0]
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), k=5, rows=64, of_queries=3).collect()
    assert sorted(map(tuple, got)) == _brute(rows, asks, 5)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.001]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (None, [1.0, 1.0]), (50, [0.25, 0.5])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    vectors = topk.whole_vectors(table)
    assert sorted(map(tuple, vectors.collect())) == [(0, [128, -1]), (50, [64, 128])]
    assert topk.top_k(vectors.where("vec_id < 0"), vectors.where("vec_id < 0")).count() == 0
    assert topk.top_k(vectors, vectors).count() == 2


def test_vectors_of_several_lengths(spark):
    rows = [(0, [1, 2]), (1, [3, 4]), (2, [5]), (50, [7]), (100, []), (101, []), (3, [1, -2])]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).collect()))
    assert got == [(0, 1, 1, 11), (0, 2, 3, -3), (50, 1, 2, 35), (100, 1, 101, 0)]


def test_scores_that_would_not_be_exact_raise(spark):
    df = spark.createDataFrame([(0, [1 << 30, 1]), (1, [1 << 30, 2])], "vec_id bigint, vector array<bigint>")
    with pytest.raises(Exception, match="wouldn't be exact"):
        topk.top_k(df, df.where("vec_id = 0")).collect()
    small = spark.createDataFrame([(0, [1 << 25, 1]), (1, [1 << 26, 2])], "vec_id bigint, vector array<bigint>")
    assert [tuple(r) for r in topk.top_k(small, small.where("vec_id = 0")).collect()] == [(0, 1, 1, (1 << 51) + 2)]
