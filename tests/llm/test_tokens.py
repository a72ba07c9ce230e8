import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from sectorframe.llm import packing, rans
from sectorframe.llm.tokens import encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " a", "a ", "a  b", "a\n\nb", "a \n b", "\n", "x\nd y", "a\tb", "it's a dog's", "<|endoftext|> x", "é é ́x", "ΑΣ Σ. ΑΣ\nx", "a　b", "a b c", "日本 語", "don't!!, x.y,z", "A,,b..C 12a3", "x" * 5000, "İstanbul ß", "a''s b", "|", "!", "a\x00b", "a\x85b"]
SCHEMA = "doc_id bigint, text string, length int, start string"


def _library(path):
    """The library as it is, with no setting of ours."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.mark.parametrize("path,cut", [(BYTES, "blanks"), (WORDS, "words")])
def test_ids_equal_the_librarys(path, cut):
    coder = encoder(path, cut)
    for _ in range(2):
        ids, counts = coder.encode(pa.array(ODD, pa.string()))
        expected = [_library(path).encode(x or "", add_special_tokens=False).ids for x in ODD]
        assert counts.tolist() == [len(x) for x in expected]
        assert ids.tolist() == [i for x in expected for i in x]


@pytest.mark.parametrize("path,cut", [(BYTES, "blanks"), (WORDS, "words")])
def test_added_tokens_are_one_id(path, cut):
    library = _library(path)
    added = {x.content: k for k, x in library.get_added_tokens_decoder().items()}
    texts = [t for x in added for t in (x, f"a {x}b c", f"{x}{x} d", x.upper(), x[:-1], f"e\n{x}\n")] + ["plain words"]
    ids, counts = encoder(path, cut).encode(pa.array(texts))
    expected = [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert added and expected[0] == [added[texts[0]]]
    assert counts.tolist() == [len(x) for x in expected]
    assert ids.tolist() == [i for x in expected for i in x]


@pytest.mark.parametrize("path,cut", [(BYTES, "blanks"), (WORDS, "words")])
def test_long_texts_are_cut_and_a_small_cache_starts_anew(monkeypatch, path, cut):
    """Parts of a text of 300 times a chunk; one part has no place to cut, one holds an added token and odd blanks."""
    from sectorframe.llm import tokens

    monkeypatch.setattr(tokens, "CHUNK_BYTES", 1 << 10)
    monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000)
    rng = np.random.default_rng(4)
    prose = " ".join("".join(rng.choice(list("abcdefgh'\u00e9\u03a31,"), rng.integers(1, 9))) for _ in range(50_000))
    texts = [prose, "short", "1 2 " * 3000, None, "x" * 5000 + " y z" * 700, prose[:3000] + "<|endoftext|>  \n a" + prose[:3000]]
    got = [x for _, _, ids, counts in tokens.Encoder(path, cut).chunks(pa.array(texts)) for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert [x.tolist() for x in got] == [_library(path).encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path,cut", [(BYTES, "blanks"), (WORDS, "words")])
def test_pieces_met_again_stay_when_the_cache_is_full(monkeypatch, path, cut):
    """Forty chunks with the same hundred words among new ones, which fill the cache ten times: the library sees each of the hundred once."""
    from sectorframe.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_BYTES", 200_000)
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefgh"), 12)) for _ in range(100 + 40 * 200)]
    texts = [" ".join([*words[100 + 200 * k : 300 + 200 * k], *words[:100]]) for k in range(40)]
    coder, asked = tokens.Encoder(path, cut), []
    library = coder._library
    monkeypatch.setattr(coder, "_library", lambda own: asked.extend(own) or library(own))
    for text in texts:
        ids, _ = coder.encode(pa.array([text]))
        assert ids.tolist() == _library(path).encode(text, add_special_tokens=False).ids
        assert coder.held <= 200_000
    seen = Counter(" ".join(asked).split())
    assert all(seen[w] == 1 for w in words[:100])


def test_scaled_frequencies():
    for counts in ([0, 5, 1, 0, 10**9], [7], [1] * 50257, [0]):
        freq = rans.scaled(np.array(counts))
        assert all((f > 0) == (c > 0) for f, c in zip(freq, counts, strict=True))
        assert freq.sum() in (1 << rans.BITS, (1 << rans.BITS) - 1, 0)


@pytest.mark.parametrize("n", [0, 1, 31, 16384, 50_001])
@pytest.mark.parametrize("kinds", [1, 2, 3000])
def test_round_trip_and_single_blocks(n, kinds):
    ids = (np.random.default_rng(n).pareto(1, n).astype(np.int64)) % kinds
    coder = rans.Coder(rans.scaled(np.bincount(ids, minlength=3000) + (np.arange(3000) == 0)))
    data = coder.encode(ids)
    assert (coder.decode(data) == ids).all()
    if n > rans.BLOCK:
        assert (coder.decode(data, range(1, 2)) == ids[rans.BLOCK : 2 * rans.BLOCK]).all()


def test_each_flipped_bit_is_found():
    ids = np.random.default_rng(3).pareto(1, 50_001).astype(np.int64) % 3000
    coder = rans.Coder(rans.scaled(np.bincount(ids, minlength=3000)))
    data = coder.encode(ids)
    places = [*range(16 * 8), *np.random.default_rng(5).integers(0, 8 * len(data), 1000).tolist(), *range(8 * len(data) - 32, 8 * len(data))]
    for place in places:
        broken = bytearray(data)
        broken[place // 8] ^= 1 << place % 8
        with pytest.raises(ValueError):
            coder.decode(bytes(broken))
    for broken in (data[:-4], data + b"1234", data[:9], b""):
        with pytest.raises(ValueError):
            coder.decode(broken)


def test_changed_documents_of_a_shard_are_found(spark):
    from pyspark.sql import functions as F

    path = rans.write(spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(ODD)], SCHEMA), BYTES)
    shards = spark.read.parquet(f"{path}/shards")
    changes = {"doc_ids": F.transform("doc_ids", lambda x: x + 1), "counts": F.reverse("counts"), "start": F.col("start") + 1}
    for column, value in changes.items():
        other = f"{path}-{column}"
        shards.withColumn(column, value).write.parquet(f"{other}/shards")
        spark.read.parquet(f"{path}/frequencies").write.parquet(f"{other}/frequencies")
        with pytest.raises(Exception, match="checksum of a shard's documents"):
            rans.read(spark, other).collect()


def test_ids_over_16_bits_raise(spark):
    with pytest.raises(Exception, match="ids over 65,535"):
        rans.write(spark.createDataFrame([(1, "a", 1, "x")], SCHEMA), BYTES, end=70_000)


def _rows(path, texts, end):
    tokenizer = _library(path)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, end] for t in texts]


def test_files_hold_all_ids(spark):
    rows = [(k if k % 7 else None, t, 1, "x") for k, t in enumerate(ODD * 2)]
    path = rans.write(spark.createDataFrame(rows, SCHEMA).repartition(3), BYTES)
    got = rans.read(spark, path).orderBy("start").collect()
    expected = Counter((k, tuple(i)) for (k, *_), i in zip(rows, _rows(BYTES, [r[1] for r in rows], 0), strict=True))
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == expected
    at = 0
    for a, b in zip(got, got[1:], strict=False):
        assert (a.doc_id or -1) <= (b.doc_id or -1)
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4"))
        at += r.n_tokens


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rans.read(spark, rans.write(empty, BYTES)).count() == 0
    assert packing.pack(empty, WORDS).count() == 0


def test_lengths_fill_windows():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 2048, 3000).tolist() + [5] * 300 + [2047] * 10
    windows = packing.pack_lengths(sizes)
    assert sorted(k for w in windows for k in w) == list(range(len(sizes)))
    sums = [sum(sizes[k] for k in w) for w in windows]
    assert max(sums) <= 2048 and sum(sizes) > 0.98 * 2048 * len(windows)


def test_fullest_is_the_best_sum_with_the_longest():
    rng = np.random.default_rng(2)
    for _ in range(200):
        sizes = sorted(rng.integers(1, 30, rng.integers(1, 9)).tolist(), reverse=True)
        counts = dict(Counter(sizes))
        chosen = packing.fullest(sorted(counts, reverse=True), counts, 50)
        sums = {sizes[0]}
        for x in sizes[1:]:
            sums |= {s + x for s in sums if s + x <= 50}
        assert sum(k * n for k, n in chosen.items()) == max(sums)
        assert all(0 < n <= counts[k] for k, n in chosen.items())


def test_pack_places_each_id_once(spark):
    texts = [*ODD, "word " * 5000, "word " * 5000]
    rows = [(k if k % 5 else None, t, 1, "x") for k, t in enumerate(texts)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(2), WORDS).collect()
    expected = Counter(tuple(x) for x in _rows(WORDS, texts, 1))
    by_doc = Counter()
    for r in got:
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4"))
        by_doc[r.doc_tokens] += r.length
    wanted = Counter()
    for ids, n in expected.items():
        wanted[len(ids)] += len(ids) * n
    assert by_doc == wanted
    for sequence in {r.sequence_id for r in got}:
        own = sorted((r.offset, r.length) for r in got if r.sequence_id == sequence)
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist()
        assert sum(n for _, n in own) <= 2048
