import zlib

import numpy as np
import pandas as pd
import pytest

from sectorframe.llm import language, quality, toxicity

SCHEMA = "doc_id bigint, text string, score string, lang string, source string"


def _held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0


@pytest.fixture(scope="module")
def tables(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    odd = pd.DataFrame({"doc_id": [None, 100001, 100002, 100003], "text": [None, "", " ", "x" * 200_000], "lang": None, "source": None})
    rows = pd.concat([d, odd, d.head(3)], ignore_index=True)
    rows["doc_id"] = rows["doc_id"].astype("Int64")
    rows = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.text, "clash", r.lang, r.source) for r in rows.itertuples()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache(), labels, len(rows)


@pytest.mark.parametrize("find,label,least", [(toxicity.toxicity, "toxic", 0.9), (quality.quality, "quality", 0.93)])
def test_held_out_accuracy(spark, tables, find, label, least):
    docs, labels, n = tables
    got = find(docs, spark.createDataFrame(labels)).toPandas()
    assert len(got) == n and got["score"].between(0, 1).all() and not got["score"].isna().any()
    assert [_held(None if pd.isna(x) else int(x)) for x in got["doc_id"]] == got["held_out"].tolist()
    own = got[got["held_out"]].merge(labels, on="doc_id")
    assert (own["predicted"] == own[label]).mean() >= least
    clean = own[own[label] == (0 if label == "toxic" else 1)]
    assert (clean["predicted"] == clean[label]).mean() >= 0.96
    # Held-out labels change nothing.
    other = labels.copy()
    held = other["doc_id"].map(_held)
    other.loc[held, label] = 1 - other.loc[held, label]
    again = find(docs, spark.createDataFrame(other)).toPandas()
    assert sorted(again["score"].round(9)) == sorted(got["score"].round(9))


@pytest.mark.parametrize("find", [toxicity.toxicity, quality.quality])
def test_without_labels_or_rows(spark, tables, find):
    docs, labels, n = tables
    none = spark.createDataFrame(labels).limit(0)
    some = docs.where("doc_id < 20")
    got = find(some, none).toPandas()
    assert got["score"].between(0, 1).all() and len(got) == some.count()
    assert find(docs.limit(0), spark.createDataFrame(labels)).count() == 0


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    n = 40_000
    y = rng.random(n) < 0.15
    votes = np.zeros((n, 5), int)
    for j, (hit, false) in enumerate([(0.7, 0.01), (0.5, 0.02), (0.6, 0.005), (0.4, 0.03)]):
        votes[:, j] = rng.random(n) < np.where(y, hit, false)
    votes[:, 4] = np.where(rng.random(n) < 0.95, votes[:, 0], 0)  # an echo of the first voter
    pattern, inverse, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = toxicity.fit_label_model(pattern, count.astype(float), 0.15)
    assert model.leans[4] == 0 or model.leans[0] == 4
    assert np.allclose(model.rates[1, 0, :4], [0.7, 0.5, 0.6, 0.4], atol=0.08)
    toxic = model.posterior(pattern)[inverse.ravel()]
    assert ((toxic > 0.5) == y).mean() > 0.95


def test_voters_accuracies_against_the_labels(spark, tables):
    """What the model estimates without labels is near what labels say of voters that vote often."""
    docs, labels, _ = tables
    terms, prior = toxicity.mine(docs, spark.createDataFrame(labels))
    found = toxicity.hits(docs, terms).cache()
    model = toxicity.label_model(found, terms, prior)
    own = found.where("doc_id IS NOT NULL").toPandas().drop_duplicates("doc_id").merge(labels, on="doc_id")
    votes = np.array([[any(terms.voters[k, v] for k in hit) for v in range(len(toxicity.VOTERS))] for hit in own["hits"]])
    estimated = toxicity.accuracies(model, votes.astype(int), np.ones(len(votes)))
    often = 0
    for v, name in enumerate(toxicity.VOTERS):
        if votes[:, v].sum() >= 20 and not name.startswith("clean") and name not in toxicity.PATTERNS:
            often += 1
            assert abs(own["toxic"][votes[:, v]].mean() - estimated[v]) < 0.15, name
    assert often >= 3 and votes[:, toxicity.VOTERS.index("words_0")].any()


def test_patterns_stay_within_texts():
    import pyarrow as pa

    texts = ["sooo bad", "so", "oo", "a1b", "ab1", "c", "STOP", "STO", "P!?", "!", "?"]
    assert [x.tolist() for x in toxicity.patterns(pa.array(texts))] == [[0], [3], [6], [8]]
    assert all(not len(x) for x in toxicity.patterns(pa.array([], pa.string())))


def test_posteriors_equal_enumeration():
    """Of leaning voters, by the joint probability of class and votes, voter by voter."""
    rng = np.random.default_rng(2)
    model = toxicity.LabelModel(0.2, np.array([-1, 0, -1, 2]), rng.uniform(0.05, 0.9, (2, 2, 4)))
    votes = np.array([[a >> k & 1 for k in range(4)] for a in range(16)])
    for row, got in zip(votes, model.posterior(votes), strict=True):
        joint = [0.8, 0.2]
        for y in (0, 1):
            for j, on in enumerate(model.leans):
                p = model.rates[y, row[on] if on >= 0 else 0, j]
                joint[y] *= p if row[j] else 1 - p
        assert np.isclose(got, joint[1] / sum(joint))
    assert np.isclose(sum(np.prod([model.rates[1, r[on] if on >= 0 else 0, j] if r[j] else 1 - model.rates[1, r[on] if on >= 0 else 0, j] for j, on in enumerate(model.leans)]) for r in votes), 1)


def test_sizes_equal_a_plain_zstandard_loop(spark, tables):
    import zstandard

    docs, labels, _ = tables
    model = quality.fit(docs, spark.createDataFrame(labels))
    rows = docs.where("text IS NOT NULL").limit(150)
    texts = [r.text for r in rows.collect()]
    expected = []
    for text in texts:
        raw, total = text.encode(), 0
        for k in range(0, len(raw), 1024):
            sizes = [len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False).compress(raw[k : k + 1024])) for d in (model.bad, model.good)]
            total += sizes[0] - sizes[1]
        x = [total / len(raw), np.log(len(raw)) / 10, total / len(raw) * np.log(len(raw)) / 10] if raw else [0, 0, 0]
        expected.append(1 / (1 + np.exp(-np.clip(np.dot(x, model.weights[:-1]) + model.weights[-1], -30, 30))))
    got = [r.score for r in quality.score(rows, model).collect()]
    assert np.allclose(got, expected, atol=0.02) and np.mean(np.abs(np.array(got) - expected)) < 1e-3


def test_samples_are_bounded_by_rows_and_hold_long_texts(spark):
    from sectorframe.llm.labelled import labelled_sample

    rows = [(k, f"{k} " + "long " * 10_000) for k in range(40)] + [(1, f"other {j}") for j in range(50)] + [(50, None)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, toxic int")
    got = labelled_sample(spark.createDataFrame(rows, "doc_id bigint, text string"), labels, "toxic", 10).toPandas()
    assert got["y"].value_counts().le(10).all() and len(got) == len(set(got["doc_id"])) > 10
    assert (got["text"].str.len() > 16 << 10).sum() >= len(got) - 1
    text = bytes(range(256)) * 100
    assert [text.find(p) >= 0 and len(p) for p in quality.spread(text)] == [1024] * 4 and quality.spread(text)[-1] == text[-1024:] and quality.spread(b"") == []


def test_languages(spark, tables):
    docs, _, n = tables
    from pyspark.sql import functions as F

    got = language.identify(docs, language.train(docs), ["doc_id", "lang", "score"], F.col("source")).toPandas()
    assert len(got) == n and (got["score"] == "clash").all()
    known = got[got["lang"].notna()]
    assert (known["lang"] == known["language"]).mean() > 0.995 and known["known"].mean() > 0.99
    assert not got[got["doc_id"].isin([100001]) | got["doc_id"].isna()]["known"].any()
    assert language.identify(docs.limit(0), language.train(docs), ["doc_id"], F.col("source")).count() == 0
    assert not language.identify(docs, language.train(docs.limit(0)), ["doc_id"], F.col("source")).toPandas()["known"].any()


def test_all_languages_and_their_variants(spark, monkeypatch):
    """40 languages, two of them rare, with regions and case; a repeated id takes one place only."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    alphabets = ["".join(chr(c) for c in rng.choice(np.arange(0x100, 0x240), 12, replace=False)) for _ in range(40)]
    text = lambda k: " ".join("".join(rng.choice(list(alphabets[k]), 5)) for _ in range(30))
    rows = []
    for k in range(40):
        code = f"q{chr(97 + k // 26)}{chr(97 + k % 26)}"
        variants = [code, code.upper(), f"{code}-GB", f"{code}_x"]
        rows += [(len(rows) + i, text(k), variants[i % 4], code, "s") for i in range(4 if k > 37 else 8)]
    docs = spark.createDataFrame([*rows, *[rows[0]] * 50], "doc_id bigint, text string, lang string, code string, source string")
    model = language.train(docs)
    assert model[0] == sorted({r[3] for r in rows})
    got = language.identify(docs, model, ["doc_id", "code"], F.col("source")).toPandas()
    assert len(got) == len(rows) + 50 and (got["language"] == got["code"]).all() and got["known"].all()
    monkeypatch.setattr(language, "LANGUAGES", 39)
    with pytest.raises(ValueError):
        language.train(docs)


def test_evidence_beyond_the_text(spark, tables):
    """A text that says nothing clear follows its host and its markup."""
    from pyspark.sql import functions as F

    docs, _, _ = tables
    model = language.train(docs)
    base = docs.where("lang = 'de' AND length(text) > 200").limit(40).select(F.lit("http://www.a.example.de/x").alias("url"), "text", F.lit("<html lang='de-AT'>").alias("html"))
    rows = base.union(docs.where("lang = 'en' AND length(text) > 200").limit(60).select(F.lit("http://b.example.org/"), "text", F.lit('<html lang="en">')))
    unclear = spark.createDataFrame([("https://other.a.example.de/", "in en", '<html class="x" lang=de>'), ("http://b.example.org", "in en", '<html lang="en">')], "url string, text string, html string")
    own = rows.union(unclear).withColumn("k", F.col("text") == "in en")
    got = language.identify(own, model, ["url", "k"], language.address_host(F.col("url")), language.markup_language(F.col("html"))).where("k")
    assert {r.url: r.language for r in got.collect()} == {"https://other.a.example.de/": "de", "http://b.example.org": "en"}


def test_priors_equal_sql_and_evidence_is_told(spark):
    import duckdb

    from sectorframe.llm.queries import ORACLE_SQL, QUERIES

    sf_dir = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    expected = duck.sql(ORACLE_SQL["language_priors"]).df()
    got = QUERIES["language_priors"](spark, sf_dir).toPandas()
    assert len(got) and sorted(got.columns) == sorted(expected.columns)
    keys = ["host", "language"]
    both = got.merge(expected, on=keys, suffixes=("", "_sql"))
    assert len(both) == len(got) == len(expected)
    assert all(np.allclose(both[c], both[f"{c}_sql"], atol=2e-9) for c in ("prior", "by_domain", "by_suffix"))
    told = QUERIES["language_of_pages"](spark, sf_dir).toPandas()
    assert {"by_text", "by_markup", "by_suffix", "by_domain", "by_host"} <= set(told.columns) and told["by_host"].notna().any()


def test_held_out_languages(spark, tables):
    """Learned from the rows whose id isn't held out, and measured on those that are."""
    from pyspark.sql import functions as F

    from sectorframe.llm.common import held_out

    docs, _, _ = tables
    model = language.train(docs.where(~held_out()))
    got = language.identify(docs.where(held_out() & F.col("lang").isNotNull()), model, ["doc_id", "lang"], F.col("source")).toPandas()
    assert len(got) > 100 and (got["lang"] == got["language"]).mean() > 0.99


@pytest.mark.parametrize("size", [3, 1 << 18])
def test_trigrams_stay_within_texts(monkeypatch, size):
    import pyarrow as pa

    monkeypatch.setattr(language, "SLICE", size)
    texts = ["", "a", "ab", "abc", "", "abcd", "\u00e9", "abcdefghij", ""]
    parts = list(language.trigrams(pa.array(texts)))
    assert sum(np.diff(edges) for _, edges in parts).tolist() == [0, 0, 0, 1, 0, 2, 0, 8, 0]
    found = np.concatenate([x for x, _ in parts])
    ((one, _),) = language.trigrams(pa.array(["ABC"]))
    assert found[0] == found[1] == found[3] == one[0]
