import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import os
import sys

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline
from sectorframe.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], sf_dir).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "mixing", "packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and 0 < df.count()


def test_quality_keeps_clean_documents(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").toPandas()
    kept = set(stages[1].toPandas()["doc_id"])
    good, bad = (labels[labels["quality"] == q]["doc_id"] for q in (1, 0))
    assert good.isin(kept).mean() > 0.9 and bad.isin(kept).mean() < 0.5
    assert stages[2].count() == stages[1].count()


def test_one_of_each_group(stages):
    from test_near_dup import _brute

    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    expected = {doc for doc, _, _, kept in _brute(rows, 5) if kept}
    assert {r.doc_id for r in stages[3].collect()} == expected


def test_packing_holds_each_copys_tokens_once(stages):
    from collections import Counter

    copies = Counter(r.doc_id for r in stages[4].collect())
    assert set(copies) <= {r.doc_id for r in stages[3].collect()}
    pieces = stages[5].toPandas()
    heads = pieces[pieces["start"] == 0]
    assert Counter(heads["doc_id"].tolist()) == copies
    assert pieces["length"].sum() == heads["doc_tokens"].sum()


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_clashing_columns(spark, stage):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    extra = ["score", "known", "language", "row", "size", "n", "_row", "_k", "_w"]
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (-5, "x " * 50_000, None, "src0", 7)], docs.schema)
    rows = docs.unionByName(odd)
    for k, name in enumerate(extra):
        rows = rows.withColumn(name, rows["n_chars"] + k)
    got = stage(spark, rows, sf_dir)
    if stage is not corpus_pipeline.packing:
        assert got.columns == rows.columns
        assert all(r["_w"] == (None if r.n_chars is None else r.n_chars + 8) for r in got.collect())
        assert stage(spark, rows.limit(0), sf_dir).columns == rows.columns
    assert stage(spark, rows.limit(0), sf_dir).count() == 0 < got.count()


def test_registered_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(QUERIES) | {"pipeline"} <= names and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
    assert {n.split("_")[0] for n in QUERIES if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}
