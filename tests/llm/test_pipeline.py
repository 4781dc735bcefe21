"""The pipeline's stages: columns, decisions that take effect, clean documents that stay."""

import random

import pytest


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdeghilmnorstu") for _ in range(r.randint(2, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("data"))
    good = {i: "\n".join(" ".join(words(i * 100 + k, 12)) + "." for k in range(6)) for i in range(0, 150)}
    bad = {i: "\n".join(" ".join(w.upper() + "!!" for w in words(i * 100 + k, 12)) for k in range(6)) for i in range(200, 260)}
    item = " ".join(words(77777, 40))
    rows = [(i, t, "en", "s", len(t)) for i, t in {**good, **bad}.items()]
    rows += [(300, good[3], "en", "s", 1), (301, good[4] + " more", "en", "s", 1), (302, item, "en", "s", 1), (None, "x", "en", "s", 1), (303, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in [*good, *bad] if i % 4], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r.doc_id for r in docs.collect()}
    assert kept["quality"] >= {*range(150), 300, 301, 302} and not kept["quality"] & set(range(200, 260))
    assert 300 not in kept["lines"] and kept["lines"] >= set(range(150))
    assert kept["near_duplicates"] >= set(range(150))
    assert 302 in kept["near_duplicates"] and 302 not in kept["benchmarks"] and kept["benchmarks"] >= set(range(150))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in pieces.collect()} == kept["benchmarks"]
    assert sorted(map(tuple, pieces.drop("sequence_id", "offset").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, folder).drop("sequence_id", "offset").collect()))


def test_pipeline_of_awkward_tables(spark, folder, tmp_path):
    """Further columns with names that the stages use, an empty table, and a folder without any label."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    wide = spark.read.parquet(f"{folder}/documents.parquet").select("*", *(F.lit(7).alias(c) for c in ("base", "part", "kind", "blob", "row", "sha", "score", "bucket", "rest")))
    none = f"{tmp_path}/none"
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{none}/labels.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{none}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns and out.where("base <> 7 or rest <> 7").count() == 0, name
        assert stage(spark, wide.limit(0), folder).collect() == [], name
        assert stage(spark, wide, none).count() > 0, name
    assert stage(spark, wide, folder).columns == wide.columns
    assert corpus_pipeline.STAGES[-1][1](spark, wide.limit(0), folder).collect() == []
