"""The pipeline's stages on a small table, each against brute force on its own input."""

import os
import re
import shutil

import pytest
from pyspark.sql import functions as F
from test_jaccard import brute as linked
from test_leaks import brute as leaked

import corpus_pipeline
from quantloom.llm.mixing import mix
from quantloom.llm.queries import weighted

SF = "/root/testdata/sf0.001"


def copied(tmp_path):
    """A new folder with all given tables but ``documents``; the given ones may be read-only."""
    sf = tmp_path / "sf"
    sf.mkdir()
    for name in ("benchmark", "labels"):
        shutil.copyfile(f"{SF}/{name}.parquet", sf / f"{name}.parquet")
    return str(sf)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_no_documents_and_clashing_columns(spark, tmp_path):
    sf = copied(tmp_path)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clashing = docs.withColumns({c: F.lit("x") for c in ("lang_pred", "hit_rate", "component_id", "text_key", "_d", "_t", "_spans", "size", "weight", "quality", "taken")})
    clashing.limit(0).coalesce(1).write.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).collect() == []
    some = clashing.where("doc_id < 40").persist()
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert sorted(r["doc_id"] for r in step(spark, some, SF).collect()) == sorted(r["doc_id"] for r in step(spark, some.select(*corpus_pipeline.COLUMNS), SF).collect()), name
    assert corpus_pipeline.STAGES[-1][1](spark, some, SF).count() == some.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    sf = copied(tmp_path)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "1 2 3 !", "en", "s", 7), (9002, "", "en", None, 0), (9003, "mail x@y.zz now or +1 (017) 555-7713 the and of " * 3, "en", None, 9)], docs.schema)
    docs = docs.union(odd).union(docs.limit(3)).toDF(*docs.columns)
    docs.coalesce(1).write.parquet(f"{sf}/documents.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs.collect()]
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, sf)
        if i < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS)
            out.write.parquet(str(tmp_path / f"stage{i}"))
            docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
            tables.append(docs.collect())
    raw, spoken, single, clean, redacted = tables
    ids = lambda rows: sorted(str(r["doc_id"]) for r in rows)
    assert ids(spoken) == sorted(str(r["doc_id"]) for r in raw if r["text"] and re.search(r"[^\W\d_]", r["text"]))
    firsts = {c for _, n, c in linked([(r["doc_id"], r["text"]) for r in spoken], 5, 80)}
    assert ids(single) == sorted(map(str, firsts))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert ids(clean) == sorted(str(r["doc_id"]) for r in single if not leaked(r["text"], items)[1])
    assert len(single) > len(clean) > 0 and ids(redacted) == ids(clean)
    before = {r["doc_id"]: r["text"] for r in clean}
    assert all(("@" not in r["text"] or "@" in re.sub(r"\S+@\S+\.\S+", "", before[r["doc_id"]])) and r["n_chars"] == len(r["text"]) for r in redacted)
    assert sum("[email]" in r["text"] for r in redacted) > 0
    got = out.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(weighted(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()))
    assert ids(got) == ids(redacted)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, got))
