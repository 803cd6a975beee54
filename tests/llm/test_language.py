"""Language identification: accuracy on documents it did not learn from, and popcounts against plain sets."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import language

SF = os.environ.get("QUANTLOOM_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).collect()[0]
    assert n > 100 and right >= 0.98 * n
    kinds = got.groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("share")).collect()
    assert len(kinds) > 1 and min(r.share for r in kinds) >= 0.9


def test_shares_are_those_of_plain_sets():
    rng = np.random.default_rng(1)
    grams = np.unique(np.concatenate(list(language.trigrams("the quick brown fox jumps over the lazy dog while seven wizards mix a potion"))))
    belongs = rng.random((len(grams), 3)) < 0.5
    model = language.Filter(["a", "b", "c"], grams.astype(np.uint64), belongs)
    text = "the lazy wizards mix the brown dog"
    seen = np.concatenate(list(language.trigrams(text)))
    own = [set(grams[belongs[:, k]].tolist()) for k in range(3)]
    want = np.array([np.mean([g in s for g in seen.tolist()]) for s in own])
    # a filter may hold what its set does not, by chance; it never loses a member
    assert np.allclose(model.shares(text), want, atol=0.02)
