"""Benchmark windows in documents against a brute-force search, by both join paths."""

import random
import re

import pytest

from quantloom.llm import decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item_id, item in items:
        iw = words(item)
        n = min(len(iw), 10)
        for i in range(len(iw) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p:p + n] == iw[i:i + n]:
                    hit.update(range(p, p + n))
                    found |= {str(item_id)} if item_id is not None else set()
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("small", [decontaminate.SMALL, 0])
def test_hits_match_brute_force(spark, small):
    rng = random.Random(3)
    vocabulary = ["a", "B", "É", "é", "ΑΣ", "x1", "the"]
    def text(n):
        return "".join(w + rng.choice([" ", ", ", "\n", "."]) for w in rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([0, 1, 2, 5, 9, 10, 11, 25]))) for i in range(11)] + [(None, "the the the x1 x1"), (3, None), (12, ""), (13, "zz yy")]
    items += [items[7]] * 2
    docs = [(i, rng.choice(["", text(30)]) + rng.choice([x[1] or "" for x in items]) + rng.choice(["", "ΑΣ.Β " + text(12)])) for i in range(60)]
    docs += [(70, None), (71, ""), (72, "... !"), docs[4], (docs[5][0], "another " + docs[6][1]), (None, items[7][1])]
    d = spark.createDataFrame([(*x, "q", 1) for x in docs], "doc_id long, text string, words string, start int")
    b = spark.createDataFrame([(*x, "q") for x in items], "item_id long, text string, n string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.scan(d, b, small=small).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted([(i, *brute(t, items)) for i, t in docs], key=key)
    if small:
        assert decontaminate.scan(d.limit(0), b).count() == 0
        assert decontaminate.scan(d, b.limit(0)).where("n_hit > 0").count() == 0
