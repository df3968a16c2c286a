"""Joins against all pairs."""

import random

from pyspark.sql import functions as F

from tessera.operators import joins


def test_similar_stems(spark):
    """The same pairs as all pairs of a block; few more candidates than there are links."""
    rng = random.Random(8)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 24))) for _ in range(150)]
    words = [*base, *(w + rng.choice("xyz") for w in base), *(rng.choice("xyz") + w for w in base), *(w[1:] for w in base), "", "招聘公告招聘公告", "某某学院招聘公告招聘公告", "aaaaaaaaaaaa", "aaaaaaaaaaaaaa"]
    rows = [(i, rng.choice(["p", "q"]) if i < 500 else "p", w) for i, w in enumerate(words)] + [(999, "p", None)]
    df = spark.createDataFrame(rows, "i int, g string, s string")
    a, b = (df.select(F.col("i").alias(f"{n}_i"), "g", F.col("s").alias(n)) for n in "ab")
    for least, ratio in ((6, 0.75), (3, 0.5), (12, 0.75)):
        want = set()
        for i, g, x in rows:
            for j, h, y in rows:
                if g == h and x is not None and y is not None:
                    short, long_ = sorted((x, y), key=len)
                    if x == y or (len(short) >= least and len(short) >= ratio * len(long_) and short in long_):
                        want.add((i, j))
        out = joins.similar_stems(a, b, ["g"], "a", "b", least, ratio)
        got = [(r.a_i, r.b_i) for r in out.select("a_i", "b_i").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    links = joins.similar_stems(a, b, ["g"], "a", "b", 6).filter("a <> b").select("g", "a", "b").distinct().count()
    assert 100 < links <= joins.contained_candidates(a, b, ["g"], "a", "b", 6, 0.75).distinct().count() <= 5 * links
