"""Totals and best postings by classes against all pairs."""

from pyspark.sql import functions as F

from tests.conftest import SF
from tessera.plans import classes, matching
from tessera.plans.postings import RULES, decided, postings


def test_classes_against_all_pairs(spark):
    """The same counts and best postings as from every pair, for people and postings with all their gaps."""
    people = matching.people(spark, SF).filter("candidate % 37 = 1")
    posts = postings(spark, SF).filter("p_partkey % 5 = 2")
    every = decided(posts.crossJoin(people)).cache()
    unsure = [F.count_if((F.col("status") != "INELIGIBLE") & (F.col(f"rule_{k}") == "NEEDS_CONFIRMATION")).alias(f"unsure_{k}") for k in RULES]
    want = every.groupBy("candidate").agg(F.count_if(F.col("status") != "INELIGIBLE").alias("n_open"), F.count_if(F.col("status") == "ELIGIBLE").alias("n_eligible"), *unsure)
    got = classes.open_counts(posts, people)
    columns = ["candidate", "n_open", "n_eligible", *(f"unsure_{k}" for k in RULES)]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.filter("n_open > 0").select(columns).collect()))

    for least, covered in ((60, 50), (30, 80)):
        fits = (F.col("status") == "ELIGIBLE") & (F.col("tier") != "T3") & (F.col("fit") >= least) & (F.col("coverage") >= covered)
        advised = {r.candidate: r.n for r in every.groupBy("candidate").agg(F.count_if(fits).alias("n")).filter("n > 0").collect()}
        assert {r.candidate: r.n_advised for r in classes.advised_counts(posts, people, least, covered).collect()} == advised

    best = {}
    for r in every.filter("status <> 'INELIGIBLE'").collect():
        best.setdefault(r.candidate, []).append((r.tier, -r.fit, -r.stability, -r.coverage, r.p_partkey))
    want = {(c, row[-1]) for c, rows in best.items() for row in sorted(rows)[:5]}
    got = [(r.candidate, r.p_partkey) for r in classes.best_rows(posts, people, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    every.unpersist()


def test_no_pairs_in_plans(spark):
    """Candidates and postings meet by classes alone: whoever is in the same classes is decided once."""
    few = matching.people(spark, SF).filter("candidate < 3")
    many = few.withColumn("candidate", F.explode(F.sequence(F.col("candidate") * 1000, F.col("candidate") * 1000 + 499)))
    posts = postings(spark, SF).filter("p_partkey < 50")
    found = classes.classes(posts, many, [*RULES], lambda s: F.when(s != "INELIGIBLE", 0), False)
    assert max(there for there, _ in found.prefixes) <= 3 and found.people.count() == 1500


def test_nobody_and_nothing(spark):
    people, posts = matching.people(spark, SF).filter("candidate < 9"), postings(spark, SF)
    for a, b in ((posts.limit(0), people), (posts, people.limit(0))):
        assert classes.open_counts(a, b).count() == classes.advised_counts(a, b).count() == classes.best_rows(a, b, 3).count() == 0
