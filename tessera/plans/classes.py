"""Totals and best rows over all pairs of a posting and a candidate, without the pairs.

A decision is put together from parts (each rule, each preference), and a part looks at a few columns of either side. What columns
of one side cannot be told apart by anything on the other are one class. Classes are met part by part: rows start as postings' classes, and a part
replaces its posting's class by each candidate's class that it does not exclude; rows that now agree are folded. So the work
follows the number of classes, not of pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import half_up
from tessera.plans import rules
from tessera.plans.postings import FIT, RULES, STABILITY, fit_points, stability_points, statuses, wishes
from tessera.session import checkpoint_folder

#: By part: the columns of a candidate, the facts that must be confirmed for them, the columns of a posting, the field of a conflict, and dimensions of fit.
PARTS: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], str | None, tuple[str, ...]]] = {
    "AGE": (("born", "born_last"), ("BIRTH",), ("max_age", "cutoff"), "AGE", ()),
    "EDUCATION": (("own_education", "completion", "verification"), ("EDUCATION",), ("education",), "EDUCATION", ()),
    "EXACT_MAJOR": (("majors",), ("MAJORS",), ("exact", "majors_text"), "EXACT_MAJOR", ("MAJOR_FIT",)),
    "GRADUATE_YEAR": (("graduated",), ("GRADUATION",), ("accepted", "graduates_text"), None, ()),
    "EXPERIENCE": (("years",), ("EMPLOYMENT",), ("min_years", "cutoff"), None, ("EXPERIENCE_FIT",)),
    "PROFESSIONAL_TITLE": (("titles",), ("TITLES",), ("wanted", "wanted_text"), None, ("PROFESSIONAL_TITLE_FIT",)),
    "POLITICAL_AFFILIATION": (("party",), ("PARTY",), ("party_required",), None, ()),
    "GENDER": (("own_gender",), ("GENDER",), ("gender_text",), None, ()),
    "FRESH_GRADUATE_STATUS": (("employer", "insurance"), (), ("clause",), None, ()),
    "WORDS": (("skills", "research"), ("SKILLS", "RESEARCH"), ("title",), None, ("SKILL_FIT", "RESEARCH_FIT")),
    "PLACES": (("places",), ("PLACES",), ("place",), None, ()),
    "EMPLOYMENTS": (("employments",), ("EMPLOYMENTS",), ("employment",), None, ()),
    "FAMILIES": (("families",), ("FAMILIES",), ("family",), None, ()),
    "ORGANISATIONS": (("organisations",), ("ORGANISATIONS",), ("organisation",), None, ()),
}


def _own(part: str) -> Column:
    """What a part sees of a candidate."""
    columns, facts, *_ = PARTS[part]
    return F.struct(*columns, F.array_intersect("confirmed", F.array(*map(F.lit, facts)).cast("array<string>")).alias("confirmed"))


def _asked(part: str) -> Column:
    """What a part sees of a posting."""
    _, _, columns, field, _ = PARTS[part]
    return F.struct(*columns, F.array_intersect("conflicts", F.array(*([F.lit(field)] if field else [])).cast("array<string>")).alias("conflicts"))


@dataclass
class Classes:
    """Candidates and postings by classes: mine_<part> and theirs_<part>, and what each two classes of a part make together."""

    people: DataFrame
    posts: DataFrame
    met: DataFrame
    parts: list[str]
    #: By part: the most points that it may give; and how many parts, the first ones, bear on a score (if these are to come first).
    most: dict[str, int]
    n_scoring: int
    #: By number of parts: how many combinations of their classes candidates have, and how many there may be.
    prefixes: list[tuple[int, int]]

    def of(self, part: str) -> DataFrame:
        return F.broadcast(self.met.filter(F.col("part") == part).select(F.col("own").alias(f"mine_{part}"), F.col("asked").alias(f"theirs_{part}"), "code", "points", "known", "wished"))

    def folded(self, rows: DataFrame, fold: Callable[[DataFrame, str | None, list[str], int], DataFrame]) -> DataFrame:
        """rows: theirs_<part> of each part and what is folded; fold(rows, part, keys, parts left) gives rows by keys. At the end keys are mine_<part>."""
        rows = fold(rows, None, [f"theirs_{p}" for p in self.parts], len(self.parts))
        for i, part in enumerate(self.parts):
            own, left = [f"mine_{p}" for p in self.parts[: i + 1]], [f"theirs_{p}" for p in self.parts[i + 1 :]]
            rows = rows.join(self.of(part), f"theirs_{part}").drop(f"theirs_{part}")
            there, possible = self.prefixes[i]
            # combinations that no candidate has go as soon as there are many
            if 2 * there < possible:
                rows = rows.join(self.people.select(*own).distinct(), own, "left_semi")
            rows = fold(rows, part, [*own, *left], len(self.parts) - i - 1)
        return rows


def classes(posts: DataFrame, people: DataFrame, parts: list[str], code: Callable[[Column], Column], scores: bool, scores_first: bool = False) -> Classes:
    """code: of a rule's status what matters, null where it excludes the pair; scores: whether points tell classes apart, and whether parts that give some come first.

    Parts with few classes of candidates for many of postings come first, so that rows are folded before they become more. The classes of one part go to all tasks.
    """
    checkpoint_folder(posts.sparkSession)
    status, points, wished = statuses(), fit_points(), wishes()
    nothing = F.lit(0).cast("int")
    pairs = None
    for part in parts:
        dims = PARTS[part][4] if scores else ()
        got = sum((F.coalesce(points[d], F.lit(0)) for d in dims), nothing)
        known = sum((F.when(points[d].isNotNull(), FIT[d]).otherwise(0) for d in dims), nothing)
        wish = F.lit(False)
        if scores and part in wished:
            met, n = wished[part]
            got, wish = F.when(F.coalesce(met, F.lit(False)), n).otherwise(0), met.isNotNull()
        value = F.struct((code(F.coalesce(status[part], F.lit(rules.YES))) if part in status else nothing).cast("int").alias("code"), got.cast("int").alias("points"), known.cast("int").alias("known"), wish.alias("wished"))
        own, asked = people.select(_own(part).alias("o")).distinct(), posts.select(_asked(part).alias("a")).distinct()
        each = own.crossJoin(asked).select("o", "a", "o.*", *(F.col(f"a.{c}").alias(c) for c in (*PARTS[part][2], "conflicts")))
        each = each.select(F.lit(part).alias("part"), F.to_json("o").alias("own"), F.to_json("a").alias("asked"), value.alias("v")).filter("v.code is not null")
        pairs = each if pairs is None else pairs.unionByName(each)
    pairs = pairs.checkpoint()
    names = {}
    for side, other in (("own", "asked"), ("asked", "own")):
        alike = pairs.groupBy("part", side).agg(F.array_sort(F.collect_list(F.struct(other, "v"))).alias("like")).groupBy("part", "like").agg(F.collect_list(side).alias("members"))
        names[side] = alike.select("part", "members", F.monotonically_increasing_id().alias("id")).checkpoint()
    name = lambda side: names[side].select("part", F.explode("members").alias(side), F.col("id").alias(f"{side}_id"))
    met = pairs.join(name("own"), ["part", "own"]).join(name("asked"), ["part", "asked"]).select("part", F.col("own_id").alias("own"), F.col("asked_id").alias("asked"), "v.*").distinct().checkpoint()
    sizes = {r["part"]: r for r in met.groupBy("part").agg(F.countDistinct("own").alias("own"), F.countDistinct("asked").alias("asked"), F.max("points").alias("most"), F.bool_or((F.col("points") > 0) | (F.col("known") > 0) | F.col("wished")).alias("scoring")).collect()}
    # a side without any row that may be met has none of the pairs
    parts = [p for p in parts if p in sizes] if len(sizes) == len(parts) else []
    parts.sort(key=lambda p: (scores_first and not sizes[p]["scoring"], sizes[p]["own"] / sizes[p]["asked"], p))

    def named(df: DataFrame, side: str, prefix: str, sees: Callable[[str], Column]) -> DataFrame:
        for part in parts:
            own = name(side).filter(F.col("part") == part).select(F.col(side).alias("_json"), F.col(f"{side}_id").alias(f"{prefix}_{part}"))
            df = df.withColumn("_json", F.to_json(sees(part))).join(F.broadcast(own), "_json").drop("_json")
        return df

    if not parts:
        return Classes(people.limit(0), posts.limit(0), met, [], {}, 0, [])
    people = named(people, "own", "mine", _own).select("candidate", *(f"mine_{p}" for p in parts)).checkpoint()
    there = people.agg(*(F.countDistinct(*(f"mine_{p}" for p in parts[: i + 1])) for i in range(len(parts)))).first()
    possible = [prod(sizes[p]["own"] for p in parts[: i + 1]) for i in range(len(parts))]
    return Classes(people, named(posts, "asked", "theirs", _asked), met, parts, {p: sizes[p]["most"] for p in parts}, sum(sizes[p]["scoring"] for p in parts), [*zip(there, possible, strict=True)])


def _fixed(posts: DataFrame) -> DataFrame:
    """What ranks a posting whoever asks: _tier, _stable, _cover."""
    stable, cover = rules.fit({k: (p, STABILITY[k]) for k, p in stability_points().items()})
    tier = F.array_position(F.array(*map(F.lit, ("T1", "T2", "T3"))), rules.tier(F.col("employment"), F.col("organisation"), F.col("evidenced")))
    return posts.withColumns({"_tier": tier.cast("int"), "_stable": stable.cast("int"), "_cover": cover.cast("int")})


def _coverage() -> Column:
    """Coverage in percent, of what is known of fit and of stability."""
    known = F.col("_known") + F.when(F.col("_wished"), FIT["PREFERENCE_FIT"]).otherwise(0)
    return half_up((F.floor(known * 100 / sum(FIT.values()) + 0.5).cast("long") + F.col("_cover")) / 2)


def _scored(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_fit": F.col("_fit") + F.col("points"), "_known": F.col("_known") + F.col("known"), "_wished": F.col("_wished") | F.col("wished")}).drop("code", "points", "known", "wished")


def best_rows(posts: DataFrame, people: DataFrame, most: int) -> DataFrame:
    """candidate, p_partkey: for each candidate the first `most` postings that no rule excludes, by tier, fit, stability, coverage and key."""
    open_ = classes(posts, people, [*PARTS], lambda s: F.when(s != rules.NO, 0), True)
    if not open_.parts:
        return open_.people.select("candidate", F.lit(0).cast("long").alias("p_partkey"))
    rows = _fixed(open_.posts).select("p_partkey", "_tier", "_stable", "_cover", F.lit(0).alias("_fit"), F.lit(0).alias("_known"), F.lit(False).alias("_wished"), *(f"theirs_{p}" for p in open_.parts))
    order = [F.asc("_tier"), F.desc("_fit"), F.desc("_stable")]
    level = ["_tier", "_fit", "_stable", "_known", "_wished", "_cover"]

    def fold(rows: DataFrame, part: str | None, keys: list[str], left: int) -> DataFrame:
        # rows of a key gain the same from here on; only coverage, which is rounded, may still order those that agree in all before it
        rows = _scored(rows) if part else rows
        nth = F.row_number().over(W.partitionBy(*keys, *level).orderBy("p_partkey"))
        rows = rows.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth")
        return rows.withColumn("_rank", F.rank().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= most).drop("_rank")

    own = [f"mine_{p}" for p in open_.parts]
    place = F.row_number().over(W.partitionBy(*own).orderBy(*order, F.desc("_coverage"), "p_partkey"))
    best = open_.folded(rows, fold).withColumn("_coverage", _coverage()).withColumn("_place", place).filter(F.col("_place") <= most)
    return open_.people.join(best.select(*own, "p_partkey"), own).select("candidate", "p_partkey")


def open_counts(posts: DataFrame, people: DataFrame) -> DataFrame:
    """candidate, n_open, n_eligible, unsure_<rule>: of the postings that no rule excludes, how many there are, how many all rules allow, and how many a rule leaves unsure."""
    kinds = {rules.NO: None, rules.YES: 0, rules.UNSURE: 2}
    open_ = classes(posts, people, [*RULES], lambda s: F.when(s == rules.NO, F.lit(None)).when(s == rules.YES, kinds[rules.YES]).when(s == rules.UNSURE, kinds[rules.UNSURE]).otherwise(1), False)
    counts = ["n_open", "n_eligible", *(f"unsure_{k}" for k in RULES)]
    if not open_.parts:
        return open_.people.select("candidate", *(F.lit(0).cast("long").alias(c) for c in counts))
    rows = open_.posts.select(*(f"theirs_{p}" for p in open_.parts), *(F.lit(1 if c in ("n_open", "n_eligible") else 0).cast("long").alias(c) for c in counts))

    def fold(rows: DataFrame, part: str | None, keys: list[str], left: int) -> DataFrame:
        if part:
            rows = rows.withColumns({"n_eligible": F.when(F.col("code") == kinds[rules.YES], F.col("n_eligible")).otherwise(0), f"unsure_{part}": F.when(F.col("code") == kinds[rules.UNSURE], F.col("n_open")).otherwise(0)})
        return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts))

    own = [f"mine_{p}" for p in open_.parts]
    return open_.people.join(open_.folded(rows, fold), own).select("candidate", *counts)


def advised_counts(posts: DataFrame, people: DataFrame, least: int = 60, covered: int = 50) -> DataFrame:
    """candidate, n_advised: how many postings all rules allow that are covered, not in the last tier and fit."""
    fits = _fixed(posts).filter("_tier < 3")
    sure = classes(fits, people, [*PARTS], lambda s: F.when(s == rules.YES, 0), True, True)
    if not sure.parts:
        return sure.people.select("candidate", F.lit(0).cast("long").alias("n_advised"))
    rows = sure.posts.select(*(f"theirs_{p}" for p in sure.parts), "_cover", F.lit(0).alias("_fit"), F.lit(0).alias("_known"), F.lit(False).alias("_wished"), F.lit(1).cast("long").alias("n_advised"))

    def fold(rows: DataFrame, part: str | None, keys: list[str], left: int) -> DataFrame:
        done = len(sure.parts) - left
        if done <= sure.n_scoring:
            # what cannot reach the least any more goes
            rows = (_scored(rows) if part else rows).filter(F.col("_fit") + sum(sure.most[p] for p in sure.parts[done:]) >= least)
            keys = [*keys, "_cover", "_fit", "_known", "_wished"]
        if done == sure.n_scoring:
            rows, keys = rows.filter(_coverage() >= covered), keys[:-4]
        return rows.groupBy(*keys).agg(F.sum("n_advised").alias("n_advised"))

    return sure.people.join(sure.folded(rows, fold), [f"mine_{p}" for p in sure.parts]).select("candidate", "n_advised")
