"""Queries on plans: scenarios of a candidate, graduate cohorts, routes and their scores (survey R20-R23, A12, A13, O10, O11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.dates import shifted, whole_years
from tessera.operators.windows import islands
from tessera.plans import rules
from tessera.plans.postings import POSTINGS, candidates, picked_sql, postings
from tessera.plans.registry import query
from tessera.session import table

OUTCOMES = ("ELIGIBLE", "CONDITIONALLY_ELIGIBLE", "UNCERTAIN", "INELIGIBLE")
SCENARIOS = ("PRE_GRADUATION", "MASTER_IN_PROGRESS", "DEGREE_PENDING_VERIFICATION", "MASTER_VERIFIED")
MODES = ("HISTORICAL_ACTUAL", "TARGET_YEAR_ANALOG")
TARGET = 2027
#: Employments that count as formal, and weights of a route's components in percent (fixed values).
FORMAL = ("ESTABLISHMENT", "PUBLIC_INSTITUTION_FORMAL")
WEIGHTS = {"ELIGIBILITY_READINESS": 30, "EXPERIENCE_ADVANTAGE": 25, "EMPLOYMENT_STABILITY": 20, "HISTORICAL_SUPPLY": 15, "PREPARATION_REUSE": 10}
#: Routes by what they take (fixed values); a posting may be on several. Those that target sources are known of.
ROUTES = {
    "PUBLIC_TECH": "organisation = 'PUBLIC_INSTITUTION'",
    "UNIVERSITY_HOSPITAL_IT": "organisation in ('UNIVERSITY', 'HOSPITAL')",
    "RESEARCH_SUPPORT": "organisation = 'RESEARCH_INSTITUTE' or family = 'RESEARCH'",
    "GOVERNMENT_SOE_DIGITAL": "organisation in ('STATE_OWNED_ENTERPRISE', 'GOVERNMENT')",
}
COVERED = ("PUBLIC_TECH", "UNIVERSITY_HOSPITAL_IT", "GOVERNMENT_SOE_DIGITAL")
#: Words of a technical title (fixed values).
TECHNICAL = ("信息", "计算机", "软件", "网络", "系统", "数据", "数字", "安全", "开发", "运维", "算法", "智能")
#: Words of a role that bear on a family of postings; work of any kind bears on the others (fixed values). The day on which plans are made.
RELEVANT = {"SOFTWARE": "开发|软件|java|程序|研发", "DATA": "数据|数据库|算法|分析|人工智能|ai", "RESEARCH": "研究|科研|实验|课题|研发", "ADMINISTRATION": ""}
TODAY = "2026-08-20"
CHECKS = ("EDUCATION", "MAJOR", "GRADUATION", "GENDER", "AGE", "EXPERIENCE", "TITLE", "PARTY", "FRESH", "EVIDENCE")


def current_scenario() -> Column:
    """Where a candidate stands, by the record of the master's degree; unconfirmed records count as in progress."""
    master = F.col("own_education") == "MASTER"
    return F.when(~F.array_contains("confirmed", "EDUCATION"), SCENARIOS[1]).when(master & (F.col("completion") == "COMPLETED"), F.when(F.col("verification") == "VERIFIED", SCENARIOS[3]).otherwise(SCENARIOS[2])).when(master & (F.col("completion") == "EXPECTED"), SCENARIOS[1]).otherwise(SCENARIOS[0])


_CURRENT = f"CASE WHEN NOT list_contains(confirmed, 'EDUCATION') THEN '{SCENARIOS[1]}' WHEN own_education = 'MASTER' AND completion = 'COMPLETED' THEN CASE WHEN verification = 'VERIFIED' THEN '{SCENARIOS[3]}' ELSE '{SCENARIOS[2]}' END WHEN own_education = 'MASTER' AND completion = 'EXPECTED' THEN '{SCENARIOS[1]}' ELSE '{SCENARIOS[0]}' END"


def checks(scenario: Column, analog: Column) -> dict[str, Column]:
    """Each check of a posting under a scenario, as a place in OUTCOMES; analog: as if the posting came again in the target year."""
    def sure(field: str) -> Column:
        return F.array_contains("confirmed", field)

    above = F.col("education").isin("MASTER", "DOCTORATE")
    certificate = F.when(F.col("certificate_rule") == "REQUIRED_BY_APPLICATION", 3).when(F.col("certificate_rule") == "AMBIGUOUS", 2).otherwise(1)
    degree = F.when(~above, F.when(sure("EDUCATION"), 0).otherwise(2)).when(scenario.isin(*SCENARIOS[:2]), F.when(sure("EDUCATION"), 1).otherwise(2)).when(scenario == SCENARIOS[2], certificate).otherwise(F.when(sure("EDUCATION"), 0).otherwise(2))
    plain = F.filter("exact", lambda e: ~e.contains("类") & ~e.contains("专业目录"))
    known = sure("MAJORS") & ((scenario == SCENARIOS[0]) | sure("EDUCATION"))
    major = F.when(F.size("exact") == 0, 0).when(~known, 2).when(F.arrays_overlap(plain, "majors"), 0).when(F.size(plain) < F.size("exact"), 2).otherwise(3)
    # before a master's degree the year of the present one counts, else the year of the master's
    before = scenario == SCENARIOS[0]
    year, told = F.when(before, F.col("graduated")).otherwise(F.col("master_year")), F.when(before, sure("GRADUATION")).otherwise(sure("EDUCATION"))
    graduation = F.when(analog | (F.size("accepted") == 0), 0).when(~told | year.isNull(), 2).when(F.array_contains("accepted", year), 0).otherwise(3)
    text = F.coalesce("gender_text", F.lit(""))
    other = (text.contains("男") & (F.col("own_gender") != "MALE")) | (text.contains("女") & (F.col("own_gender") != "FEMALE"))
    gender = F.when((F.trim(text) == "") | text.contains("不限"), 0).when(~sure("GENDER"), 2).when(other, 3).otherwise(0)
    at = F.when(analog, shifted(F.col("cutoff"), F.lit(TARGET) - F.col("year"))).otherwise(F.col("cutoff"))
    age = F.when(F.col("max_age").isNull(), 0).when(~sure("BIRTH") | at.isNull() | (F.col("born") != F.col("born_last")), 2).when(whole_years(F.col("born"), at) > F.col("max_age"), 3).otherwise(0)
    experience = F.when(F.col("min_years").isNull(), 0).when(~sure("EMPLOYMENT"), 2).when(F.coalesce("relevant", F.lit(0)) < F.col("min_years"), 3).otherwise(0)
    owned = F.exists("wanted", lambda w: F.exists("titles", lambda t: (t == w) | F.startswith(t, F.concat(w, F.lit("：")))))
    title = F.when(F.size("wanted") == 0, 0).when(~sure("TITLES"), 2).when(owned, 0).otherwise(3)
    party = F.when(F.col("party_rule") == "REQUIRED", F.when(~sure("PARTY") | (F.col("party") == "UNKNOWN"), 2).when(F.col("party") == "NON_MEMBER", 3).otherwise(0)).when(F.col("party_rule") == "AMBIGUOUS", 2).otherwise(0)
    fresh = F.when((F.size("accepted") == 0) & F.coalesce(F.col("graduates_text").contains("应届"), F.lit(False)), 2).otherwise(0)
    return dict(zip(CHECKS, (degree, major, graduation, gender, age, experience, title, party, fresh, F.when(F.col("evidenced"), 0).otherwise(2)), strict=True))


_SURE = lambda f: f"list_contains(confirmed, '{f}')"
_AT = f"CASE WHEN mode = '{MODES[1]}' THEN cutoff + to_years(CAST({TARGET} - year AS INTEGER)) ELSE cutoff END"
_CHECKS = {
    "EDUCATION": f"CASE WHEN education NOT IN ('MASTER', 'DOCTORATE') THEN CASE WHEN {_SURE('EDUCATION')} THEN 0 ELSE 2 END WHEN scenario IN ('{SCENARIOS[0]}', '{SCENARIOS[1]}') THEN CASE WHEN {_SURE('EDUCATION')} THEN 1 ELSE 2 END WHEN scenario = '{SCENARIOS[2]}' THEN CASE certificate_rule WHEN 'REQUIRED_BY_APPLICATION' THEN 3 WHEN 'AMBIGUOUS' THEN 2 ELSE 1 END WHEN {_SURE('EDUCATION')} THEN 0 ELSE 2 END",
    "MAJOR": f"CASE WHEN len(exact) = 0 THEN 0 WHEN NOT {_SURE('MAJORS')} OR (scenario <> '{SCENARIOS[0]}' AND NOT {_SURE('EDUCATION')}) THEN 2 WHEN len(list_intersect(list_filter(exact, lambda e: NOT contains(e, '类')), majors)) > 0 THEN 0 WHEN len(list_filter(exact, lambda e: contains(e, '类'))) > 0 THEN 2 ELSE 3 END",
    "GRADUATION": f"CASE WHEN mode = '{MODES[1]}' OR len(accepted) = 0 THEN 0 WHEN scenario = '{SCENARIOS[0]}' THEN CASE WHEN NOT {_SURE('GRADUATION')} OR graduated IS NULL THEN 2 WHEN list_contains(accepted, graduated) THEN 0 ELSE 3 END WHEN NOT {_SURE('EDUCATION')} OR master_year IS NULL THEN 2 WHEN list_contains(accepted, master_year) THEN 0 ELSE 3 END",
    "GENDER": f"CASE WHEN gender_text IS NULL OR contains(gender_text, '不限') THEN 0 WHEN NOT {_SURE('GENDER')} THEN 2 WHEN (contains(gender_text, '男') AND own_gender <> 'MALE') OR (contains(gender_text, '女') AND own_gender <> 'FEMALE') THEN 3 ELSE 0 END",
    "AGE": f"CASE WHEN max_age IS NULL THEN 0 WHEN NOT {_SURE('BIRTH')} OR day IS NULL OR born <> born_last THEN 2 WHEN year(day) - year(born) - CASE WHEN month(day) * 100 + day(day) < month(born) * 100 + day(born) THEN 1 ELSE 0 END > max_age THEN 3 ELSE 0 END",
    "EXPERIENCE": f"CASE WHEN min_years IS NULL THEN 0 WHEN NOT {_SURE('EMPLOYMENT')} THEN 2 WHEN coalesce(relevant, 0) < min_years THEN 3 ELSE 0 END",
    "TITLE": f"CASE WHEN len(wanted) = 0 THEN 0 WHEN NOT {_SURE('TITLES')} THEN 2 WHEN len(list_filter(titles, lambda t: t = wanted[1] OR starts_with(t, wanted[1] || '：'))) > 0 THEN 0 ELSE 3 END",
    "PARTY": f"CASE party_rule WHEN 'REQUIRED' THEN CASE WHEN NOT {_SURE('PARTY')} OR party = 'UNKNOWN' THEN 2 WHEN party = 'NON_MEMBER' THEN 3 ELSE 0 END WHEN 'AMBIGUOUS' THEN 2 ELSE 0 END",
    "FRESH": "CASE WHEN len(accepted) = 0 AND contains(coalesce(graduates_text, ''), '应届') THEN 2 ELSE 0 END",
    "EVIDENCE": "CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 0 END",
}
#: Days of work that bear on a family, each once: jobs that overlap count but once.
_WORKED = " UNION ALL ".join(f"SELECT candidate, '{f}' AS kind, mode, unnest(generate_series(s, least(coalesce(e, day), day), INTERVAL 1 DAY)) AS d FROM j WHERE regexp_matches(lower(role), '{words}') AND s <= day" for f, words in RELEVANT.items())
_PROJECTED = f"""{POSTINGS},
  j AS (SELECT candidate, mode, CASE mode WHEN '{MODES[1]}' THEN DATE '{TARGET}-{TODAY[5:]}' ELSE DATE '{TODAY}' END AS day, split_part(job, '|', 1) AS role, CAST(split_part(job, '|', 2) AS DATE) AS s, CAST(nullif(split_part(job, '|', 3), '') AS DATE) AS e FROM (SELECT candidate, unnest(jobs) AS job FROM c) CROSS JOIN (SELECT unnest({list(MODES)}) AS mode)),
  y AS (SELECT candidate, kind, mode, count(DISTINCT d) // 365 AS relevant FROM ({_WORKED}) GROUP BY ALL),
  m AS (SELECT *, {_CURRENT} AS current, {picked_sql('family')} AS kind, {_AT} AS day FROM o CROSS JOIN c CROSS JOIN (SELECT unnest({list(SCENARIOS)}) AS scenario) CROSS JOIN (SELECT unnest({list(MODES)}) AS mode)),
  n AS (SELECT m.*, y.relevant FROM m LEFT JOIN y USING (candidate, kind, mode)),
  k AS (SELECT *, {', '.join(f'{v} AS chk_{k}' for k, v in _CHECKS.items())} FROM n),
  s AS (SELECT *, {list(OUTCOMES)}[1 + greatest({', '.join(f'chk_{k}' for k in CHECKS)})] AS outcome FROM k)"""
_ROUTE = " UNION ALL ".join(f"SELECT '{k}' AS route, * FROM s WHERE {v}" for k, v in ROUTES.items())


def relevant_years(people: DataFrame, days: dict[str, str]) -> DataFrame:
    """candidate, family, mode, relevant: whole years (of 365 days) of work that bears on a family, up to each mode's day; overlapping jobs count once (W05, R21). jobs: role|from|to, to may be missing."""
    part = lambda i: F.split_part("job", F.lit("|"), F.lit(i))
    jobs = people.select("candidate", F.explode("jobs").alias("job")).select("candidate", F.lower(part(1)).alias("role"), part(2).cast("date").alias("start"), F.nullif(part(3), F.lit("")).cast("date").alias("end"))
    bears = F.array_compact(F.array(*(F.when(F.col("role").rlike(words), F.lit(f)) for f, words in RELEVANT.items())))
    at = F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(d).cast("date").alias("day")) for m, d in days.items()))
    each = jobs.withColumn("family", F.explode(bears)).withColumn("at", F.explode(at)).select("candidate", "family", "at.*", "start", F.coalesce("end", "at.day").alias("end"))
    merged = islands(each, ["candidate", "family", "mode"], "start", "end", F.col("day"))
    return merged.groupBy("candidate", "family", "mode").agg(F.floor(F.sum(F.datediff("end", "start") + 1) / 365).cast("int").alias("relevant"))


def projected(spark: SparkSession, sf: str) -> DataFrame:
    """Every posting for every candidate under every scenario, as it was and as if it came again in the target year."""
    c = candidates(spark).withColumn("current", current_scenario())
    each = c.withColumn("scenario", F.explode(F.array(*map(F.lit, SCENARIOS)))).withColumn("mode", F.explode(F.array(*map(F.lit, MODES))))
    years = relevant_years(c, {MODES[0]: TODAY, MODES[1]: f"{TARGET}-{TODAY[5:]}"})
    x = postings(spark, sf).crossJoin(F.broadcast(each))  # candidates are few: see evaluated
    # so are their years of work; by these few keys postings would crowd in a few tasks
    x = x.join(F.broadcast(years), ["candidate", "family", "mode"], "left")
    found = checks(F.col("scenario"), F.col("mode") == MODES[1])
    x = x.withColumns({f"chk_{k}": v for k, v in found.items()})
    return x.withColumn("outcome", F.get(F.array(*map(F.lit, OUTCOMES)), F.greatest(*(F.col(f"chk_{k}") for k in CHECKS))))


def on_routes(x: DataFrame) -> DataFrame:
    """A row for each route that a posting is on."""
    return x.withColumn("route", F.explode(F.array_compact(F.array(*(F.when(F.expr(v), F.lit(k)) for k, v in ROUTES.items())))))


@query(f"WITH {_PROJECTED} SELECT candidate, p_partkey, scenario, mode, outcome, concat_ws(';', {', '.join(f"CASE WHEN chk_{k} > 0 THEN '{k}' END" for k in CHECKS)}) AS reasons FROM s")
def scenario_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome and reasons, scenario by scenario, historical and projected."""
    reasons = F.concat_ws(";", *(F.when(F.col(f"chk_{k}") > 0, F.lit(k)) for k in CHECKS))
    return projected(spark, sf).select("candidate", "p_partkey", "scenario", "mode", "outcome", reasons.alias("reasons"))


@query(f"WITH {_PROJECTED}, r AS ({_ROUTE}) SELECT route, candidate, scenario, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS n_{o.lower()}" for o in OUTCOMES) + f" FROM r WHERE mode = '{MODES[0]}' GROUP BY ALL")
def route_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of a route's postings under each scenario."""
    x = on_routes(projected(spark, sf).filter(F.col("mode") == MODES[0]))
    return x.groupBy("route", "candidate", "scenario").agg(*(F.count_if(F.col("outcome") == o).alias(f"n_{o.lower()}") for o in OUTCOMES))


_COMPONENTS = {
    "ELIGIBILITY_READINESS": f"(100 * count(*) FILTER (outcome = '{OUTCOMES[0]}') + 65 * count(*) FILTER (outcome = '{OUTCOMES[1]}') + 35 * count(*) FILTER (outcome = '{OUTCOMES[2]}')) // count(*)",
    "EXPERIENCE_ADVANTAGE": f"CASE WHEN {_SURE('EMPLOYMENT')} THEN least(100, coalesce(years, 0) * 20) ELSE 0 END",
    "EMPLOYMENT_STABILITY": f"count(*) FILTER (employment IN {FORMAL}) * 100 // count(*)",
    "HISTORICAL_SUPPLY": "least(100, count(*) * 5)",
    "PREPARATION_REUSE": f"CASE WHEN {_SURE('FAMILIES')} THEN len(list_intersect(list_distinct(list(kind)), families)) * 100 // count(DISTINCT kind) ELSE 0 END",
}


@query(f"""WITH {_PROJECTED}, r AS ({_ROUTE}), g AS (SELECT route, candidate, count(*) AS postings, {', '.join(f'{v} AS {k.lower()}' for k, v in _COMPONENTS.items())} FROM r WHERE mode = '{MODES[1]}' AND scenario = current GROUP BY route, candidate, confirmed, years, families),
  i AS (SELECT *, CASE WHEN route IN {COVERED} THEN 'LIMITED' ELSE 'NOT_COVERED' END AS state, CASE WHEN route IN {COVERED} THEN ({' + '.join(f'{k.lower()} * {w}' for k, w in WEIGHTS.items())}) // 100 END AS score FROM g)
  SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY score DESC NULLS LAST, route) AS place FROM i""")
def route_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A route's five components, their weighted index (whole numbers, rounded down), its state, and its place; routes without sources are not ranked."""
    x = on_routes(projected(spark, sf).filter((F.col("mode") == MODES[1]) & (F.col("scenario") == F.col("current"))))
    n = F.count(F.lit(1))
    share = lambda top, of: F.floor(top / of).cast("long")
    count = lambda i: F.count_if(F.col("outcome") == OUTCOMES[i])
    kinds = F.collect_set("family")
    parts = {
        "ELIGIBILITY_READINESS": share(100 * count(0) + 65 * count(1) + 35 * count(2), n),
        "EXPERIENCE_ADVANTAGE": F.first(F.when(F.array_contains("confirmed", "EMPLOYMENT"), F.least(F.lit(100), F.coalesce("years", F.lit(0)) * 20)).otherwise(0)).cast("long"),
        "EMPLOYMENT_STABILITY": share(F.count_if(F.col("employment").isin(*FORMAL)) * 100, n),
        "HISTORICAL_SUPPLY": F.least(F.lit(100), n * 5).cast("long"),
        "PREPARATION_REUSE": F.when(F.first(F.array_contains("confirmed", "FAMILIES")), share(F.size(F.array_intersect(kinds, F.first("families"))) * 100, F.size(kinds))).otherwise(0).cast("long"),
    }
    g = x.groupBy("route", "candidate").agg(n.alias("postings"), *(v.alias(k.lower()) for k, v in parts.items()))
    total = F.lit(0)
    for k, w in WEIGHTS.items():
        total = total + F.col(k.lower()) * w
    covered = F.col("route").isin(*COVERED)
    g = g.withColumn("state", F.when(covered, "LIMITED").otherwise("NOT_COVERED")).withColumn("score", F.when(covered, F.floor(total / 100).cast("long")))
    return g.withColumn("place", F.row_number().over(W.partitionBy("candidate").orderBy(F.col("score").desc_nulls_last(), "route")).cast("long"))


@query(f"WITH {POSTINGS}, s AS (SELECT *, CASE WHEN {' OR '.join(f"contains(title, '{t}')" for t in TECHNICAL)} THEN 1 ELSE 0 END AS technical FROM o), r AS ({_ROUTE}) SELECT route, p_partkey, row_number() OVER (PARTITION BY route ORDER BY technical DESC, p_partkey % 7 <> 0 DESC, year DESC, p_partkey) AS position FROM r QUALIFY position <= 3")
def route_representatives(spark: SparkSession, sf: str) -> DataFrame:
    """Three postings that stand for a route: technical titles first, then those with evidence, the latest, the least id."""
    technical = F.col("title").rlike("|".join(TECHNICAL)).cast("int")
    place = F.row_number().over(W.partitionBy("route").orderBy(technical.desc(), F.col("evidenced").desc(), F.desc("year"), "p_partkey"))
    return on_routes(postings(spark, sf)).withColumn("position", place.cast("long")).filter("position <= 3").select("route", "p_partkey", "position")


@query(f"""WITH k AS (SELECT c_custkey, c_custkey % 5 <> 0 AS sure, c_custkey % 4 AS degree, CASE WHEN c_custkey % 11 <> 0 THEN 2022 + c_custkey % 8 END AS expected FROM customer),
  n AS (SELECT *, CASE WHEN NOT sure OR degree = 1 THEN 2 WHEN degree = 3 THEN 4 WHEN degree = 2 THEN 3 ELSE 1 END AS current FROM k)
  SELECT c_custkey, {list(SCENARIOS)}[current] AS current, array_to_string(CASE WHEN current <= 2 THEN ['{SCENARIOS[2]}', '{SCENARIOS[3]}'] WHEN current = 3 THEN ['{SCENARIOS[3]}'] ELSE [] END, ',') AS future,
  CASE WHEN NOT sure OR expected IS NULL THEN 'UNKNOWN' WHEN expected = {TARGET} THEN 'TARGET_YEAR_GRADUATE' WHEN expected BETWEEN {TARGET - 2} AND {TARGET - 1} THEN 'RECENT_GRADUATE_WINDOW' ELSE 'NOT_IN_GRADUATE_SCOPE' END AS track FROM n""")
def scenario_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Each candidate's scenario now, those that may follow, and the graduate track of the target year."""
    k = F.col("c_custkey")
    degree = k % 4
    c = table(spark, sf, "customer").select(
        k, F.when(degree == 0, "BACHELOR").otherwise("MASTER").alias("own_education"), F.when(degree == 1, "EXPECTED").otherwise("COMPLETED").alias("completion"), F.when(degree == 3, "VERIFIED").otherwise("PLANNED").alias("verification"),
        F.when(k % 5 != 0, F.array(F.lit("EDUCATION"))).otherwise(F.array().cast("array<string>")).alias("confirmed"), F.when(k % 11 != 0, 2022 + k % 8).alias("expected"),
    )
    now = current_scenario()
    future = F.when(now.isin(*SCENARIOS[:2]), ",".join(SCENARIOS[2:])).when(now == SCENARIOS[2], SCENARIOS[3]).otherwise("")
    return c.select(k, now.alias("current"), future.alias("future"), rules.graduate_track(F.col("expected"), F.array_contains("confirmed", "EDUCATION"), TARGET).alias("track"))


#: Graduate rules of notices: state, year of the notice, accepted years (none: unrestricted), foreign graduates included, no employer, no insurance.
COHORTS = [
    ("CONFIRMED", 2026, [2026], True, False, False), ("CONFIRMED", 2026, [2024, 2025, 2026], False, False, False), ("CONFIRMED", 2025, [2024, 2025], True, True, False),
    ("CONFIRMED", 2026, [], True, False, True), ("REVIEW_REQUIRED", 2026, [2026], True, False, False),
]


@query(f"""WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN 2022 + c_custkey % 8 END AS graduated, c_custkey % 3 = 0 AS foreign_degree, c_custkey % 2 = 0 AS worked, c_custkey % 5 <> 0 AS sure, c_custkey % 7 < 3 AS pending FROM customer),
  g(rule, state, year, years, abroad, no_employer, no_insurance) AS (VALUES {', '.join(f"({i}, '{s}', {y}, CAST({ys} AS BIGINT[]), {str(a).lower()}, {str(e).lower()}, {str(n).lower()})" for i, (s, y, ys, a, e, n) in enumerate(COHORTS))}),
  x AS (SELECT *, CASE WHEN mode = '{MODES[0]}' THEN years ELSE list_transform(years, lambda v: v + {TARGET} - year) END AS accepted, CASE WHEN mode = '{MODES[0]}' THEN year ELSE {TARGET} END AS at_year FROM k CROSS JOIN g CROSS JOIN (SELECT unnest({list(MODES)}) AS mode)),
  t AS (SELECT *, CASE WHEN state <> 'CONFIRMED' OR graduated IS NULL THEN 'UNKNOWN' WHEN len(years) > 0 AND NOT list_contains(accepted, graduated) THEN 'NOT_IN_GRADUATE_SCOPE' WHEN len(years) = 0 THEN 'UNRESTRICTED' WHEN graduated = at_year THEN 'TARGET_YEAR_GRADUATE' ELSE 'RECENT_GRADUATE_WINDOW' END AS t FROM x)
  SELECT c_custkey, rule, mode, CASE WHEN t IN ('UNKNOWN', 'NOT_IN_GRADUATE_SCOPE') OR (foreign_degree AND NOT abroad) THEN t WHEN (worked AND no_employer) OR no_insurance OR NOT sure THEN 'CONDITIONAL' ELSE t END AS track,
  CASE WHEN t = 'UNKNOWN' THEN 'UNCERTAIN' WHEN t = 'NOT_IN_GRADUATE_SCOPE' OR (foreign_degree AND NOT abroad) THEN 'INELIGIBLE' WHEN (worked AND no_employer) OR no_insurance THEN 'CONDITIONALLY_ELIGIBLE' WHEN NOT sure THEN 'UNCERTAIN' WHEN pending THEN 'CONDITIONALLY_ELIGIBLE' ELSE 'ELIGIBLE' END AS outcome FROM t""")
def graduate_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate under each graduate rule, as it was and shifted to the target year."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k, F.when(k % 11 != 0, 2022 + k % 8).alias("graduated"), (k % 3 == 0).alias("foreign_degree"), (k % 2 == 0).alias("worked"), (k % 5 != 0).alias("sure"), (k % 7 < 3).alias("pending"))
    g = spark.createDataFrame([(i, *r) for i, r in enumerate(COHORTS)], "rule int, state string, year int, years array<int>, abroad boolean, no_employer boolean, no_insurance boolean")
    x = c.crossJoin(F.broadcast(g)).withColumn("mode", F.explode(F.array(*map(F.lit, MODES))))  # five rules, fixed here
    track, outcome = rules.graduate_projection("graduated", F.col("mode") == MODES[0], TARGET)
    return x.select("c_custkey", F.col("rule").cast("long").alias("rule"), "mode", track.alias("track"), outcome.alias("outcome"))
