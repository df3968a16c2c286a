"""Postings and candidates for the decision queries.

The tables hold no notices, so every part stands for a posting: its key deals it texts as notices word them, and
each text is listed with the value that a reader would take from it. The Spark side parses the text; the SQL side
takes the listed value, so a parser that is wrong shows.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.scan import dealt
from tessera.plans import rules
from tessera.session import table

#: By field: how many parts in a row share a choice, and the choices, each a text and what it says.
CHOICES: dict[str, tuple[int, list[tuple[object, object]]]] = {
    "employment": (1, [(e, e) for e in (*rules.EMPLOYMENT_POINTS, "UNKNOWN")]),
    "title": (2, [("软件开发工程师", None), ("数据库管理员", None), ("信息系统运维", None), ("行政助理", None), ("算法研究员", None), ("软件销售", None), ("计算机教师", None)]),
    "organisation": (3, [(o, o) for o in (*rules.SEMI_PUBLIC, "PRIVATE_COMPANY")]),
    "experience": (5, [("3年以上工作经验", 3), ("无工作经验要求", 0), ("工作经验不限", 0), ("2020年至今有5年工作经历", 5), ("应届优先，2年经验", None), ("不限，须有管理经验", None), (None, None)]),
    "age": (7, [("35周岁以下", 35), ("18至40周岁", 40), ("35岁（不含）以下", 34), ("1990年1月1日后出生，35岁以下", 35), ("博士可放宽至40岁", None), ("28岁以下或35岁以下", None), ("30岁", 30), (None, None)]),
    "education": (11, [(e, e) for e in rules.EDUCATION]),
    "majors": (4, [("计算机科学与技术、软件工程", ["计算机科学与技术", "软件工程"]), ("计算机类", ["计算机类"]), ("法学", ["法学"]), ("数学；统计学", ["数学", "统计学"]), (None, [])]),
    "graduates": (13, [(None, []), ("2026届毕业生", [2026]), ("2024届、2025届、2026届毕业生", [2024, 2025, 2026]), ("应届毕业生", [])]),
    "wanted_title": (6, [(None, []), ("中级工程师", ["中级工程师"]), ("高级工程师", ["高级工程师"]), ("具有相应职称", [])]),
    "party": (17, [(None, False), ("限中共党员", True), ("中共党员优先", False), ("政治面貌不限；其他无", False), ("须为中共党员或民主党派", False), ("政治面貌要求：中共党员。能出差", True)]),
    "gender": (19, [(None, "FREE"), ("男", "MALE"), ("女性", "FEMALE"), ("不 限（男、女）", "FREE"), ("性别：不、限；女", "FREE"), ("男女各一名", "UNCLEAR"), ("男性优先", "FREE"), ("见附件", "UNCLEAR")]),
    "fresh": (23, [(None, "00"), ("NOT_REQUIRED", "11"), ("CONFIRMED", "10"), ("CONFIRMED", "01"), ("CONFIRMED", "11"), ("REVIEW_REQUIRED", "10"), ("REVIEW_REQUIRED", "00")]),
    "conflict": (29, [("", ""), ("", ""), ("", ""), ("AGE", "AGE"), ("EDUCATION", "EDUCATION"), ("EXACT_MAJOR", "EXACT_MAJOR")]),
    "cutoff": (31, [("2026-06-30", "2026-06-30")] * 7 + [(None, None)]),
    "scope": (12, [(None, "NONE"), ("党员优先", "PREFERENCE"), ("限中共党员；其他优先", "REQUIRED"), ("党员或民主党派成员", "AMBIGUOUS"), ("党员优先；党员或团员", "AMBIGUOUS")]),
    "certificate": (10, [(None, "NOT_REQUIRED"), ("境外学历须在报名前完成认证", "REQUIRED_BY_APPLICATION"), ("应提供认证；录用前须完成认证", "REQUIRED_LATER"), ("须完成学历认证", "AMBIGUOUS"), ("在读期间无需认证", "NOT_REQUIRED")]),
    "place": (8, [("杭州市西湖区", None), ("宁波市", None), ("上海市", None)]),
    "family": (9, [("SOFTWARE", None), ("DATA", None), ("RESEARCH", None), ("ADMINISTRATION", None)]),
}
#: Facts about an organisation: achieved of four points by the key; some are not known.
FACTS = tuple(enumerate(rules.ORGANISATION_POINTS.items(), 2))

#: Candidates: one whose facts are all confirmed, one with gaps, one of whom nothing is confirmed. A user passes profiles of their own.
CANDIDATE = "candidate int, born date, born_last date, education string, completion string, verification string, majors array<string>, graduated int, years int, titles array<string>, party string, gender string, employer string, insurance string, skills array<string>, research array<string>, places array<string>, employments array<string>, families array<string>, organisations array<string>, confirmed array<string>, master_year int, jobs array<string>"
FIELDS = ("BIRTH", "EDUCATION", "MAJORS", "GRADUATION", "EMPLOYMENT", "TITLES", "PARTY", "GENDER", "SKILLS", "RESEARCH", "PLACES", "EMPLOYMENTS", "FAMILIES", "ORGANISATIONS")
PROFILES = [
    (1, "1991-03-15", "1991-03-15", "MASTER", "COMPLETED", "VERIFIED", ["计算机科学与技术"], 2024, 4, ["中级工程师：信息系统"], "CPC_MEMBER", "MALE", "DECLARED_MET", "DECLARED_MET", ["数据库", "软件"], ["算法"], ["杭州"], ["ESTABLISHMENT"], ["SOFTWARE", "DATA"], ["UNIVERSITY"], [*FIELDS], 2024, ["软件开发工程师|2019-03-01|2021-02-28", "数据分析师|2020-06-01|2024-05-31", "行政|2024-06-01|"]),
    (2, "1991-06-01", "1991-06-30", "MASTER", "EXPECTED", "PLANNED", ["软件工程", "数学"], 2026, None, [], "NON_MEMBER", "FEMALE", "DECLARED_MET", "DECLARED_NOT_MET", ["数据库", "运维", "测试"], [], ["上海", "宁波"], ["CONTRACT", "SOE_FORMAL"], [], ["HOSPITAL"], [f for f in FIELDS if f not in ("TITLES", "RESEARCH")], 2026, ["Java 程序员|2023-01-01|", "研究助理|2021-01-01|2022-12-31"]),
    (3, "1980-01-01", "1980-01-01", "BACHELOR", "COMPLETED", "VERIFIED", ["法学"], 2002, 9, ["高级工程师"], "UNKNOWN", "MALE", "UNDECLARED", "UNDECLARED", ["软件"], [], ["杭州"], [], [], [], [], None, ["法务|2010-01-01|2020-01-01", "软件研发|2020-01-02|"]),
]
#: The rules of a decision, in order, and the dimensions of fit and of stability with their most points.
RULES = ("AGE", "EDUCATION", "EXACT_MAJOR", "GRADUATE_YEAR", "EXPERIENCE", "PROFESSIONAL_TITLE", "POLITICAL_AFFILIATION", "GENDER", "FRESH_GRADUATE_STATUS")
FIT = {"MAJOR_FIT": 25, "SKILL_FIT": 20, "EXPERIENCE_FIT": 20, "RESEARCH_FIT": 10, "PROFESSIONAL_TITLE_FIT": 10, "PREFERENCE_FIT": 15}
STABILITY = {"EMPLOYMENT_SECURITY": 30, **rules.ORGANISATION_POINTS, "CONTRACT_RISK": 10}


def picked(name: str, key: str = "p_partkey") -> Column:
    """The text of a field that a key is dealt."""
    stride, choices = CHOICES[name]
    return F.element_at(F.array(*(F.lit(t) for t, _ in choices)), (F.floor(F.col(key) / stride) % len(choices) + 1).cast("int"))


def literal(value: object) -> str:
    """A value as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def picked_sql(name: str, said: bool = False, key: str = "p_partkey") -> str:
    """The text (or what it says) as SQL."""
    stride, choices = CHOICES[name]
    return f"([{', '.join(literal(c[said]) for c in choices)}])[1 + (CAST({key} AS BIGINT) // {stride}) % {len(choices)}]"


def postings(spark: SparkSession, sf: str) -> DataFrame:
    """A row per part, with what its texts say (P01). Keys are read in a few tasks, texts in as many as an exchange has."""
    p = dealt(table(spark, sf, "part").select("p_partkey", "p_type"), "p_partkey").select("p_partkey", "p_type", *(picked(k).alias(k) for k in CHOICES if k != "fresh"))
    stride, choices = CHOICES["fresh"]
    turn = (F.floor(F.col("p_partkey") / stride) % len(choices) + 1).cast("int")
    clause = F.element_at(F.array(*(F.struct(F.lit(s).cast("string").alias("state"), F.lit(w[0] == "1").alias("employer"), F.lit(w[1] == "1").alias("insurance")) for s, w in choices)), turn)
    return p.select(
        "p_partkey", "p_type", "employment", "title", "organisation", "education", "place", "family", clause.alias("clause"),
        tx.age_limit(F.col("age")).alias("max_age"), tx.experience_years(F.col("experience")).alias("min_years"), tx.split_list(F.col("majors")).alias("exact"), F.col("majors").alias("majors_text"),
        tx.years_in(F.col("graduates")).alias("accepted"), F.col("graduates").alias("graduates_text"),
        F.when(F.col("wanted_title").endswith("工程师"), F.array("wanted_title")).otherwise(F.array().cast("array<string>")).alias("wanted"), F.col("wanted_title").alias("wanted_text"),
        rules.party_required(F.col("party")).alias("party_required"), F.col("gender").alias("gender_text"), F.array("conflict").alias("conflicts"), F.col("cutoff").cast("date").alias("cutoff"),
        (F.col("p_partkey") % 7 != 0).alias("evidenced"), rules.party_rule(F.col("scope")).alias("party_rule"), rules.certificate_rule(F.col("certificate")).alias("certificate_rule"), (2024 + F.col("p_partkey") % 3).cast("int").alias("year"),
        *(F.when(F.floor(F.col("p_partkey") / (i + 1)) % 4 != 0, F.floor(F.col("p_partkey") / i) % 5 / 4).alias(name) for i, (name, _) in FACTS),
    )


def candidates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(PROFILES, CANDIDATE.replace(" date", " string"))
    return rows.withColumns({c: F.col(c).cast("date") for c in ("born", "born_last")}).withColumnsRenamed({"education": "own_education", "gender": "own_gender"})


#: Decisions of the given candidates, by session and folder: their plan is long, so it is built and analysed once.
_EVALUATED: WeakKeyDictionary[SparkSession, dict[str, DataFrame]] = WeakKeyDictionary()


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    """Every posting for each of the given candidates (PROFILES, a fixed few that go to the postings); see decided(). Of many candidates, pair them by matching.open_pairs."""
    known = _EVALUATED.setdefault(spark, {})
    if sf not in known:
        known[sf] = decided(postings(spark, sf).crossJoin(F.broadcast(candidates(spark))))
    return known[sf]


def _sure(field: str) -> Column:
    return F.array_contains("confirmed", field)


def _own(column: str, field: str) -> Column:
    return F.when(_sure(field), F.col(column)).otherwise(F.array().cast("array<string>"))


def statuses() -> dict[str, Column]:
    """The status of each rule, of a pair's columns."""
    years = F.when(_sure("EMPLOYMENT"), F.col("years"))
    return {
        "AGE": rules.unless_conflict(rules.age(F.col("born"), F.col("born_last"), _sure("BIRTH"), F.col("max_age"), F.col("cutoff")), F.col("conflicts"), "AGE"),
        "EDUCATION": rules.unless_conflict(rules.education(F.col("own_education"), _sure("EDUCATION"), F.col("education"), F.col("completion"), F.col("verification")), F.col("conflicts"), "EDUCATION"),
        "EXACT_MAJOR": rules.unless_conflict(rules.major(F.col("majors"), _sure("MAJORS"), F.col("exact"), F.col("majors_text")), F.col("conflicts"), "EXACT_MAJOR"),
        "GRADUATE_YEAR": rules.graduation(F.col("graduated"), _sure("GRADUATION"), F.col("accepted"), F.col("graduates_text")),
        "EXPERIENCE": rules.experience(years, F.col("min_years"), F.col("cutoff")),
        "PROFESSIONAL_TITLE": rules.title(F.col("titles"), _sure("TITLES"), F.col("wanted"), F.col("wanted_text")),
        "POLITICAL_AFFILIATION": rules.affiliation(F.col("party"), _sure("PARTY"), F.col("party_required")),
        "GENDER": rules.gender(F.col("own_gender"), _sure("GENDER"), F.col("gender_text")),
        "FRESH_GRADUATE_STATUS": rules.fresh_graduate(F.col("clause.state"), F.col("clause.employer"), F.col("clause.insurance"), F.col("employer"), F.col("insurance")),
    }


def wishes() -> dict[str, tuple[Column, int]]:
    """By preference whether a posting meets it (null: none stated), and its points."""
    umbrella = F.arrays_overlap("employments", F.array(F.lit("ESTABLISHMENT"), F.lit("PUBLIC_INSTITUTION_FORMAL"))) & F.col("employment").isin("QUOTA_OR_FILING", "UNIT_FORMAL", "SOE_FORMAL")
    stated = {"PLACES": (lambda a: F.exists(a, lambda p: F.contains(F.col("place"), p)), 5), "EMPLOYMENTS": (lambda a: F.array_contains(a, F.col("employment")) | ((F.size(a) > 0) & umbrella), 5), "FAMILIES": (lambda a: F.array_contains(a, F.col("family")), 3), "ORGANISATIONS": (lambda a: F.array_contains(a, F.col("organisation")), 2)}
    return {k: (F.when(F.size(_own(k.lower(), k)) > 0, met(_own(k.lower(), k))), n) for k, (met, n) in stated.items()}


def fit_points() -> dict[str, Column]:
    """The points of each dimension of fit, of a pair's columns."""
    years = F.when(_sure("EMPLOYMENT"), F.col("years"))
    return {
        "MAJOR_FIT": rules.overlap_points(_own("majors", "MAJORS"), F.col("exact"), 25),
        "SKILL_FIT": rules.mentioned_points(_own("skills", "SKILLS"), F.col("title"), 20),
        "EXPERIENCE_FIT": F.when(F.col("min_years").isNotNull() & F.col("cutoff").isNotNull() & years.isNotNull(), F.when(years >= F.col("min_years"), 20).otherwise(0)),
        "RESEARCH_FIT": rules.mentioned_points(_own("research", "RESEARCH"), F.col("title"), 10),
        "PROFESSIONAL_TITLE_FIT": rules.overlap_points(_own("titles", "TITLES"), F.col("wanted"), 10),
        "PREFERENCE_FIT": rules.preference([*wishes().values()]),
    }


def stability_points() -> dict[str, Column]:
    """The points of each dimension of stability, of a posting's columns."""
    return dict(zip(STABILITY, rules.stability_points(F.col("employment"), [(F.col(name), most) for name, most in rules.ORGANISATION_POINTS.items()]), strict=True))


def decided(x: DataFrame) -> DataFrame:
    """Pairs of a posting and a candidate, with the columns of both: the status of each rule, the points of each dimension, and what follows."""
    x = x.select("candidate", "p_partkey", "p_type", "title", "employment", "organisation", "evidenced", *(s.alias(f"rule_{k}") for k, s in statuses().items()), *(p.alias(k) for k, p in (fit_points() | stability_points()).items()))
    score, cover = rules.fit({k: (F.col(k), most) for k, most in FIT.items()})
    stability, stable_cover = rules.fit({k: (F.col(k), most) for k, most in STABILITY.items()})
    x = x.withColumns({"status": rules.worst(*(F.col(f"rule_{k}") for k in RULES)), "fit": score, "stability": stability, "coverage": tx.half_up((cover + stable_cover) / 2)})
    tier, advised = rules.decision(F.col("status"), rules.tier(F.col("employment"), F.col("organisation"), F.col("evidenced")), F.col("fit"), F.col("coverage"))
    return x.withColumns({"tier": tier, "advised": advised})


def profiles_sql() -> str:
    names = [c.split()[0] for c in CANDIDATE.split(", ")]
    kinds = {n: k for n, k in (c.split() for c in CANDIDATE.split(", "))}
    casts = {"int": "BIGINT", "date": "DATE", "string": "VARCHAR", "array<string>": "VARCHAR[]"}
    rows = [", ".join(f"CAST({literal(v)} AS {casts[kinds[n]]})" for n, v in zip(names, p, strict=True)) for p in PROFILES]
    return "c(" + ", ".join(n if n not in ("education", "gender") else f"own_{n}" for n in names) + ") AS (VALUES " + ", ".join(f"({r})" for r in rows) + ")"


def _years(born: str) -> str:
    return f"(year(cutoff) - year({born}) - CASE WHEN month(cutoff) * 100 + day(cutoff) < month({born}) * 100 + day({born}) THEN 1 ELSE 0 END)"


def _sure_sql(field: str) -> str:
    return f"list_contains(confirmed, '{field}')"


def _points(points: dict[str, int]) -> str:
    return "CASE employment " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in points.items()) + " END"


def _share(hits: str, of: str, most: int) -> str:
    return f"CAST(floor(CAST({most} * {hits} / CAST(len({of}) AS DOUBLE) AS FLOAT) + 0.5) AS BIGINT)"


_RANK = f"list_position({literal(list(rules.EDUCATION))}, "
_OWN = {k: f"CASE WHEN {_sure_sql(f)} THEN {k} ELSE [] END" for k, f in (("majors", "MAJORS"), ("skills", "SKILLS"), ("research", "RESEARCH"), ("titles", "TITLES"), ("places", "PLACES"), ("employments", "EMPLOYMENTS"), ("families", "FAMILIES"), ("organisations", "ORGANISATIONS"))}
_MENTIONED = "len(list_filter({0}, lambda w: contains(title, w)))"
_DECLARED = "CASE WHEN NOT {0} THEN 0 WHEN {1} = 'DECLARED_MET' THEN 1 WHEN {1} = 'DECLARED_NOT_MET' THEN 4 ELSE 2 END"
_SEVERITY = {
    "AGE": f"CASE WHEN conflict = 'AGE' THEN 3 WHEN max_age IS NULL OR cutoff IS NULL OR NOT {_sure_sql('BIRTH')} THEN 2 WHEN {_years('born')} <= max_age THEN 0 WHEN {_years('born_last')} > max_age THEN 4 ELSE 2 END",
    "EDUCATION": f"CASE WHEN conflict = 'EDUCATION' THEN 3 WHEN education = 'UNKNOWN' OR NOT {_sure_sql('EDUCATION')} OR own_education = 'UNKNOWN' THEN 2 WHEN {_RANK}own_education) < {_RANK}education) THEN 4 WHEN completion = 'EXPECTED' OR verification IN ('PLANNED', 'IN_PROGRESS') THEN 1 WHEN verification = 'UNKNOWN' THEN 2 ELSE 0 END",
    "EXACT_MAJOR": f"CASE WHEN conflict = 'EXACT_MAJOR' THEN 3 WHEN len(exact) = 0 THEN CASE WHEN majors_text IS NULL THEN 0 ELSE 2 END WHEN NOT {_sure_sql('MAJORS')} OR len(majors) = 0 THEN 2 WHEN len(list_intersect(exact, majors)) > 0 THEN 0 WHEN len(list_filter(exact, lambda e: ends_with(e, '类'))) > 0 THEN 2 ELSE 4 END",
    "GRADUATE_YEAR": f"CASE WHEN len(accepted) = 0 THEN CASE WHEN graduates_text IS NULL THEN 0 ELSE 2 END WHEN NOT {_sure_sql('GRADUATION')} OR graduated IS NULL THEN 2 WHEN list_contains(accepted, graduated) THEN 0 ELSE 4 END",
    "EXPERIENCE": f"CASE WHEN min_years IS NULL THEN 2 WHEN min_years = 0 THEN 0 WHEN cutoff IS NULL OR NOT {_sure_sql('EMPLOYMENT')} OR years IS NULL THEN 2 WHEN years >= min_years THEN 0 ELSE 4 END",
    "PROFESSIONAL_TITLE": f"CASE WHEN len(wanted) = 0 THEN CASE WHEN wanted_text IS NULL THEN 0 ELSE 2 END WHEN NOT {_sure_sql('TITLES')} THEN 2 WHEN len(list_filter(titles, lambda t: t = wanted[1] OR starts_with(t, wanted[1] || '：'))) > 0 THEN 0 ELSE 4 END",
    "POLITICAL_AFFILIATION": f"CASE WHEN NOT party_required THEN 0 WHEN NOT {_sure_sql('PARTY')} THEN 2 WHEN party = 'CPC_MEMBER' THEN 0 WHEN party = 'NON_MEMBER' THEN 4 ELSE 2 END",
    "GENDER": f"CASE WHEN sex = 'FREE' THEN 0 WHEN sex = 'UNCLEAR' OR NOT {_sure_sql('GENDER')} THEN 2 WHEN own_gender = sex THEN 0 ELSE 4 END",
    "FRESH_GRADUATE_STATUS": f"CASE WHEN state IS NULL THEN 2 WHEN state = 'NOT_REQUIRED' OR asked = '00' THEN 0 WHEN state <> 'CONFIRMED' THEN 2 ELSE greatest({_DECLARED.format("(asked[1] = '1')", 'employer')}, {_DECLARED.format("(asked[2] = '1')", 'insurance')}) END",
}
_DIMENSIONS = {
    "MAJOR_FIT": f"CASE WHEN len({_OWN['majors']}) > 0 AND len(exact) > 0 THEN {_share(f'len(list_intersect(exact, majors))', 'exact', 25)} END",
    "SKILL_FIT": f"CASE WHEN len({_OWN['skills']}) > 0 THEN {_share(_MENTIONED.format('skills'), 'skills', 20)} END",
    "EXPERIENCE_FIT": f"CASE WHEN min_years IS NOT NULL AND cutoff IS NOT NULL AND {_sure_sql('EMPLOYMENT')} AND years IS NOT NULL THEN CASE WHEN years >= min_years THEN 20 ELSE 0 END END",
    "RESEARCH_FIT": f"CASE WHEN len({_OWN['research']}) > 0 THEN {_share(_MENTIONED.format('research'), 'research', 10)} END",
    "PROFESSIONAL_TITLE_FIT": f"CASE WHEN len({_OWN['titles']}) > 0 AND len(wanted) > 0 THEN {_share('len(list_intersect(wanted, titles))', 'wanted', 10)} END",
    "PREFERENCE_FIT": f"CASE WHEN {' OR '.join(f'len({_OWN[k]}) > 0' for k in ('places', 'employments', 'families', 'organisations'))} THEN CASE WHEN len(list_filter({_OWN['places']}, lambda w: contains(place, w))) > 0 THEN 5 ELSE 0 END + CASE WHEN list_contains({_OWN['employments']}, employment) OR (len(list_intersect({_OWN['employments']}, ['ESTABLISHMENT', 'PUBLIC_INSTITUTION_FORMAL'])) > 0 AND employment IN ('QUOTA_OR_FILING', 'UNIT_FORMAL', 'SOE_FORMAL')) THEN 5 ELSE 0 END + CASE WHEN list_contains({_OWN['families']}, family) THEN 3 ELSE 0 END + CASE WHEN list_contains({_OWN['organisations']}, organisation) THEN 2 ELSE 0 END END",
    "EMPLOYMENT_SECURITY": _points(rules.EMPLOYMENT_POINTS),
    **{name: f"CASE WHEN (CAST(p_partkey AS BIGINT) // {i + 1}) % 4 <> 0 THEN CAST(floor(((CAST(p_partkey AS BIGINT) // {i}) % 5) / 4.0 * {most} + 0.5) AS BIGINT) END" for i, (name, most) in FACTS},
    "CONTRACT_RISK": _points(rules.CONTRACT_POINTS),
}


def _total(dimensions: dict[str, int]) -> tuple[str, str]:
    known = " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {m} END" for k, m in dimensions.items())
    return " + ".join(f"coalesce({k}, 0)" for k in dimensions), f"CAST(floor(({known}) * 100 / {sum(dimensions.values())}.0 + 0.5) AS BIGINT)"


#: Common table expressions c (candidates) and o (postings with what their texts say).
POSTINGS = f"""{profiles_sql()},
  o AS (SELECT p_partkey, p_type, {', '.join(f'{picked_sql(k)} AS {k}' for k in ('employment', 'title', 'organisation', 'education', 'place', 'family', 'conflict'))}, {picked_sql('fresh')} AS state, {picked_sql('fresh', True)} AS asked, {picked_sql('age', True)} AS max_age, {picked_sql('experience', True)} AS min_years,
    {picked_sql('majors', True)} AS exact, {picked_sql('majors')} AS majors_text, {picked_sql('graduates', True)} AS accepted, {picked_sql('graduates')} AS graduates_text, {picked_sql('wanted_title', True)} AS wanted, {picked_sql('wanted_title')} AS wanted_text, {picked_sql('party', True)} AS party_required, {picked_sql('gender', True)} AS sex, CAST({picked_sql('cutoff')} AS DATE) AS cutoff, {picked_sql('scope', True)} AS party_rule, {picked_sql('certificate', True)} AS certificate_rule, {picked_sql('gender')} AS gender_text, 2024 + p_partkey % 3 AS year FROM part)"""
#: Common table expressions that give d, the same as evaluated(): sev_ and the rule for severities, dimensions, status, fit, stability, coverage, tier, advised.
EVALUATED = f"""{POSTINGS},
  r AS (SELECT candidate, p_partkey, p_type, title, employment, organisation, {', '.join(f'{s} AS sev_{k}' for k, s in _SEVERITY.items())}, {', '.join(f'{s} AS {k}' for k, s in _DIMENSIONS.items())} FROM o CROSS JOIN c),
  t AS (SELECT *, greatest({', '.join(f'sev_{k}' for k in RULES)}) AS sev, {_total(FIT)[0]} AS fit, {_total(STABILITY)[0]} AS stability, CAST(floor(({_total(FIT)[1]} + {_total(STABILITY)[1]}) / 2.0 + 0.5) AS BIGINT) AS coverage,
    CASE WHEN p_partkey % 7 <> 0 AND employment = 'ESTABLISHMENT' THEN 'T1' WHEN p_partkey % 7 <> 0 AND list_contains({literal(rules.SECOND_TIER)}, employment) AND list_contains({literal(rules.SEMI_PUBLIC)}, organisation) THEN 'T2' ELSE 'T3' END AS plain_tier FROM r),
  d AS (SELECT *, ['ELIGIBLE', 'CONDITIONAL', 'NEEDS_CONFIRMATION', 'CONFLICTING_EVIDENCE', 'INELIGIBLE'][sev + 1] AS status, CASE WHEN sev = 4 THEN 'EXCLUDED' ELSE plain_tier END AS tier, (sev = 0 AND coverage >= 50 AND plain_tier <> 'T3' AND fit >= 60) AS advised FROM t)"""
STATUS = "['ELIGIBLE', 'CONDITIONAL', 'NEEDS_CONFIRMATION', 'CONFLICTING_EVIDENCE', 'INELIGIBLE']"
