"""The older eligibility check of nine criteria, from texts as notices word them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dates import whole_years
from tessera.plans.changes import PRICE, snapshots
from tessera.plans.notices import PUBLIC, watch_action, watch_tier
from tessera.plans.postings import literal, picked_sql, postings
from tessera.plans.registry import ORACLE, query
from tessera.plans.rules import legacy_status
from tessera.session import checkpoint_folder, table
from tessera.sources.state import VersionedState

CRITERIA = ("education", "degree", "major", "age", "experience", "political_status", "professional_title", "applicant_type", "other_conditions")
#: Levels by the first words found; conditions that are part of an examination, and words of a hard condition (fixed values).
LEVELS = (("博士", 4), ("硕士|研究生", 3), ("本科|学士", 2), ("专科|大专", 1))
EXAMINED = "面试|笔试|考试|测试|开考比例"
HARD = "须|要求|具有|持有|取得|仅限|不得|工作经历|党员|职称|资格|户籍|性别|社保|未落实|留服"

#: What parts are dealt as requirements: how many in a row share a choice, and the choices.
ASKED: dict[str, tuple[int, str, list]] = {
    "education": (1, "string", ["硕士研究生及以上", "本科及以上", "大专", None, "不限"]),
    "degree": (2, "string", [None, "硕士", "学士及以上"]),
    "majors": (3, "string", ["计算机科学与技术、软件工程", "法学", None, "（计算机 科学与技术）"]),
    "age_years": (5, "int", [35, 40, None, 60]),
    "boundary": (7, "date", [None, "1991-03-15", "1985-01-01", None, "1999-01-01"]),
    "deadline": (4, "string", ["2026-06-30T17:00:00+08:00", "2026-05-01", "见附件", None]),
    "years": (6, "double", [None, 3.0, 5.0, 0.0]),
    "political": (8, "string", [None, "中共党员", "中共党员或群众"]),
    "titles": (9, "array<string>", [[], ["中级工程师"], ["高级 工程师", "律师"]]),
    "applicant": (10, "string", [None, "2026届高校毕业生", "应届毕业生", "社会人员"]),
    "others": (12, "array<string>", [[], ["面试须携带证件"], ["须服从调剂", "笔试"], ["无犯罪记录"], ["持有驾照"]]),
}
#: Candidates: each fact with its state (CONFIRMED, EXPECTED, UNKNOWN); the birth's last possible day; titles that are confirmed.
FACTS = "candidate int, own_education string, education_state string, own_degree string, degree_state string, own_major string, major_state string, born string, born_last string, own_years double, years_state string, own_political string, political_state string, own_titles array<string>, graduate string"
PEOPLE = [
    (1, "硕士", "CONFIRMED", "硕士", "EXPECTED", "计算机科学与技术", "CONFIRMED", "1991-03-01", "1991-03-31", 4.0, "CONFIRMED", "中共党员", "CONFIRMED", ["中级工程师（信息系统）"], "2027届"),
    (2, "本科", "CONFIRMED", None, "UNKNOWN", "软件工程", "EXPECTED", "1985-01-01", "1985-01-01", 2.0, "CONFIRMED", "群众", "CONFIRMED", [], None),
    (3, None, "UNKNOWN", "学士", "CONFIRMED", None, "UNKNOWN", None, None, None, "UNKNOWN", None, "UNKNOWN", ["高级工程师"], "2026届"),
]


def _blank(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit("")) == ""


def _form(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\s、，,；;（）()]+", ""))


def _level(x: Column) -> Column:
    out = F.lit(0)
    for words, n in reversed(LEVELS):
        out = F.when(x.rlike(words), n).otherwise(out)
    return out


def criteria() -> dict[str, Column]:
    """PASS, CONDITIONAL, UNKNOWN or FAIL for each criterion; null where it does not apply."""
    c = F.col

    def level(asked: str, own: str, state: str) -> Column:
        low = (_level(c(asked)) > 0) & (_level(c(own)) > 0) & (_level(c(own)) < _level(c(asked)))
        return F.when(~_blank(c(asked)), F.when(_blank(c(own)) | (c(state) == "UNKNOWN"), "UNKNOWN").when(low, "FAIL").when(c(state) == "EXPECTED", "CONDITIONAL").otherwise("PASS"))

    major = F.when(_blank(c("own_major")) | (c("major_state") == "UNKNOWN") | ~F.contains(_form(c("majors")), _form(c("own_major"))), "UNKNOWN").when(c("major_state") == "CONFIRMED", "PASS").otherwise("CONDITIONAL")
    born, last = c("born").cast("date"), c("born_last").cast("date")
    by_day = F.when(born > c("boundary"), "PASS").when(last <= c("boundary"), "FAIL").otherwise("UNKNOWN")
    until = F.try_to_date(F.substring("deadline", 1, 10), "yyyy-MM-dd")
    by_age = F.when(c("age_years").isNull() | until.isNull(), "UNKNOWN").when(whole_years(born, until) <= c("age_years"), "PASS").when(whole_years(last, until) > c("age_years"), "FAIL").otherwise("UNKNOWN")
    age = F.when(c("born").isNull(), "UNKNOWN").when(c("boundary").isNotNull(), by_day).otherwise(by_age)
    years = F.when(c("own_years").isNull() | (c("years_state") == "UNKNOWN"), "UNKNOWN").when(c("own_years") < c("years"), "FAIL").otherwise("PASS")
    political = F.when(_blank(c("own_political")) | (c("political_state") == "UNKNOWN"), "UNKNOWN").when(F.contains(_form(c("political")), _form(c("own_political"))), "PASS").otherwise("FAIL")
    wanted = _form(F.array_join("titles", "；"))
    titled = F.exists("own_titles", lambda t: F.contains(wanted, _form(t)) | F.contains(_form(t), wanted) | (wanted.contains("中级") & _form(t).contains("中级")))
    applicant = F.when(c("applicant").contains("2026") & F.coalesce(c("graduate").contains("2027"), F.lit(False)), "FAIL").when(c("applicant").rlike("应届|毕业生"), "CONDITIONAL").otherwise("UNKNOWN")
    hard = F.exists("others", lambda o: ~_blank(o) & ~o.rlike(EXAMINED) & o.rlike(HARD))
    return {
        "education": level("education", "own_education", "education_state"), "degree": level("degree", "own_degree", "degree_state"), "major": F.when(~_blank(c("majors")), major), "age": F.when(c("age_years").isNotNull() | c("boundary").isNotNull(), age), "experience": F.when(c("years").isNotNull(), years),
        "political_status": F.when(~_blank(c("political")), political), "professional_title": F.when(F.size("titles") > 0, F.when(titled, "PASS").otherwise("UNKNOWN")), "applicant_type": F.when(~_blank(c("applicant")), applicant), "other_conditions": F.when(hard, "UNKNOWN"),
    }


def _asked_sql(name: str) -> str:
    stride, kind, choices = ASKED[name]
    return f"CAST(({literal([str(x) if isinstance(x, float) else x for x in choices])})[1 + (p_partkey // {stride}) % {len(choices)}] AS {dict(string='VARCHAR', int='INTEGER', double='DOUBLE', date='DATE').get(kind, 'VARCHAR[]')}) AS {name}"


_VALUES = ", ".join("(" + ", ".join(literal(str(v) if isinstance(v, float) else v) if not isinstance(v, list) else f"CAST({literal(v)} AS VARCHAR[])" for v in p) + ")" for p in PEOPLE)
_LEVEL = lambda x: "CASE " + " ".join(f"WHEN regexp_matches({x}, '{words}') THEN {n}" for words, n in LEVELS) + " ELSE 0 END"
_PLAIN = lambda x: rf"lower(regexp_replace(coalesce({x}, ''), '[\s、，,；;（）()]+', '', 'g'))"
_BY_LEVEL = lambda asked, own, state: f"CASE WHEN {asked} IS NOT NULL THEN CASE WHEN {own} IS NULL OR {state} = 'UNKNOWN' THEN 'UNKNOWN' WHEN {_LEVEL(asked)} > 0 AND {_LEVEL(own)} > 0 AND {_LEVEL(own)} < {_LEVEL(asked)} THEN 'FAIL' WHEN {state} = 'EXPECTED' THEN 'CONDITIONAL' ELSE 'PASS' END END"
_AGED = lambda day: f"(year(until) - year({day}) - CASE WHEN month(until) * 100 + day(until) < month({day}) * 100 + day({day}) THEN 1 ELSE 0 END)"
_RULES = {
    "education": _BY_LEVEL("education", "own_education", "education_state"),
    "degree": _BY_LEVEL("degree", "own_degree", "degree_state"),
    "major": f"CASE WHEN majors IS NOT NULL THEN CASE WHEN own_major IS NULL OR NOT contains({_PLAIN('majors')}, {_PLAIN('own_major')}) THEN 'UNKNOWN' WHEN major_state = 'CONFIRMED' THEN 'PASS' ELSE 'CONDITIONAL' END END",
    "age": f"CASE WHEN age_years IS NULL AND boundary IS NULL THEN NULL WHEN born IS NULL THEN 'UNKNOWN' WHEN boundary IS NOT NULL THEN CASE WHEN born > boundary THEN 'PASS' WHEN born_last <= boundary THEN 'FAIL' ELSE 'UNKNOWN' END WHEN age_years IS NULL OR until IS NULL THEN 'UNKNOWN' WHEN {_AGED('born')} <= age_years THEN 'PASS' WHEN {_AGED('born_last')} > age_years THEN 'FAIL' ELSE 'UNKNOWN' END",
    "experience": "CASE WHEN years IS NOT NULL THEN CASE WHEN own_years IS NULL THEN 'UNKNOWN' WHEN own_years < years THEN 'FAIL' ELSE 'PASS' END END",
    "political_status": "CASE WHEN political IS NOT NULL THEN CASE WHEN own_political IS NULL THEN 'UNKNOWN' WHEN contains(political, own_political) THEN 'PASS' ELSE 'FAIL' END END",
    "professional_title": f"CASE WHEN len(titles) > 0 THEN CASE WHEN len(list_filter(own_titles, lambda t: contains({_PLAIN("array_to_string(titles, '；')")}, {_PLAIN('t')}) OR contains({_PLAIN('t')}, {_PLAIN("array_to_string(titles, '；')")}) OR (contains(array_to_string(titles, ''), '中级') AND contains(t, '中级')))) > 0 THEN 'PASS' ELSE 'UNKNOWN' END END",
    "applicant_type": "CASE WHEN applicant IS NOT NULL THEN CASE WHEN contains(applicant, '2026') AND graduate = '2027届' THEN 'FAIL' WHEN contains(applicant, '毕业生') THEN 'CONDITIONAL' ELSE 'UNKNOWN' END END",
    "other_conditions": f"CASE WHEN len(list_filter(others, lambda o: NOT regexp_matches(o, '{EXAMINED}') AND regexp_matches(o, '{HARD}'))) > 0 THEN 'UNKNOWN' END",
}


@query(f"""WITH p AS (SELECT * REPLACE (CAST(born AS DATE) AS born, CAST(born_last AS DATE) AS born_last, CAST(own_years AS DOUBLE) AS own_years) FROM (VALUES {_VALUES}) AS p({', '.join(x.split()[0] for x in FACTS.split(', '))})),
  a AS (SELECT p_partkey, {', '.join(_asked_sql(n) for n in ASKED)} FROM part), x AS (SELECT a.*, p.*, try_cast(substr(deadline, 1, 10) AS DATE) AS until FROM a CROSS JOIN p), s AS (SELECT candidate, p_partkey, {', '.join(f'{_RULES[k]} AS {k}' for k in CRITERIA)} FROM x)
  SELECT *, CASE WHEN list_contains(l, 'FAIL') THEN 'INELIGIBLE' WHEN list_contains(l, 'UNKNOWN') THEN 'NEEDS_CONFIRMATION' WHEN list_contains(l, 'CONDITIONAL') THEN 'CONDITIONAL' ELSE 'ELIGIBLE' END AS overall FROM (SELECT *, [{', '.join(CRITERIA)}] AS l FROM s)""".replace("SELECT *, CASE WHEN list_contains(l", f"SELECT candidate, p_partkey, {', '.join(CRITERIA)}, CASE WHEN list_contains(l"))
def legacy_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    """Nine criteria of every posting for each of a few candidates, and what follows from them."""
    def asked(name: str) -> Column:
        stride, kind, choices = ASKED[name]
        each = [F.array(*map(F.lit, x)).cast("array<string>") if isinstance(x, list) else F.lit(x) for x in choices]
        return F.element_at(F.array(*each), (F.floor(F.col("p_partkey") / stride) % len(choices) + 1).cast("int")).cast(kind)

    people = spark.createDataFrame(PEOPLE, FACTS)
    x = table(spark, sf, "part").select("p_partkey", *(asked(n).alias(n) for n in ASKED)).crossJoin(F.broadcast(people))  # three rows
    found = x.select("candidate", "p_partkey", *(v.alias(k) for k, v in criteria().items()))
    status = legacy_status([F.col(k) for k in CRITERIA])
    overall = F.when(status == "FAIL", "INELIGIBLE").when(status == "UNKNOWN", "NEEDS_CONFIRMATION").when(status == "CONDITIONAL", "CONDITIONAL").otherwise("ELIGIBLE")
    return found.withColumn("overall", overall)


_PUBLIC = f"organisation IN {PUBLIC}"


@query(f"""WITH b AS (SELECT p_partkey, p_retailprice AS x FROM part WHERE p_partkey % 10 <> 0), n AS (SELECT p_partkey, {PRICE} AS x FROM part WHERE p_partkey % 10 <> 1),
  d AS (SELECT coalesce(n.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'ADDED' WHEN n.p_partkey IS NULL THEN 'REMOVED' WHEN n.x = b.x THEN 'UNCHANGED' ELSE 'CHANGED' END AS delta FROM b FULL JOIN n ON n.p_partkey = b.p_partkey),
  le AS (SELECT p_partkey, CASE overall WHEN 'ELIGIBLE' THEN 'PASS' WHEN 'CONDITIONAL' THEN 'CONDITIONAL' WHEN 'INELIGIBLE' THEN 'FAIL' ELSE 'UNKNOWN' END AS status FROM ({ORACLE["legacy_eligibility"]}) WHERE candidate = 1),
  w AS (SELECT p_partkey, {picked_sql('employment')} AS employment, {picked_sql('organisation')} AS organisation, {picked_sql('family')} <> 'ADMINISTRATION' AS related FROM part),
  t AS (SELECT *, CASE WHEN employment = 'LABOR_DISPATCH' THEN 'EXCLUDED' WHEN employment = 'ESTABLISHMENT' THEN CASE WHEN {_PUBLIC} THEN 'T1_ESTABLISHMENT_TARGET' ELSE 'T2_IDENTITY_REVIEW' END WHEN organisation = 'STATE_OWNED_ENTERPRISE' THEN 'T3_STABLE_SOE_BACKUP' WHEN employment = 'QUOTA_OR_FILING' THEN 'T2_IDENTITY_REVIEW' WHEN employment = 'CONTRACT' THEN CASE WHEN {_PUBLIC} THEN 'T2_IDENTITY_REVIEW' ELSE 'EXCLUDED' END WHEN {_PUBLIC} THEN 'T2_IDENTITY_REVIEW' ELSE 'UNKNOWN' END AS tier FROM w),
  a AS (SELECT d.p_partkey, delta, CASE WHEN delta = 'REMOVED' THEN 'REMOVED' WHEN NOT related OR tier = 'EXCLUDED' OR status = 'FAIL' THEN 'REJECT' WHEN tier = 'T1_ESTABLISHMENT_TARGET' THEN CASE WHEN status = 'PASS' THEN 'APPLY' ELSE 'VERIFY_FIRST' END WHEN tier = 'T3_STABLE_SOE_BACKUP' THEN CASE WHEN status = 'PASS' THEN 'BACKUP' ELSE 'VERIFY_FIRST' END WHEN tier = 'T2_IDENTITY_REVIEW' THEN 'VERIFY_FIRST' ELSE 'REVIEW' END AS action FROM d JOIN le USING (p_partkey) JOIN t USING (p_partkey) WHERE delta <> 'UNCHANGED')
  SELECT delta, action, count(*) AS n, min(p_partkey) AS first_posting FROM a GROUP BY ALL""")
def daily_run(spark: SparkSession, sf: str) -> DataFrame:
    """A day's run end to end: the new snapshot against the stored state, what is new or changed judged for a candidate, what to do about each, the state moved on."""
    before, after = snapshots(spark, sf)
    state = VersionedState(spark, f"{checkpoint_folder(spark)}/daily-{uuid.uuid4().hex}", "parts", "p_partkey", "p_retailprice")
    state.commit(before)
    moved = state.delta(after).withColumnRenamed("status", "delta").filter("delta <> 'UNCHANGED'")
    names = F.create_map(*(F.lit(x) for x in ("ELIGIBLE", "PASS", "CONDITIONAL", "CONDITIONAL", "INELIGIBLE", "FAIL", "NEEDS_CONFIRMATION", "UNKNOWN")))
    judged = legacy_eligibility(spark, sf).filter("candidate = 1").select("p_partkey", names[F.col("overall")].alias("status"))
    pools = postings(spark, sf).select("p_partkey", watch_tier(F.col("employment"), F.col("organisation")).alias("tier"), (F.col("family") != "ADMINISTRATION").alias("related"))
    action = F.when(F.col("delta") == "REMOVED", "REMOVED").otherwise(watch_action(F.col("related"), F.col("tier"), F.col("status")))
    found = moved.join(judged, "p_partkey").join(pools, "p_partkey").groupBy("delta", action.alias("action")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_posting"))
    # the result rests on the version before, so it is settled before the state moves on
    found = found.checkpoint()
    state.commit(after)
    return found
