"""Column functions and rules on single cases."""

import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import dates, text
from tessera.plans import rules


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("HTTPS://HRSS.HANGZHOU.GOV.CN:443/a#top", "https://hrss.hangzhou.gov.cn/a"),
        ("https://host/path?b=2&a=1&utm_source=x", "https://host/path?a=1&b=2"),
        ("https://host/download?fileUrl=token%2Fvalue%3D&fileName=%E8%AE%A1.xlsx", "https://host/download?fileName=%E8%AE%A1.xlsx&fileUrl=token%2Fvalue%3D"),
        ("https://host", "https://host/"),
        ("http://HOST:80/a/../b?from=feed&id=7", "http://host/b?id=7"),
        ("/relative", None),
    ],
)
def test_canonical_uri(spark, raw, want):
    assert one(spark, text.canonical_uri(F.lit(raw))) == want


@pytest.mark.parametrize("raw, want", [("35周岁以下", 35), ("18至40周岁", 40), ("未满36周岁", 35), ("不超过45岁", 45), ("40岁", 40), ("博士可放宽至40岁", None), ("15岁以下", None), (None, None), ("30岁以下或35岁以下", None), ("35岁（不含）以下", 34), ("1990年1月1日后出生，35岁以下", 35), ("2026-06-30前满30岁以下", 30)])
def test_age_limit(spark, raw, want):
    assert one(spark, text.age_limit(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw, want", [("3年以上工作经验", 3), ("不限", 0), ("工作经验不限", 0), ("3年及以上", 3), ("不超过3年工作", None), ("本科3年工作经验", None), ("三年", None), (None, None), ("无工作经验要求", 0), ("无经历要求", 0), ("不限，须有管理经验", None), ("2020年至今有5年工作经历", 5), ("60年工作经验", None)])
def test_experience(spark, raw, want):
    assert one(spark, text.experience_years(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw, want", [("第3个", 3), ("第１２个", 12), ("第十二条", 12), ("第二十个", 20), ("第九项", 9), ("没有", None)])
def test_ordinal(spark, raw, want):
    assert one(spark, text.ordinal(F.lit(raw))) == want


def test_text_forms(spark):
    assert one(spark, text.compact(F.lit(" 计算机（A）-B "))) == "计算机ab"
    assert one(spark, text.split_list(F.lit("软件工程、计算机（限网络方向）;数学"))) == ["软件工程", "网络", "数学"]
    assert one(spark, text.years_in(F.lit("2026届、2025届、2026"))) == [2025, 2026]
    assert one(spark, text.labels(F.lit("面试成绩公示"), text.STAGES)) == ["INTERVIEW", "PUBLICATION"]
    assert one(spark, text.supports(F.lit("5"), F.lit("招聘15人"))) is False and one(spark, text.supports(F.lit("5"), F.lit("招聘5人"))) is True
    assert one(spark, text.nfkc(F.lit("ＡＢ，c 1"))) == "abc1"
    assert one(spark, text.fingerprint(F.lit("a"), F.lit(None).cast("string"))) != one(spark, text.fingerprint(F.lit("a"), F.lit("")))
    assert one(spark, text.requirement(F.lit("男性优先；限中共党员"), "党员", "优先")) is True
    assert one(spark, text.says_without_disclaimer(F.lit("不代表一定录取"), "录取", "不代表")) is False


def test_dates(spark):
    d = lambda s: F.lit(s).cast("date")
    assert one(spark, dates.whole_years(d("1992-02-29"), d("2027-02-28"))) == 34
    assert one(spark, dates.whole_months(d("2024-01-31"), d("2024-03-01"))) == 1
    assert one(spark, dates.shifted(d("2024-02-29"), 3)) == datetime.date(2027, 2, 28)
    assert one(spark, dates.latest(F.lit(1992), F.lit(12), F.lit(None).cast("int"))) == datetime.date(1992, 12, 31)
    assert one(spark, dates.written_date(F.lit("于2026年8月3日截止"))) == datetime.date(2026, 8, 3)
    assert one(spark, dates.written_date(F.lit("8月3日"), F.lit(2025))) == datetime.date(2025, 8, 3)
    assert one(spark, dates.between_markers(F.lit("报名：网上。考试：笔试"), "报名：", "考试")) == "网上。"
    assert one(spark, dates.sentence_with(F.lit("甲。乙面试。丙"), "面试")) == "乙面试"


CASES = [
    ("establishment", "ESTABLISHMENT", "PUBLIC_INSTITUTION", True, "计算机科学与技术", "NOT_REQUIRED", "ELIGIBLE", "T1", 40),
    ("university-contract", "CONTRACT", "UNIVERSITY", True, "计算机科学与技术", "NOT_REQUIRED", "ELIGIBLE", "T2", 40),
    ("dispatch", "LABOR_DISPATCH", "STATE_OWNED_ENTERPRISE", True, "计算机科学与技术", "NOT_REQUIRED", "ELIGIBLE", "T3", 40),
    ("major-mismatch", "ESTABLISHMENT", "PUBLIC_INSTITUTION", True, "临床医学", "NOT_REQUIRED", "INELIGIBLE", "EXCLUDED", 40),
    ("no-evidence", "ESTABLISHMENT", "PUBLIC_INSTITUTION", False, "计算机科学与技术", "NOT_REQUIRED", "ELIGIBLE", "T3", 40),
    ("unknown-employment", "UNKNOWN", "OTHER", False, "计算机科学与技术", "NOT_REQUIRED", "ELIGIBLE", "T3", 0),
    ("clause-not-collected", "ESTABLISHMENT", "PUBLIC_INSTITUTION", True, "计算机科学与技术", None, "NEEDS_CONFIRMATION", "T1", 40),
]


def test_seven_decisions(spark):
    """The golden cases: a master of 2018, born in December 1992, for a bachelor's post up to 40 years, no experience asked for."""
    from tessera.operators.aggregates import worst

    rows = [Row(id=c[0], employment=c[1], org=c[2], evidence=c[3], major=c[4], clause=c[5]) for c in CASES]
    df = spark.createDataFrame(rows, "id string, employment string, org string, evidence boolean, major string, clause string")
    yes, none = F.lit(True), F.array().cast("array<string>")
    born = F.lit(1992), F.lit(12), F.lit(None).cast("int")
    at = F.lit("2026-08-20").cast("date")
    mine = F.array(F.lit("计算机科学与技术"))
    status = worst(
        rules.age(dates.earliest(*born), dates.latest(*born), yes, F.lit(40), at),
        rules.education(F.lit("MASTER"), yes, F.lit("BACHELOR")),
        rules.major(mine, yes, F.array("major"), F.lit(None).cast("string")),
        rules.graduation(F.lit(2018), yes, F.array().cast("array<int>"), F.lit("")),
        rules.experience(F.lit(None).cast("int"), F.lit(0), at),
        rules.title(none, yes, none, F.lit(None).cast("string")),
        rules.affiliation(F.lit("UNKNOWN"), F.lit(False), rules.party_required(F.lit(""))),
        rules.gender(F.lit("UNKNOWN"), F.lit(False), F.lit("")),
        rules.fresh_graduate(F.col("clause"), F.lit(False), F.lit(False), F.lit("UNDECLARED"), F.lit("UNDECLARED")),
    )
    nothing = F.lit(None).cast("double")
    _, cover = rules.stability(F.col("employment"), [(nothing, m) for m in rules.ORGANISATION_POINTS.values()])
    tier, _ = rules.decision(status, rules.tier(F.col("employment"), F.col("org"), F.col("evidence")), F.lit(50), cover)
    got = {r.id: (r.status, r.tier, r.coverage) for r in df.select("id", status.alias("status"), tier.alias("tier"), cover.alias("coverage")).collect()}
    assert got == {c[0]: (c[6], c[7], c[8]) for c in CASES}


@pytest.mark.parametrize(
    "column, want",
    [
        (rules.gender, [("", "ELIGIBLE"), ("男性优先", "ELIGIBLE"), ("男女不限", "ELIGIBLE"), ("限男性", "ELIGIBLE"), ("限女性", "INELIGIBLE"), ("男1女1", "NEEDS_CONFIRMATION"), ("不 限（男、女）", "ELIGIBLE"), ("性别：不、限；女", "ELIGIBLE")]),
    ],
)
def test_gender(spark, column, want):
    for raw, status in want:
        assert one(spark, column(F.lit("MALE"), F.lit(True), F.lit(raw))) == status


def test_single_rules(spark):
    t = F.lit(True)
    assert one(spark, rules.age(F.lit("1985-12-01").cast("date"), F.lit("1985-12-31").cast("date"), t, F.lit(40), F.lit("2026-12-15").cast("date"))) == "NEEDS_CONFIRMATION"
    assert one(spark, rules.education(F.lit("MASTER"), t, F.lit("BACHELOR"), F.lit("EXPECTED"), F.lit("VERIFIED"))) == "CONDITIONAL"
    assert one(spark, rules.major(F.array(F.lit("网络")), t, F.array(F.lit("计算机类（限网络）")), F.lit(None).cast("string"))) == "ELIGIBLE"
    assert one(spark, rules.major(F.array(F.lit("网络")), t, F.array(F.lit("计算机类")), F.lit(None).cast("string"))) == "NEEDS_CONFIRMATION"
    assert one(spark, rules.fresh_graduate(F.lit("CONFIRMED"), t, t, F.lit("DECLARED_MET"), F.lit("DECLARED_NOT_MET"))) == "INELIGIBLE"
    assert one(spark, rules.unless_conflict(F.lit("ELIGIBLE"), F.array(F.lit("age")), "age")) == "CONFLICTING_EVIDENCE"
    assert one(spark, rules.cohort(F.lit(2026), F.array(F.lit(2025), F.lit(2026)))) == [2025, 2026]
    assert one(spark, rules.cohort(F.lit(2026), F.array(F.lit(2022), F.lit(2026)))) is None
    assert one(spark, rules.legacy_status([F.lit("PASS"), F.lit(None).cast("string"), F.lit("UNKNOWN")])) == "UNKNOWN"
    for raw, hard in (("限中共党员", True), ("中共党员优先", False), ("政治面貌：中共党员", True), ("中共党员或共青团员", False)):
        assert one(spark, rules.party_required(F.lit(raw))) is hard
    for raw, kind in ((None, "NONE"), ("党员优先", "PREFERENCE"), ("党员优先；党员或团员", "AMBIGUOUS"), ("党员或团员；限党员；党员优先", "REQUIRED")):
        assert one(spark, rules.party_rule(F.lit(raw).cast("string"))) == kind
    for raw, kind in ((None, "NOT_REQUIRED"), ("无需认证", "NOT_REQUIRED"), ("须在报名前完成认证", "REQUIRED_BY_APPLICATION"), ("应提供认证；录用前须完成认证", "REQUIRED_LATER"), ("须完成认证", "AMBIGUOUS"), ("须在报名前或录用前完成认证", "AMBIGUOUS")):
        assert one(spark, rules.certificate_rule(F.lit(raw).cast("string"))) == kind
