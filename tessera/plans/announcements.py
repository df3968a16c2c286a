"""Announcements as pages: every fact that a page's HTML tells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.announcements import announcement_facts
from tessera.plans.registry import query
from tessera.session import table

#: Paragraphs of an announcement: which pages have them (k: page_id), and their words ({y}: a year, {b}: the one before, {d}, {e}: days, the later one by six).
PARAGRAPHS = (
    ("k % 2 = 0", "报名时间：{y}年3月{d}日9：00－3月{e}日24：00，网址：https://bm.example.cn/{y}（平台）。"),
    ("k % 3 <> 0", "资格初审时间：{y}年3月{d}日9：00－{y}年3月{e}日17：30。"),
    ("k % 5 <> 0", "下载并打印准考证时间：{y}年4月{d}日－4月{e}日。"),
    ("k % 7 <> 0", "笔试时间：{y}年5月{d}日《综合应用能力》《职业能力倾向测验》题型：《申论》为主观题。"),
    ("k % 4 <> 1", "工作经历以签订的劳动合同、社保缴费记录为准。"),
    ("k % 4 <> 2", "国外学历学位需取得教育部留学服务中心学历学位认证。"),
    ("k % 3 <> 1", "{b}年和{y}年普通高校毕业生，含留学回国人员，须在报到前取得相应证书。"),
    ("k % 5 <> 2", "经公示无异议的，签订聘用合同。"),
    ("k % 4 = 0", "考试包括笔试和面试，可包括专业知识测试、结构化面试。"),
    ("k % 4 = 1", "结构化面试考核专业能力。面试时间：{y}年6月{d}日。"),
    ("k % 4 = 2", "不组织面试。"),
    ("k % 6 = 1", "体检另行通知。"),
    ("k % 6 = 3", "考察合格者进入体检。"),
)


def announcement_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The pages with an announcement's paragraphs in their HTML; every ninth does not say when it was published."""
    k, c = F.col("page_id"), F.col
    p = table(spark, sf, "pages").select(k, "html").withColumns({"k": k, "y": 2024 + k % 3, "b": 2023 + k % 3, "d": 1 + k % 20, "e": 7 + k % 20})

    def worded(text: str):
        parts = F.lit(text)
        for name in "ybde":
            parts = F.replace(parts, F.lit(f"{{{name}}}"), c(name).cast("string"))
        return F.concat(F.lit("<p>"), parts, F.lit("</p>\n"))

    body = F.concat(*(F.when(F.expr(when), worded(text)).otherwise("") for when, text in PARAGRAPHS))
    meta = F.when(k % 9 != 0, F.format_string('<meta name="PubDate" content="%d-02-%02d 17:12">', "y", "d")).otherwise("")
    return p.select("page_id", F.concat(F.lit('<html><head><title>公告 报名时间</title>'), meta, F.lit("</head><body><!-- 报名时间 --><script>var a='公示';</script>"), body, F.lit("</body></html>")).alias("page"))


def _words(i: int) -> str:
    """A paragraph as SQL, if the page has it."""
    when, text = PARAGRAPHS[i]
    for name in "ybde":
        text = text.replace(f"{{{name}}}", f"' || {name} || '")
    return f"CASE WHEN {when} THEN '{text}' END"


_DATE = lambda when, year, month, day: f"CASE WHEN {when} THEN make_date({year}, {month}, {day}) END"


@query(f"""WITH k AS (SELECT page_id, page_id AS k, 2024 + page_id % 3 AS y, 2023 + page_id % 3 AS b, 1 + page_id % 20 AS d, 7 + page_id % 20 AS e FROM pages),
  s AS (SELECT *, {', '.join(f'{_words(i)} AS p{i}' for i in range(len(PARAGRAPHS)))} FROM k),
  g AS (SELECT *, k % 9 <> 0 AS dated, nullif(concat_ws(' ', p4, p5, p6), '') AS graduate FROM s)
  SELECT page_id, CASE WHEN dated THEN make_date(y, 2, d) END AS published_on, CASE WHEN p0 IS NOT NULL THEN make_timestamp(y, 3, d, 9, 0, 0) END AS applies_from, CASE WHEN p0 IS NOT NULL THEN make_timestamp(y, 3, e + 1, 0, 0, 0) END AS applies_to, CASE WHEN p1 IS NOT NULL THEN make_timestamp(y, 3, e, 17, 30, 0) END AS reviewed_to,
  {_DATE('p2 IS NOT NULL', 'y', 4, 'd')} AS ticket_from, {_DATE('p2 IS NOT NULL', 'y', 4, 'e')} AS ticket_to, CASE WHEN p0 IS NOT NULL THEN 'https://bm.example.cn/' || y END AS registration_url, {_DATE('p3 IS NOT NULL', 'y', 5, 'd')} AS exam_on, CASE WHEN p3 IS NOT NULL THEN '综合应用能力,职业能力倾向测验' ELSE '' END AS subjects, {_DATE('p9 IS NOT NULL', 'y', 6, 'd')} AS interview_on,
  graduate AS graduate_rule, p5 AS overseas_rule, p4 AS experience_rule, p7 AS employment_statement, CASE k % 4 WHEN 0 THEN p8 WHEN 1 THEN '结构化面试考核专业能力。' END AS interview_rule, coalesce(p11, p12) AS physical_rule, p12 AS investigation_rule, p7 AS publication_rule,
  CASE WHEN dated AND graduate IS NOT NULL THEN CASE WHEN p6 IS NOT NULL THEN b || ',' || y ELSE '' END END AS cohort_years, CASE WHEN dated AND graduate IS NOT NULL THEN p6 IS NOT NULL END AS includes_overseas, CASE WHEN dated AND graduate IS NOT NULL THEN CASE WHEN p5 IS NULL AND p6 IS NOT NULL THEN 'REPORTING' ELSE 'UNSPECIFIED' END END AS degree_timing,
  CASE WHEN dated THEN 'CONFIRMED' ELSE 'NOT_COLLECTED' END AS notice_state, CASE WHEN p0 IS NULL THEN 'NOT_COLLECTED' ELSE 'CONFIRMED' END AS application_state, CASE WHEN p2 IS NULL THEN 'NOT_COLLECTED' ELSE 'CONFIRMED' END AS ticket_state, CASE WHEN p3 IS NULL THEN 'NOT_COLLECTED' ELSE 'CONFIRMED' END AS exam_state,
  CASE k % 4 WHEN 0 THEN 'REVIEW_REQUIRED' WHEN 1 THEN 'CONFIRMED' ELSE 'NOT_COLLECTED' END AS professional_test_state, CASE k % 4 WHEN 2 THEN 'NOT_REQUIRED' WHEN 3 THEN 'NOT_COLLECTED' ELSE 'CONFIRMED' END AS interview_state, CASE WHEN coalesce(p11, p12) IS NULL THEN 'NOT_COLLECTED' ELSE 'CONFIRMED' END AS physical_state, CASE WHEN p7 IS NULL THEN 'NOT_COLLECTED' ELSE 'CONFIRMED' END AS appointment_state,
  CAST((p0 IS NOT NULL) AS BIGINT) + CAST((graduate IS NOT NULL) AS BIGINT) + CAST((p5 IS NOT NULL) AS BIGINT) + CAST((p4 IS NOT NULL) AS BIGINT) + 2 * CAST((p7 IS NOT NULL) AS BIGINT) + CAST((k % 4 < 2) AS BIGINT) + CAST((coalesce(p11, p12) IS NOT NULL) AS BIGINT) + CAST((p12 IS NOT NULL) AS BIGINT) AS n_excerpts FROM g""")
def announcement_page_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Dates, periods, rules, stages and excerpts of announcements, out of their HTML."""
    x = announcement_facts(announcement_pages(spark, sf), "page")
    return x.select(
        "page_id", "published_on", "applies_from", "applies_to", "reviewed_to", "ticket_from", "ticket_to", "registration_url", "exam_on", F.array_join("subjects", ",").alias("subjects"), "interview_on", "graduate_rule", "overseas_rule", "experience_rule", "employment_statement", "interview_rule", "physical_rule", "investigation_rule", "publication_rule",
        F.array_join(F.transform("cohort_years", lambda y: y.cast("string")), ",").alias("cohort_years"), "includes_overseas", "degree_timing", "notice_state", "application_state", "ticket_state", "exam_state", "professional_test_state", "interview_state", "physical_state", "appointment_state", F.size("excerpts").cast("long").alias("n_excerpts"),
    )
