"""Announcements word by word: facts that are known of three notices, and pages with nothing in them."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions.announcements import announcement_facts
from tessera.functions.text import split_list
from tessera.plans.personal import planner_step

NOTICES = {
    "unified": """<html><head><meta name="PubDate" content="2026-03-17 17:12"></head><body><div class="article-content">
<p>年龄一般为38周岁以下（1987年3月19日以后出生），其他有关资格条件或工作经历的计算，截止时间为2026年3月19日。</p><p>报名时间：2026年3月19日9：00－3月25日16：00。</p><p>资格初审时间：2026年3月19日9：00－3月26日17：00。</p>
<p>缴费确认时间：2026年3月19日9：00－3月27日24：00。</p><p>网址：http://qssy.zjks.com（浙江省通用招聘网报平台）。</p><p>下载并打印准考证时间：2026年4月20日－4月25日。</p>
<p>2024年、2025年和2026年普通高校毕业生，含同期毕业的留学回国人员。2026年普通高校毕业生取得相应证书的时限为2026年9月30日前。</p><p>岗位要求的“工作经历”以签订的劳动（聘用）合同、社保缴费记录及其他有效证明为准。</p><p>国外学历学位需取得教育部留学服务中心学历学位认证。</p>
<p>笔试时间：2026年4月25日 上午9:00—11:30 《综合应用能力》 下午2:00—3:30 《职业能力倾向测验》。</p><p>考试包括笔试和面试。面试时间、地点另行通知，可包括专业知识测试、实际操作考试、结构化面试等形式。</p><p>经公示无异议的，办理相关手续，签订聘用合同。</p></div></body></html>""",
    "paragraphs": """<html><head><meta content='2026-03-17 17:12' name='PubDate'></head><body><p>（二）下载并打印准考证</p><p>时间：2026年4月20日－4月25日。</p><p><strong>四、考试</strong></p><p>考试包括笔试和面试。</p><p>（一）笔试</p><p>时间：2026年4月25日</p>
<p>上午9:00—11:30 《综合应用能力》</p><p>下午2:00—3:30 《职业能力倾向测验》</p><p>题型：《综合应用能力》为主观题，《职业能力倾向测验》为客观题。</p><p>按《招聘计划表》确定面试对象，考试大纲见《关于做好考试考务工作的通知》。</p><p>（二）面试</p><p>面试由招聘单位组织。</p></body></html>""",
    "generic": """<html><head><meta name="PubDate" content="2027-02-18 09:00"></head><body><p>招聘对象包括2027届、2026届及2025届普通高校毕业生，以及同期国（境）外高校毕业生。</p><p>上述人员资格复审前须取得相应学历学位证书及教育部留学服务中心认证。</p><p>要求未落实工作单位、未缴纳社会保险。</p></body></html>""",
    "undated": "<body><p>报名时间：2026年12月30日9:00-2027年1月5日24:00。</p><p>毕业年份不限。</p></body>",
    "empty": "",
}


def test_notices(spark):
    df = spark.createDataFrame([*NOTICES.items(), ("null", None)], "name string, html string")
    got = {r["name"]: r for r in announcement_facts(df, "html").collect()}
    day, at = dt.date, dt.datetime
    a = got["unified"]
    want = {
        "published_on": day(2026, 3, 17), "applies_from": at(2026, 3, 19, 9), "applies_to": at(2026, 3, 25, 16), "reviewed_to": at(2026, 3, 26, 17), "paid_to": at(2026, 3, 28), "ages_at": day(2026, 3, 19), "registration_url": "http://qssy.zjks.com",
        "ticket_from": day(2026, 4, 20), "ticket_to": day(2026, 4, 25), "exam_on": day(2026, 4, 25), "subjects": ["综合应用能力", "职业能力倾向测验"], "cohort_years": [2024, 2025, 2026], "includes_overseas": True, "degree_by": day(2026, 9, 30), "interview_on": None,
        "notice_state": "CONFIRMED", "application_state": "CONFIRMED", "review_state": "CONFIRMED", "payment_state": "CONFIRMED", "ticket_state": "CONFIRMED", "exam_state": "CONFIRMED", "interview_state": "CONFIRMED", "physical_state": "NOT_COLLECTED", "investigation_state": "NOT_COLLECTED", "publication_state": "CONFIRMED", "appointment_state": "CONFIRMED",
    }
    assert {k: a[k] for k in want} == want
    assert "2024年、2025年和2026年" in a.graduate_rule and "2026年9月30日" in a.graduate_rule and "结构化面试" in a.interview_rule and "社保缴费记录" in a.experience_rule
    assert set(a.excerpts) >= {"applicationPeriod", "ageReferenceDate", "overseasDegreeRule", "employmentStatement"} and "公示无异议" in a.excerpts["publicationRule"]
    b = got["paragraphs"]
    assert (b.ticket_from, b.ticket_to, b.exam_on, b.subjects) == (day(2026, 4, 20), day(2026, 4, 25), day(2026, 4, 25), ["综合应用能力", "职业能力倾向测验"])
    c = got["generic"]
    assert (c.cohort_years, c.includes_overseas, c.degree_timing, c.credential_timing, c.no_employer, c.no_insurance) == ([2025, 2026, 2027], True, "QUALIFICATION_REVIEW", "QUALIFICATION_REVIEW", True, True)
    d = got["undated"]
    assert (d.applies_from, d.applies_to, d.any_cohort, d.notice_state) == (at(2026, 12, 30, 9), at(2027, 1, 6), None, "NOT_COLLECTED")
    for name in ("empty", "null"):
        r = got[name]
        assert r.subjects == [] and r.published_on is None and r.excerpts == {} and r.application_state == "NOT_COLLECTED"


def test_items_keep_their_digits(spark):
    """Items of a list and lines of a reply lose white space at their ends, and nothing else."""
    df = spark.createDataFrame([("a0, b1 , 2", "TOOL t x=1\n WHY: 1\n")], "t string, reply string")
    action, name, arguments = planner_step(F.col("reply"))
    row = df.select(split_list(F.col("t")).alias("x"), action.alias("a"), name.alias("n"), arguments.alias("k")).first()
    assert row.x == ["a0", "b1", "2"] and (row.a, row.n, row.k) == ("TOOL", "t", 1)
