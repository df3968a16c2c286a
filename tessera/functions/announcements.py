"""All facts of an announcement, from its HTML: dates, periods, rules by their sentences, stages and excerpts.

Facts are listed, not coded one by one: which sentence tells them, and how it is read. Each step is a select over named
columns, so a sentence is looked for once however many facts it tells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: how announcements word dates, periods and rules
PUBLISHED = r"(20\d{2})-(\d{1,2})-(\d{1,2})"
DAY = r"(20\d{2})年(\d{1,2})月(\d{1,2})日"
PERIOD = r"(20\d{2})年(\d{1,2})月(\d{1,2})日(\d{1,2})[：:](\d{2})\s*[－—-]\s*(?:(20\d{2})年)?(\d{1,2})月(\d{1,2})日(\d{1,2})[：:](\d{2})"
DATE_PERIOD = r"(20\d{2})年(\d{1,2})月(\d{1,2})日\s*[－—-]\s*(?:(20\d{2})年)?(\d{1,2})月(\d{1,2})日"
AGE_REFERENCE = r"(?:截止时间为|截止到|截至)(20\d{2})年(\d{1,2})月(\d{1,2})日"
URL = r"网址[：:]\s*(https?://[^\s（(。；;]+)"
GRADUATION_YEAR = r"(20\d{2})(?:年|届)"
NO_EMPLOYER = "未落实工作单位|无工作单位|无劳动关系|未(?:与|同).{0,20}(?:建立|签订).{0,10}(?:劳动关系|劳动合同)"
NO_INSURANCE = "(?:未缴纳|无缴纳|不缴纳|无).{0,8}(?:社会保险|社保)|(?:社会保险|社保).{0,8}(?:未缴纳|无缴纳|不缴纳|为空)"
UNRESTRICTED = ("毕业年份不限", "不限制毕业年份", "不限定届别")
OVERSEAS = ("留学回国", "国（境）外", "国(境)外", "境外高校毕业生", "国外高校毕业生")
RELATED = ("取得相应证书", "学历学位证书", "留学服务中心", "未落实工作单位", "社会保险", "社保")
DEGREE = ".*(?:取得|获得).{0,12}(?:学历|学位|毕业证|证书).*"
SUBJECTS_END = ("题型：", "题型:", "按《招聘计划表》", "考试大纲")
#: The sentences that tell something, by the words that mark them; of several marks the sentences are joined.
SENTENCES = {
    "application": ("报名时间",), "review": ("资格初审时间",), "payment": ("缴费确认时间",), "ticket": ("打印准考证",), "ages": ("资格条件或工作经历的计算",), "overseas": ("教育部留学服务中心学历学位认证",), "experience": ("社保缴费记录",), "employment": ("签订聘用合同",),
    "interview": ("考试包括笔试和面试", "结构化面试"), "physical": ("体检",), "investigation": ("考察",), "publication": ("公示",), "interview_day": ("面试时间",), "written": ("笔试时间",), "no_employer": ("未落实工作单位",), "insurance": ("社会保险",),
}
#: Stages of the process: what it is called, the sentence that tells it, and the facts that confirm it (none: the sentence does).
STAGES = {
    "application": ("报名", "application", ("applies_from",)), "review": ("资格初审", "review", ("reviewed_to",)), "payment": ("缴费", "payment", ("paid_to",)), "ticket": ("准考证", "ticket", ("ticket_from", "ticket_to")), "exam": ("笔试", "exam", ("exam_on", "first_subject")),
    "interview": ("面试", "interview", ()), "physical": ("体检", "physical", ()), "investigation": ("考察", "investigation", ()), "publication": ("公示", "publication", ()), "appointment": ("聘用", "employment", ()),
}
#: Timings by the first words that a clause has.
TIMINGS = (("报名|资格初审", "APPLICATION"), ("资格复审|资格审查", "QUALIFICATION_REVIEW"), ("录用|聘用", "APPOINTMENT"), ("报到", "REPORTING"))
#: Excerpts that are kept as evidence, by the name of their fact.
EXCERPTS = {"applicationPeriod": "application", "ageReferenceDate": "ages", "graduateRule": "graduate", "overseasDegreeRule": "overseas", "experienceEvidenceRule": "experience", "employmentStatement": "employment", "interviewRule": "interview", "physicalExamRule": "physical", "investigationRule": "investigation", "publicationRule": "publication"}


def page_text(html: Column) -> Column:
    """The text of a page on one line: no scripts, styles, comments or tags, named and numbered signs of the usual kinds as such."""
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def _ints(text: Column, pattern: str, *groups: int) -> list[Column]:
    return [F.nullif(F.regexp_extract(text, pattern, g), F.lit("")).cast("int") for g in groups]


def _day(text: Column, pattern: str, groups: tuple[int, ...] = (1, 2, 3)) -> Column:
    year, month, day = _ints(text, pattern, *groups)
    return F.make_date(F.coalesce(year, *_ints(text, pattern, 1)), month, day)


def _moment(text: Column, first: int) -> Column:
    """One end of a period; hour 24 is the next day's beginning, and the end's year the start's where it is left out."""
    hour, minute = _ints(text, PERIOD, first + 3, first + 4)
    day = F.date_add(_day(text, PERIOD, (first, first + 1, first + 2)), (hour == 24).cast("int"))
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour % 24, minute)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _joined(parts: list[Column]) -> Column:
    """Distinct texts that are there, joined by a space; null without any."""
    kept = F.array_distinct(F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.trim(p) != "")))
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))


def _stage(text: Column, name: str, said: Column, confirmed: Column) -> Column:
    absent = text.contains(f"不组织{name}") | text.contains(f"不设{name}")
    later = text.contains(f"{name}另行通知") | text.contains(f"{name}时间、地点另行通知")
    return F.when(absent, "NOT_REQUIRED").when(confirmed, "CONFIRMED").when(later, "NOT_PUBLISHED").when(said.isNull(), "NOT_COLLECTED").otherwise("REVIEW_REQUIRED")


def _timing(clause: Column) -> Column:
    out = F.lit(None)
    for i, (words, name) in enumerate(TIMINGS):
        out = F.when(clause.rlike(words), name) if i == 0 else out.when(clause.rlike(words), name)
    return F.coalesce(out, F.lit("UNSPECIFIED"))


def announcement_facts(pages: DataFrame, html: str) -> DataFrame:
    """Adds the facts of each page's announcement. A null or empty page has none: its stages are NOT_COLLECTED."""
    c, kept = F.col, pages.columns
    x = pages.withColumn("_text", F.coalesce(page_text(c(html)), F.lit("")))
    meta = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<meta(?=[^>]*\bname\s*=\s*[\"']PubDate[\"'])[^>]*\bcontent\s*=\s*[\"']([^\"']*)", 1)
    x = x.withColumns({"_clauses": F.transform(F.split("_text", "(?<=[。；;])"), lambda s: F.trim(s)), "published_on": _day(meta, PUBLISHED)})
    told = lambda word: F.get(F.filter("_clauses", lambda s: s.contains(word)), F.lit(0))
    x = x.withColumns({f"_{name}": _joined([told(w) for w in words]) for name, words in SENTENCES.items()})
    start = F.locate("（一）笔试", c("_text"))
    section = F.substring(c("_text"), start, F.length("_text"))
    end = F.locate("（二）面试", section)
    x = x.withColumn("_exam", F.coalesce("_written", F.when(start > 0, F.trim(F.when(end > 0, F.substring(section, F.lit(1), end - 1)).otherwise(section)))))
    cut = c("_exam")
    for marker in SUBJECTS_END:
        cut = F.when(F.locate(marker, cut) > 0, F.substring(cut, F.lit(1), F.locate(marker, cut) - 1)).otherwise(cut)
    cohort = lambda s: (s.rlike(GRADUATION_YEAR) & s.contains("毕业")) | _any(s, UNRESTRICTED) | _any(s, RELATED)
    x = x.withColumns({"_subjects": cut, "_graduate": F.array_join(F.array_distinct(F.filter("_clauses", cohort)), " ")}).withColumn("_graduate", F.nullif("_graduate", F.lit("")))
    x = x.withColumns({
        "applies_from": _moment(c("_application"), 1), "applies_to": _moment(c("_application"), 6), "reviewed_to": _moment(c("_review"), 6), "paid_to": _moment(c("_payment"), 6), "ticket_from": _day(c("_ticket"), DATE_PERIOD), "ticket_to": _day(c("_ticket"), DATE_PERIOD, (4, 5, 6)),
        "ages_at": _day(c("_ages"), AGE_REFERENCE), "registration_url": F.nullif(F.regexp_extract("_text", URL, 1), F.lit("")), "exam_on": _day(c("_exam"), DAY), "interview_on": _day(c("_interview_day"), DAY),
        "subjects": F.coalesce(F.array_distinct(F.regexp_extract_all("_subjects", F.lit("《([^》]+)》"), 1)), F.array().cast("array<string>")),
        "_rule": F.when(c("published_on").isNotNull(), _joined([c(f"_{n}") for n in ("graduate", "overseas", "no_employer", "insurance")])),
    }).withColumn("first_subject", F.get("subjects", F.lit(0)))
    clauses = F.transform(F.split("_rule", r"[。；;]+|\R+"), lambda s: F.trim(s))
    degree = F.get(F.filter(clauses, lambda s: s.contains("取得相应证书") | s.contains("学历学位证书") | s.rlike(f"^{DEGREE}$")), F.lit(0))
    credential = F.get(F.filter(clauses, lambda s: s.contains("认证") | s.contains("留学服务中心")), F.lit(0))
    x = x.withColumns({"_degree": degree, "_credential": credential, "_free": _any(c("_rule"), UNRESTRICTED)})
    years = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("_rule", F.lit(GRADUATION_YEAR), 1), lambda y: y.cast("int"))))
    interview = c("_interview")
    practical = F.when(interview.isNull() | ~(interview.contains("专业") | interview.contains("技能")), "NOT_COLLECTED").when(interview.contains("可包括") | interview.contains("可能"), "REVIEW_REQUIRED").otherwise("CONFIRMED")
    ruled = c("_rule").isNotNull()
    facts = {
        "graduate_rule": c("_graduate"), "overseas_rule": c("_overseas"), "experience_rule": c("_experience"), "employment_statement": c("_employment"), "interview_rule": interview, "physical_rule": c("_physical"), "investigation_rule": c("_investigation"), "publication_rule": c("_publication"),
        "cohort_years": F.when(ruled, F.when(c("_free"), F.array().cast("array<int>")).otherwise(years)), "any_cohort": F.when(ruled, c("_free")), "includes_overseas": F.when(ruled, _any(c("_rule"), OVERSEAS)), "no_employer": F.when(ruled, c("_rule").rlike(NO_EMPLOYER)), "no_insurance": F.when(ruled, c("_rule").rlike(NO_INSURANCE)),
        "degree_timing": F.when(ruled, _timing(c("_degree"))), "degree_by": _day(c("_degree"), DAY), "credential_timing": F.when(ruled, _timing(c("_credential"))), "credential_by": _day(c("_credential"), DAY),
        "notice_state": F.when(c("published_on").isNull(), "NOT_COLLECTED").otherwise("CONFIRMED"), "professional_test_state": practical,
        **{f"{name}_state": _stage(c("_text"), words, c(f"_{said}"), _any_there([c(f) for f in facts] or [c(f"_{said}")])) for name, (words, said, facts) in STAGES.items()},
        "excerpts": F.map_filter(F.create_map(*(y for name, said in EXCERPTS.items() for y in (F.lit(name), c(f"_{said}")))), lambda _, v: v.isNotNull()),
    }
    plain = ("published_on", "applies_from", "applies_to", "reviewed_to", "paid_to", "ticket_from", "ticket_to", "ages_at", "registration_url", "exam_on", "subjects", "interview_on")
    return x.select(*kept, *plain, *(v.alias(k) for k, v in facts.items()))


def _any_there(columns: list[Column]) -> Column:
    """Whether any of them is there."""
    return F.coalesce(*(F.when(x.isNotNull(), True) for x in columns), F.lit(False))
