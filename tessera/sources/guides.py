"""Guides of questions and answers: sections, questions and answers out of the text of pages.

Lines of all pages of a guide are one ordered stream. Headings and numbered questions are markers in it; each line
belongs to the marker last seen, each question to the heading last seen, which running last values tell. So a guide is walked
once, pages need not end where items do, and guides are read side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: how headings and questions are written, and what sections and words are about
HEADING = r"^\s*([一二三四五六七八九十]+)、\s*(关于[^\n]+|其他有关问题)\s*$"
QUESTION = r"^\s*(\d+)\.\s*"
SECTION_TAGS = {
    "招聘信息查询": "information_query", "招聘岗位及待遇": "position_and_benefits", "应聘基本条件": "basic_eligibility", "招聘对象类别": "applicant_category", "年龄条件": "age", "学历（学位）条件": "education_and_degree", "专业条件": "major", "其他条件": "other_requirement",
    "报名": "registration", "考试考核": "examination", "体检": "medical_exam", "考察": "background_check", "资格审查": "qualification_review", "递补": "replacement", "其他有关问题": "other",
}
WORD_TAGS = {
    "应届毕业生": "fresh_graduate", "年龄": "age", "专业": "major", "学历": "education", "学位": "degree", "工作经历": "work_experience", "报名": "registration", "笔试": "written_exam", "面试": "interview", "体检": "medical_exam", "递补": "replacement", "资格": "qualification",
}


def plain_lines(text: Column) -> Column:
    """One kind of line end and of space, no spaces at the ends of lines."""
    text = F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), r"\r\n?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" *\n *", "\n"))


def collapsed(text: Column) -> Column:
    """One line, without spaces that only the layout put between Chinese characters and digits."""
    text = F.regexp_replace(text, r"[\s\x0c]+", " ")
    for pattern in (r"(?<=\p{IsHan}) (?=\p{IsHan})", r"(?<=\p{IsHan}) (?=\d)", r"(?<=\d) (?=\p{IsHan})"):
        text = F.regexp_replace(text, pattern, "")
    return F.trim(text)


def tags(title: Column, question: Column) -> Column:
    """What a question is about: its section first, then its words."""
    names = F.create_map(*(F.lit(x) for pair in SECTION_TAGS.items() for x in pair))
    own = F.coalesce(F.get(F.array(names[F.regexp_replace(title, "^关于", "")]), F.lit(0)), F.lit("other"))
    words = F.array_compact(F.array(*(F.when(question.contains(w), F.lit(t)) for w, t in WORD_TAGS.items())))
    return F.array_distinct(F.concat(F.array(own), words))


def guide_items(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """Questions of guides, from their pages' texts: key, number, section_number, section, question, answer, start_page, end_page, tags, rule_id, status.

    status: OK, or what is wrong: NO_SECTION (no heading before it), NO_QUESTION_MARK, NO_ANSWER, NUMBER_GAP (numbers do not go up by one
    from 1). Headings and pages may come in the midst of an item; what stands before the first marker, or between a heading and a question, belongs to none.
    """
    lines = pages.filter(F.col(text).isNotNull()).select(F.col(key), F.col(page).alias("_page"), F.posexplode(F.split(plain_lines(F.col(text)), "\n")).alias("_line", "_text"))
    walk = W.partitionBy(key).orderBy("_page", "_line").rowsBetween(W.unboundedPreceding, W.currentRow)
    heading, number = F.regexp_extract("_text", HEADING, 1), F.regexp_extract("_text", QUESTION, 1)
    lines = lines.withColumns({"_heading": F.when(heading != "", F.struct(heading.alias("number"), F.trim(F.regexp_extract("_text", HEADING, 2)).alias("title"))), "_number": F.when((heading == "") & (number != ""), number)})
    marked = F.col("_heading").isNotNull() | F.col("_number").isNotNull()
    lines = lines.withColumns({"_item": F.count_if(marked).over(walk), "_section": F.last("_heading", ignorenulls=True).over(walk)})
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_page", "_line", "_text"))), lambda x: x["_text"]), "\n")
    items = lines.groupBy(key, "_item").agg(F.max("_number").alias("_number"), F.max("_section").alias("_section"), body.alias("_body"), F.min("_page").alias("start_page"), F.max("_page").alias("end_page")).filter("_number is not null")
    content = F.regexp_replace("_body", QUESTION, "")
    at = F.locate("？", content)
    question, answer = collapsed(F.substring(content, F.lit(1), at)), collapsed(F.substring(content, at + 1, F.length(content)))
    items = items.withColumns({"number": F.col("_number").cast("int"), "_at": at, "question": question, "answer": answer, "_place": F.row_number().over(W.partitionBy(key).orderBy("_item"))})
    status = F.when(F.col("_section").isNull(), "NO_SECTION").when(F.col("_at") == 0, "NO_QUESTION_MARK").when(F.col("answer") == "", "NO_ANSWER").when(F.col("number") != F.col("_place"), "NUMBER_GAP").otherwise("OK")
    rule = F.concat(F.lit("rule_"), F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col("number").cast("string"), "question"), 256), 1, 16))
    return items.select(key, "number", F.col("_section.number").alias("section_number"), F.col("_section.title").alias("section"), "question", "answer", "start_page", "end_page", tags(F.col("_section.title"), F.col("question")).alias("tags"), rule.alias("rule_id"), status.alias("status"))
