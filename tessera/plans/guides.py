"""Guides and grounded answers over the conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.postings import literal
from tessera.plans.registry import query
from tessera.session import table
from tessera.sources.guides import SECTION_TAGS, WORD_TAGS, guide_items

_TITLES = [t if t == "其他有关问题" else f"关于{t}" for t in SECTION_TAGS]
_NUMERALS = ["一", "二", "三"]
_ABOUT = ["", "年龄", "应届毕业生报名", "体检后递补", "学历和学位"]
_TOPIC = f"({literal(_ABOUT)})[1 + conv_id % {len(_ABOUT)}]"


def guide_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation as a guide: each third turn is a heading, the others are numbered questions; a page for each turn, but the answers of odd turns begin on the next page."""
    c = F.col
    x = table(spark, sf, "conversations").withColumns({"heading": c("turn") % 3 == 0, "number": c("turn") - F.floor(c("turn") / 3)})
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    head = F.concat(F.lit("  "), pick(_NUMERALS, F.floor(c("turn") / 3) % 3), F.lit("、 "), pick(_TITLES, c("conv_id") % len(_TITLES)), F.lit(" \r\n"))
    said = F.replace(F.coalesce("text", F.lit("")), F.lit("？"), F.lit(""))
    mark = F.when(c("conv_id") % 17 == 5, "。").otherwise("？")
    asked = F.concat(c("number").cast("string"), F.lit(".\t"), pick(_ABOUT, c("conv_id") % len(_ABOUT)), F.substring(said, 1, 30), mark)
    rest = F.substring(said, F.lit(31), F.length(said))
    own = F.struct(c("turn").alias("page"), F.lit(1).alias("part"), F.when(c("heading"), head).otherwise(asked).alias("text"))
    answer = F.struct((c("turn") + c("turn") % 2).alias("page"), F.when(c("turn") % 2 == 1, 0).otherwise(2).alias("part"), rest.alias("text"))
    parts = x.select("conv_id", F.explode(F.when(c("heading"), F.array(own)).otherwise(F.array(own, answer))).alias("p")).select("conv_id", "p.*")
    texts = F.array_sort(F.collect_list(F.struct("part", "text")))
    return parts.groupBy("conv_id", "page").agg(F.array_join(F.transform(texts, lambda t: t["text"]), "\n").alias("text"))


_LINE = r"trim(regexp_replace({0}, '[\s\x0c]+', ' ', 'g'))"
_TAGS = "list_distinct([" + f"({literal([*SECTION_TAGS.values()])})[1 + conv_id % {len(_TITLES)}]" + "]" + "".join(f" || CASE WHEN contains(question, '{w}') THEN ['{t}'] ELSE [] END" for w, t in WORD_TAGS.items()) + ")"


@query(rf"""WITH t AS (SELECT conv_id, turn, CAST(turn - turn // 3 AS INTEGER) AS number, {_TOPIC} || substr(replace(coalesce(text, ''), '？', ''), 1, 30) AS q, substr(replace(coalesce(text, ''), '？', ''), 31) AS a FROM conversations WHERE turn % 3 <> 0),
  x AS (SELECT *, conv_id % 17 = 5 AS broken, CASE WHEN conv_id % 17 = 5 THEN '' ELSE {_LINE.format("q || '？'")} END AS question, CASE WHEN conv_id % 17 = 5 THEN {_LINE.format("q || '。' || chr(10) || a")} ELSE {_LINE.format("a")} END AS answer FROM t)
  SELECT conv_id, number, ({literal(_NUMERALS)})[1 + (turn // 3) % 3] AS section_number, ({literal(_TITLES)})[1 + conv_id % {len(_TITLES)}] AS section, question, answer, turn AS start_page, turn + turn % 2 AS end_page, array_to_string(list_sort({_TAGS}), ',') AS tags, CASE WHEN broken THEN 'NO_QUESTION_MARK' WHEN answer = '' THEN 'NO_ANSWER' ELSE 'OK' END AS status FROM x""")
def guide_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections, questions and answers of guides by their markers, whole, with the pages on which they begin and end."""
    items = guide_items(guide_pages(spark, sf), "conv_id", "page", "text")
    return items.select("conv_id", "number", "section_number", "section", "question", "answer", "start_page", "end_page", F.array_join(F.sort_array("tags"), ",").alias("tags"), "status")


# fixed values: the sentences that an answer may be made of, what each states, and the facts that may be asked for
CLOSINGS = {
    "RANKED_LISTING": ("下面是这个范围内的岗位，按稳定性排序；资格、限制条件和截止日见下方事实块。", "SEARCH_FOUND_JOBS"),
    "NOTHING_IN_SCOPE": ("这个范围内没有找到岗位。", "SEARCH_FOUND_NOTHING"),
    "SINGLE_JOB": ("下面是这个岗位的情况；资格、限制条件和截止日见下方事实块。", "ONE_JOB_READ"),
    "PENDING_FIRST": ("还有资料项没有确认，确认之后这些岗位的结论才会更新。", "PENDING_ITEMS_LISTED"),
    "WATCHLIST_STATE": ("下面是你关注的岗位，以及自上次查看以来的变化。", "WATCHLIST_READ"),
}
QUESTIONS = {
    "WHICH_LOCATION": ("你想看哪个城市或区县的岗位？", "NONE"),
    "BROADEN_SCOPE": ("这个范围内没有找到岗位，要不要放宽城市或职位类别？", "SEARCH_FOUND_NOTHING"),
    "WHICH_ORDINAL": ("你指的是上面列表里的第几个？", "NONE"),
    "CONFIRM_FACT": ("要不要现在确认「{fact}」？", "NONE"),
    "RETRY_LATER": ("这次读不到，要不要稍后再试？", "READ_FAILED"),
}
FACTS = {"政治面貌": "POLITICAL_AFFILIATION", "性别": "GENDER", "报名时是否已落实工作单位": "EMPLOYER_SETTLEMENT_AT_APPLICATION", "报名时社保缴纳状态": "SOCIAL_INSURANCE_AT_APPLICATION"}
#: What observations must show for each statement, as conditions on an observation.
EVIDENCE = {
    "NONE": "true",
    "SEARCH_FOUND_JOBS": "tool = 'search_jobs' and n > 0",
    "SEARCH_FOUND_NOTHING": "tool = 'search_jobs' and n = 0 and complete",
    "ONE_JOB_READ": "tool = 'job_facts'",
    "PENDING_ITEMS_LISTED": "tool = 'pending_confirmations' and n > 0",
    "WATCHLIST_READ": "tool = 'watchlist'",
    "READ_FAILED": "not ok or unreadable > 0 or not complete",
}


def unified(text: Column) -> Column:
    """The template that a text is made by, what it states, whether it asks, and the fact in its slot; null if there is none.

    A slot takes what stands in its place; its value must be one of the facts by name.
    """
    found = F.lit(None)
    for asks, templates in ((False, CLOSINGS), (True, QUESTIONS)):
        for name, (words, states) in templates.items():
            before, slot, after = words.partition("{fact}")
            own = F.struct(F.lit(name).alias("template"), F.lit(states).alias("states"), F.lit(asks).alias("asks"), _slot(text, before, after).alias("fact") if slot else F.lit(None).cast("string").alias("fact"))
            fits = _slot(text, before, after).isNotNull() if slot else text == words
            found = F.when(fits, own) if name == "RANKED_LISTING" else found.when(fits, own)
    return found


def _slot(text: Column, before: str, after: str) -> Column:
    inside = F.substring(text, F.lit(len(before) + 1), F.length(text) - len(before) - len(after))
    names = F.create_map(*(F.lit(x) for pair in FACTS.items() for x in pair))
    return F.when(text.startswith(before) & text.endswith(after) & (F.length(text) >= len(before) + len(after)), F.get(F.array(names[inside]), F.lit(0)))


def grounded(answers: DataFrame, observations: DataFrame) -> DataFrame:
    """Whether each answer says only what its observations support (N04): answer, template, fact, posting (that waits for the fact), violations.

    answers: answer, text, basis (numbers of observations; null: none named), clarifying (declared to need none). observations: answer, number, tool, ok, n, complete, unreadable, waiting
    (fact and posting pairs of a list of pending confirmations). Violations, in order: UNKNOWN_TEMPLATE; UNGROUNDED; NO_OBSERVATION:i, FAILED_OBSERVATION:i;
    NOT_APPLICABLE:what; UNBOUND_CONFIRMATION. Observations meet their answers by one join; no answer is looked at row by row.
    """
    a = answers.withColumn("u", unified(F.col("text"))).select("*", "u.*").drop("u")
    named = F.col("basis").isNotNull() & (F.size("basis") > 0)
    # a closing must rest on something; a question may be declared to need nothing
    rests = F.when(F.col("asks"), named | F.col("clarifying")).otherwise(named & ~F.col("clarifying"))
    a = a.withColumn("rests", F.coalesce(rests, F.lit(False)))
    cited = a.filter("template is not null and rests").select("answer", "states", "template", "fact", F.explode_outer(F.array_distinct("basis")).alias("number"))
    facts = F.first(F.filter("waiting", lambda w: w["fact"] == F.col("fact")), ignorenulls=True)
    found = cited.join(observations.withColumn("seen", F.lit(True)), ["answer", "number"], "left")
    shows = F.lit(False)
    for what, when in EVIDENCE.items():
        shows = shows | F.coalesce((F.col("states") == what) & F.expr(when), F.lit(False)) if what != "NONE" else shows | (F.col("states") == what)
    failing = F.when(F.col("number").isNotNull() & F.col("seen").isNull(), F.concat(F.lit("NO_OBSERVATION:"), F.col("number").cast("string"))).when(~F.col("ok") & (F.col("states") != "READ_FAILED"), F.concat(F.lit("FAILED_OBSERVATION:"), F.col("number").cast("string")))
    mine = F.filter("waiting", lambda w: w["fact"] == F.col("fact"))
    binds = F.when((F.col("tool") == "pending_confirmations") & (F.size(mine) > 0), F.struct("number", F.element_at(mine, -1)["posting"].alias("posting")))
    found = found.groupBy("answer").agg(F.array_sort(F.collect_list(failing)).alias("failing"), F.bool_or(F.coalesce(shows & (F.col("seen") | (F.col("states") == "NONE")), F.lit(False))).alias("shown"), F.max(binds)["posting"].alias("posting"))
    out = a.join(found, "answer", "left")
    bad = F.size(F.coalesce("failing", F.array().cast("array<string>"))) > 0
    unbound = (F.col("template") == "CONFIRM_FACT") & F.col("posting").isNull()
    violations = (
        F.when(F.col("template").isNull(), F.array(F.lit("UNKNOWN_TEMPLATE"))).when(~F.col("rests"), F.array(F.lit("UNGROUNDED"))).when(bad, F.col("failing"))
        .when(~F.col("shown"), F.array(F.concat(F.lit("NOT_APPLICABLE:"), "states"))).when(unbound, F.array(F.lit("UNBOUND_CONFIRMATION"))).otherwise(F.array().cast("array<string>"))
    )
    return out.select("answer", "template", "fact", F.when(~bad & (F.col("template") == "CONFIRM_FACT"), F.col("posting")).alias("posting"), violations.alias("violations"))


_SAID = [*(t for t, _ in CLOSINGS.values()), *(t for name, (t, _) in QUESTIONS.items() if name != "CONFIRM_FACT"), *(QUESTIONS["CONFIRM_FACT"][0].replace("{fact}", f) for f in (*FACTS, "体重")), "这个范围内有三个岗位。"]
_TOOLS = ["search_jobs", "job_facts", "pending_confirmations", "watchlist"]
_KEYS = [*FACTS.values()]


def answers_and_observations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Each turn of the conversations as an answer (every seventh is the turn's own text), with up to four observations."""
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    k = F.col("answer")
    x = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("answer"), F.col("text").alias("own"))
    basis = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.array().cast("array<int>")).otherwise(F.array((k % 5 + 1).cast("int"), (k % 3 + 1).cast("int")))
    answers = x.select("answer", F.when(k % 7 == 3, F.col("own")).otherwise(pick(_SAID, k)).alias("text"), basis.alias("basis"), (k % 6 == 1).alias("clarifying"))
    o = x.select("answer", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("number")).withColumn("m", k + F.col("number") * 3)
    m = F.col("m")
    waiting = F.array(F.struct(pick(_KEYS, m).alias("fact"), (m * 10).alias("posting")), F.struct(pick(_KEYS, m + 1).alias("fact"), (m * 10 + 1).alias("posting")))
    return answers, o.filter(F.col("number") <= k % 4 + 1).select("answer", "number", pick(_TOOLS, F.floor(m / 2)).alias("tool"), (m % 5 != 0).alias("ok"), (m % 3).alias("n"), F.when(m % 4 < 2, True).when(m % 4 == 2, False).alias("complete"), (m % 7 == 0).cast("int").alias("unreadable"), F.when(pick(_TOOLS, F.floor(m / 2)) == "pending_confirmations", waiting).otherwise(F.array().cast("array<struct<fact: string, posting: bigint>>")).alias("waiting"))


_TEMPLATES = " UNION ALL ".join(f"SELECT {literal(t)} AS text, '{n}' AS template, '{s}' AS states, {literal(asks)} AS asks, CAST(NULL AS VARCHAR) AS fact" for asks, ts in ((False, CLOSINGS), (True, QUESTIONS)) for n, (t, s) in ts.items() if n != "CONFIRM_FACT") + "".join(f" UNION ALL SELECT {literal(QUESTIONS['CONFIRM_FACT'][0].replace('{fact}', f))}, 'CONFIRM_FACT', 'NONE', true, '{c}'" for f, c in FACTS.items())


@query(f"""WITH t AS ({_TEMPLATES}), k AS (SELECT conv_id * 100 + turn AS answer, text AS own FROM conversations),
  a AS (SELECT answer, CASE WHEN answer % 7 = 3 THEN own ELSE ({literal(_SAID)})[1 + answer % {len(_SAID)}] END AS text, CASE WHEN answer % 11 = 0 THEN NULL WHEN answer % 13 = 0 THEN [] ELSE [answer % 5 + 1, answer % 3 + 1] END AS basis, answer % 6 = 1 AS clarifying FROM k),
  u AS (SELECT a.*, t.template, t.states, t.asks, t.fact, CASE WHEN t.asks THEN coalesce(len(basis), 0) > 0 OR clarifying ELSE coalesce(len(basis), 0) > 0 AND NOT clarifying END AS rests FROM a LEFT JOIN t USING (text)),
  o AS (SELECT answer, number, answer + number * 3 AS m, ({literal(_TOOLS)})[1 + ((answer + number * 3) // 2) % 4] AS tool FROM k, (SELECT unnest(range(1, 5)) AS number) WHERE number <= answer % 4 + 1),
  c AS (SELECT DISTINCT answer, states, fact, unnest(basis) AS number FROM u WHERE template IS NOT NULL AND rests),
  f AS (SELECT c.answer, list(CASE WHEN o.m IS NULL THEN 'NO_OBSERVATION:' || c.number WHEN m % 5 = 0 AND states <> 'READ_FAILED' THEN 'FAILED_OBSERVATION:' || c.number END) AS bad,
    bool_or(o.m IS NOT NULL AND coalesce(CASE states WHEN 'SEARCH_FOUND_JOBS' THEN tool = 'search_jobs' AND m % 3 > 0 WHEN 'SEARCH_FOUND_NOTHING' THEN tool = 'search_jobs' AND m % 3 = 0 AND m % 4 < 2 WHEN 'ONE_JOB_READ' THEN tool = 'job_facts' WHEN 'PENDING_ITEMS_LISTED' THEN tool = 'pending_confirmations' AND m % 3 > 0
      WHEN 'WATCHLIST_READ' THEN tool = 'watchlist' WHEN 'READ_FAILED' THEN m % 5 = 0 OR m % 7 = 0 OR m % 4 = 2 END, false)) AS shown,
    arg_max(CASE WHEN ({literal(_KEYS)})[1 + (m + 1) % 4] = fact THEN m * 10 + 1 WHEN ({literal(_KEYS)})[1 + m % 4] = fact THEN m * 10 END, CASE WHEN tool = 'pending_confirmations' AND fact IN (({literal(_KEYS)})[1 + m % 4], ({literal(_KEYS)})[1 + (m + 1) % 4]) THEN c.number END) AS posting FROM c LEFT JOIN o ON o.answer = c.answer AND o.number = c.number GROUP BY c.answer),
  v AS (SELECT u.*, list_sort(list_filter(coalesce(bad, []), lambda x: x IS NOT NULL)) AS failing, coalesce(shown, false) OR states = 'NONE' AS shows, posting FROM u LEFT JOIN f USING (answer))
  SELECT answer, template, fact, CASE WHEN template = 'CONFIRM_FACT' AND len(failing) = 0 THEN posting END AS posting, CASE WHEN template IS NULL THEN 'UNKNOWN_TEMPLATE' WHEN NOT rests THEN 'UNGROUNDED' WHEN len(failing) > 0 THEN array_to_string(failing, ',') WHEN NOT shows THEN 'NOT_APPLICABLE:' || states WHEN template = 'CONFIRM_FACT' AND posting IS NULL THEN 'UNBOUND_CONFIRMATION' ELSE '' END AS violations FROM v""")
def answer_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Answers unified with the sentences that they may be made of, and held against what was observed."""
    return grounded(*answers_and_observations(spark, sf)).withColumn("violations", F.array_join("violations", ","))
