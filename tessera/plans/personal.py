"""Queries on a person's side: questions, planner replies, sessions, evidence tasks, orders of lists, upkeep of facts (survey F27, F38, F42, X13, X17, N05, R27, O07-O09, J07, J12, A30, K16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import joins
from tessera.plans.postings import literal
from tessera.functions.cron import with_next_run
from tessera.plans.registry import query
from tessera.session import table


def dealt(choices: list, key: Column) -> Column:
    """The choice that a key is dealt."""
    return F.element_at(F.array(*map(F.lit, choices)), (key % len(choices) + 1).cast("int"))


def question(text: Column) -> tuple[Column, Column, Column]:
    """tier, place and kind of work that a question names; null if it names none."""
    upper, lower = F.upper(text), F.lower(text)
    tier = F.when(upper.contains("T1") | text.contains("编制"), "T1").when(upper.contains("T2"), "T2").when(upper.contains("T3"), "T3")
    place = F.when(text.contains("杭州"), "杭州").when(text.contains("浙江"), "浙江")
    kind = F.when(text.rlike("信息化|信息中心"), "INFORMATION_SYSTEMS").when(text.contains("人工智能") | lower.contains("ai"), "AI").when(text.contains("数据"), "DATA").when(text.contains("运维"), "IT_OPERATIONS").when(text.contains("软件") | lower.contains("java"), "SOFTWARE")
    return tier, place, kind


QUESTIONS = [("杭州有哪些编制内的信息化岗位", "T1", "杭州", "INFORMATION_SYSTEMS"), ("浙江 t2 数据岗", "T2", "浙江", "DATA"), ("T3 Java 开发", "T3", None, "SOFTWARE"), ("人工智能方向的数据岗位", None, None, "AI"), ("上海运维", None, None, "IT_OPERATIONS"), ("我能报什么", None, None, None)]


def _said(i: int, name: str, key: str, choices: list) -> str:
    return f"({literal([c[i] for c in choices])})[1 + ({key}) % {len(choices)}] AS {name}"


@query("SELECT conv_id, turn, " + ", ".join(_said(i + 1, n, "conv_id + turn", QUESTIONS) for i, n in enumerate(("tier", "place", "kind"))) + " FROM conversations")
def question_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Filters out of questions; turns stand for them, each with one of the texts above."""
    parts = question(dealt([q[0] for q in QUESTIONS], F.col("conv_id") + F.col("turn")))
    return table(spark, sf, "conversations").select("conv_id", "turn", *(p.alias(n) for p, n in zip(parts, ("tier", "place", "kind"), strict=True)))


def planner_step(reply: Column) -> tuple[Column, Column, Column]:
    """Action, name and number of arguments of a planner's reply; null unless exactly one line acts, at most one says why and one names a basis, and nothing is left over."""
    lines = F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), "\\R"), lambda x: F.trim(x)), lambda x: x != "")
    act, other = r"^(TOOL|ASK|FINISH)\s+\S", r"^(WHY|BASIS)[:：]\s*\S"
    acts = F.filter(lines, lambda x: x.rlike(act))
    count = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    line = F.get(acts, F.lit(0))
    words = F.slice(F.split(line, r"\s+"), F.lit(3), F.greatest(F.size(F.split(line, r"\s+")) - 2, F.lit(0)))
    names = F.transform(words, lambda w: F.split(w, "=")[0])
    whole = F.forall(words, lambda w: w.rlike(r"^[a-z_]+=\S+$")) & (F.size(F.array_distinct(names)) == F.size(names))
    fine = (F.size(acts) == 1) & (count("^WHY[:：]") <= 1) & (count("^BASIS[:：]") <= 1) & F.forall(lines, lambda x: x.rlike(act) | x.rlike(other)) & whole
    return F.when(fine, F.regexp_extract(line, "^(TOOL|ASK|FINISH)", 1)), F.when(fine, F.split(line, r"\s+")[1]), F.when(fine, F.size(words))


REPLIES = [
    ("TOOL search_jobs city=hangzhou tier=T1\nWHY: 先查岗位", "TOOL", "search_jobs", 2), ("FINISH summary", "FINISH", "summary", 0), ("TOOL search_jobs 杭州", None, None, None), ("TOOL a x=1 x=2", None, None, None),
    ("ASK gender\n\nBASIS: 画像", "ASK", "gender", 0), ("TOOL a\nFINISH b", None, None, None), ("随便说说", None, None, None), ("ASK a\nWHY: x\nWHY: y", None, None, None), (None, None, None, None),
]


@query("SELECT conv_id, turn, " + ", ".join(_said(i + 1, n, "conv_id * 5 + turn", REPLIES) for i, n in enumerate(("action", "name", "arguments"))) + " FROM conversations")
def planner_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies by their grammar."""
    parts = planner_step(dealt([r[0] for r in REPLIES], F.col("conv_id") * 5 + F.col("turn")))
    return table(spark, sf, "conversations").select("conv_id", "turn", *(p.alias(n) for p, n in zip(parts, ("action", "name", "arguments"), strict=True)))


@query("""WITH l AS (SELECT o_custkey AS person, o_orderkey AS posting, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS ordinal FROM orders WHERE o_custkey % 5 <> 0), q AS (SELECT c_custkey AS person, 1 + c_custkey % 9 AS asked, c_custkey % 7 <> 0 AS same FROM customer)
  SELECT q.person, asked, CASE WHEN NOT EXISTS (SELECT 1 FROM l WHERE l.person = q.person) THEN 'NO_SESSION' WHEN NOT same THEN 'STALE_LISTING' WHEN l.posting IS NULL THEN 'OUT_OF_RANGE' ELSE 'RESOLVED' END AS state, CASE WHEN same THEN l.posting END AS posting FROM q LEFT JOIN l ON l.person = q.person AND l.ordinal = q.asked""")
def session_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    """What "the third one" means in a session; nothing, once the profile has another version than the list."""
    k = F.col("c_custkey")
    asked = table(spark, sf, "customer").select(k.alias("person"), (1 + k % 9).alias("asked"), (k % 7 != 0).alias("same"))
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    listed = table(spark, sf, "orders").filter("o_custkey % 5 <> 0").select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("posting"), place.cast("long").alias("asked"))
    found = asked.join(listed, ["person", "asked"], "left").join(listed.select("person").distinct().withColumn("session", F.lit(True)), "person", "left")
    state = F.when(F.col("session").isNull(), "NO_SESSION").when(~F.col("same"), "STALE_LISTING").when(F.col("posting").isNull(), "OUT_OF_RANGE").otherwise("RESOLVED")
    return found.select("person", "asked", state.alias("state"), F.when(F.col("same"), F.col("posting")).alias("posting"))


@query("""WITH d AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'NEW' WHEN 'P' THEN 'UPDATED' ELSE 'DEADLINE_APPROACHING' END AS reason, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 30 AS INTEGER) END AS days FROM orders)
  SELECT o_custkey, o_orderkey, reason, days, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE reason WHEN 'NEW' THEN 0 WHEN 'UPDATED' THEN 1 ELSE 3 END, coalesce(days, 2147483647), o_orderkey) AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY reason = 'UPDATED' DESC, days NULLS LAST, o_orderkey) AS watch_place FROM d""")
def ordered_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The order of a digest (reason, days left with unknown last, key) and that of a watch list (changed first, deadlines with unknown last, key)."""
    reason = F.when(F.col("o_orderstatus") == "O", "NEW").when(F.col("o_orderstatus") == "P", "UPDATED").otherwise("DEADLINE_APPROACHING")
    d = table(spark, sf, "orders").select("o_custkey", "o_orderkey", reason.alias("reason"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 30).cast("int").alias("days"))
    ordinal = F.array_position(F.array(*map(F.lit, ("NEW", "UPDATED", "DEACTIVATED", "DEADLINE_APPROACHING"))), F.col("reason"))
    own = W.partitionBy("o_custkey")
    return d.withColumn("place", F.row_number().over(own.orderBy(ordinal, F.coalesce("days", F.lit(2**31 - 1)), "o_orderkey")).cast("long")).withColumn("watch_place", F.row_number().over(own.orderBy((F.col("reason") == "UPDATED").desc(), F.col("days").asc_nulls_last(), "o_orderkey")).cast("long"))


@query("""WITH fact AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 > 0 THEN l_orderkey END AS fragment FROM lineitem), fragment AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END AS evidence FROM orders)
  SELECT l_orderkey, l_linenumber, o_orderkey AS fragment, c_custkey AS evidence, CASE WHEN c_custkey IS NOT NULL THEN 'EVIDENCED' WHEN o_orderkey IS NOT NULL THEN 'FRAGMENT_ONLY' ELSE 'MISSING' END AS state FROM fact LEFT JOIN fragment ON o_orderkey = fragment LEFT JOIN customer ON c_custkey = evidence""")
def evidence_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Facts with their fragments and those fragments' evidence, either of which may be missing."""
    fact = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 > 0, F.col("l_orderkey")).alias("key"))
    fragment = table(spark, sf, "orders").select(F.col("o_orderkey").alias("fragment"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey")).alias("source"))
    proof = table(spark, sf, "customer").select(F.col("c_custkey").alias("evidence"))
    # fragments meet their evidence first: they are fewer than facts
    x = joins.where_known(fact, joins.where_known(fragment, proof, "source", "evidence"), "key", "fragment")
    state = F.when(F.col("evidence").isNotNull(), "EVIDENCED").when(F.col("fragment").isNotNull(), "FRAGMENT_ONLY").otherwise("MISSING")
    return x.select("l_orderkey", "l_linenumber", "fragment", "evidence", state.alias("state"))


@query("""SELECT c_nationkey, year(o_orderdate) AS year, count(DISTINCT l_partkey) AS targets FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F' AND l_quantity > 10 GROUP BY ALL""")
def active_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct active targets over three joined tables, by source and year."""
    x = table(spark, sf, "lineitem").filter("l_quantity > 10").join(table(spark, sf, "orders").filter("o_orderstatus <> 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return x.groupBy("c_nationkey", F.year("o_orderdate").cast("long").alias("year")).agg(F.countDistinct("l_partkey").alias("targets"))


@query("""WITH m AS (SELECT event_id, json_merge_patch(props, CASE WHEN event_id % 2 = 0 THEN '{"stage": "done"}' ELSE '{"k": 0}' END) AS j FROM events) SELECT event_id, CAST(j ->> '$.k' AS BIGINT) AS k, j ->> '$.stage' AS stage, CAST(len(json_keys(j)) AS BIGINT) AS n FROM m""")
def json_merge(spark: SparkSession, sf: str) -> DataFrame:
    """An object merged over another, key by key, and its keys counted."""
    own = F.from_json("props", "map<string,string>")
    over = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("stage"), F.lit("done"))).otherwise(F.create_map(F.lit("k"), F.lit("0")))
    merged = F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(over, k)), over)
    x = table(spark, sf, "events").withColumn("j", F.from_json(F.to_json(merged), "map<string,string>"))
    return x.select("event_id", F.col("j")["k"].cast("long").alias("k"), F.col("j")["stage"].alias("stage"), F.size("j").cast("long").alias("n"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'purchase') AS confirmed, count(*) FILTER (event_type = 'click') AS proposed, count(*) FILTER (event_type = 'error') AS rejected, coalesce(bool_and(event_type = 'purchase') FILTER (event_id % 40 = 0), true) AS hard_confirmed FROM events GROUP BY user_id""")
def fact_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts by status, and whether all hard ones are confirmed."""
    n = lambda t: F.count_if(F.col("event_type") == t)
    hard = F.every(F.when(F.col("event_id") % 40 == 0, F.col("event_type") == "purchase"))
    return table(spark, sf, "events").groupBy("user_id").agg(n("purchase").alias("confirmed"), n("click").alias("proposed"), n("error").alias("rejected"), F.coalesce(hard, F.lit(True)).alias("hard_confirmed"))


@query("""WITH s AS (SELECT p_partkey, p_brand AS identity, p_size AS print, CASE p_partkey % 3 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'NORMALIZED' ELSE 'RAW' END AS quality, p_partkey % 3 = 0 AS included FROM part WHERE p_partkey % 10 <> 9),
  i AS (SELECT p_partkey, CASE WHEN p_partkey % 8 = 1 THEN 'Brand#0' ELSE p_brand END AS identity, CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END AS print, p_partkey % 6 = 0 AS ready FROM part)
  SELECT p_partkey, CASE WHEN s.quality IS NULL OR i.print <> s.print OR i.identity <> s.identity THEN 'RAW' ELSE s.quality END AS quality, coalesce(i.print = s.print AND i.identity = s.identity AND s.included, false) AS included,
  CASE WHEN s.quality IS NULL THEN 'INITIALISED' WHEN i.identity <> s.identity THEN 'RESET_BY_IDENTITY' WHEN i.print <> s.print THEN 'RESET_BY_CONTENT' WHEN i.ready AND NOT (s.quality = 'VERIFIED' AND s.included) THEN 'REJECTED' ELSE 'KEPT' END AS trigger FROM i LEFT JOIN s USING (p_partkey)""")
def admission_triggers(spark: SparkSession, sf: str) -> DataFrame:
    """What an upsert does to a posting's admission: new ones start raw, another identity or content resets, and readiness without admission is rejected."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    quality = F.when(k % 3 == 0, "VERIFIED").when(k % 3 == 1, "NORMALIZED").otherwise("RAW")
    stored = p.filter(k % 10 != 9).select(k, F.col("p_brand").alias("identity"), F.col("p_size").alias("print"), quality.alias("quality"), (k % 3 == 0).alias("included"))
    new = p.select(k, F.when(k % 8 == 1, "Brand#0").otherwise(F.col("p_brand")).alias("new_identity"), F.when(k % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("new_print"), (k % 6 == 0).alias("ready"))
    x = new.join(stored, "p_partkey", "left")
    other, edited = F.col("new_identity") != F.col("identity"), F.col("new_print") != F.col("print")
    admitted = (F.col("quality") == "VERIFIED") & F.col("included")
    what = F.when(F.col("quality").isNull(), "INITIALISED").when(other, "RESET_BY_IDENTITY").when(edited, "RESET_BY_CONTENT").when(F.col("ready") & ~admitted, "REJECTED").otherwise("KEPT")
    return x.select(k, F.when(F.col("quality").isNull() | other | edited, "RAW").otherwise(F.col("quality")).alias("quality"), F.coalesce(~other & ~edited & F.col("included"), F.lit(False)).alias("included"), what.alias("trigger"))


def next_daily(at: Column, hour: int, minute: int, zone: str) -> Column:
    """the next time after a moment (UTC, without zone) that a daily schedule of a zone is due, in UTC."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), at)
    today = F.date_trunc("day", local) + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute))
    due = F.when(today > local, today).otherwise(today + F.expr("interval 1 day"))
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), due.cast("timestamp_ntz"))


@query("""WITH l AS (SELECT event_id, ts + INTERVAL 8 HOUR AS t FROM events), d AS (SELECT event_id, t, date_trunc('day', t) + INTERVAL 510 MINUTE AS today FROM l) SELECT event_id, CAST(CASE WHEN today > t THEN today ELSE today + INTERVAL 1 DAY END - INTERVAL 8 HOUR AS TIMESTAMP) AS due FROM d""")
def next_due(spark: SparkSession, sf: str) -> DataFrame:
    """the next run at 8:30 in a zone of its own."""
    return table(spark, sf, "events").select("event_id", next_daily(F.col("ts"), 8, 30, "Asia/Shanghai").alias("due"))


#: Schedules that sources are dealt, each with its zone.
SCHEDULES = (("0 30 8 * * *", "Asia/Shanghai"), ("0 0 9-17 * * MON-FRI", "Asia/Shanghai"), ("0 0 6,19 * * *", "UTC"), ("0 0/15 * * * *", "UTC"), ("0 0 0 1 * *", "Asia/Kolkata"), ("0 0 0 L * *", "UTC"), ("0 5 4 ? * 2#1", "Asia/Shanghai"), ("0 0 12 29 2,3 *", "UTC"))


@query("""WITH m AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-31 12:00:00', TIMESTAMP '2024-04-02', INTERVAL 5 MINUTE)) AS t), l AS (SELECT t, t + INTERVAL 8 HOUR AS c, t + INTERVAL 330 MINUTE AS i FROM m),
  r AS (SELECT 0 AS k, t FROM l WHERE hour(c) = 8 AND minute(c) = 30 UNION ALL SELECT 1, t FROM l WHERE hour(c) BETWEEN 9 AND 17 AND minute(c) = 0 AND isodow(c) < 6 UNION ALL SELECT 2, t FROM l WHERE hour(t) IN (6, 19) AND minute(t) = 0
    UNION ALL SELECT 3, t FROM l WHERE minute(t) % 15 = 0 UNION ALL SELECT 4, t FROM l WHERE day(i) = 1 AND hour(i) = 0 AND minute(i) = 0 UNION ALL SELECT 5, t FROM l WHERE CAST(t AS DATE) = last_day(t) AND hour(t) = 0 AND minute(t) = 0
    UNION ALL SELECT 6, t FROM l WHERE isodow(c) = 2 AND day(c) <= 7 AND hour(c) = 4 AND minute(c) = 5 UNION ALL SELECT 7, t FROM l WHERE day(t) = 29 AND month(t) IN (2, 3) AND hour(t) = 12 AND minute(t) = 0)
  SELECT event_id, r.t AS due FROM (SELECT event_id, ts, CAST(event_id % 8 AS INTEGER) AS k FROM events) e ASOF JOIN r ON e.k = r.k AND e.ts < r.t""")
def next_scheduled(spark: SparkSession, sf: str) -> DataFrame:
    """the next run of each source by its own schedule, in its own zone."""
    which = (F.col("event_id") % len(SCHEDULES) + 1).cast("int")
    e = table(spark, sf, "events").select("event_id", "ts", *(F.element_at(F.array(*map(F.lit, x)), which).alias(n) for n, x in zip(("schedule", "zone"), zip(*SCHEDULES, strict=True), strict=True)))
    return with_next_run(e, "ts", "schedule", "zone", "due").select("event_id", "due")
