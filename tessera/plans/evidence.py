"""Queries on what bears facts out, and on what is to be done next (survey A34, R28, R39, X02, X19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.plans.matching import evidence_tasks
from tessera.plans.postings import literal, picked, picked_sql
from tessera.plans.registry import ORACLE, query
from tessera.session import table

#: Statements of a notice, and whether they rule on the physical exam, the investigation, the publication and the appointment.
STATEMENTS = [("聘用前进行体检和考察", "1101"), ("拟聘人员名单公示七天", "0010"), ("签订三年劳动合同", "0001"), ("录用前须体检", "1001"), ("编制内", "0000"), ("考察合格后公示并聘用", "0111"), (None, "0000")]
#: What a rule's statement mentions, as a pattern.
RULED = {"exam": "体检", "investigation": "考察", "publication": "公示", "appointment": "聘用|录用|签订.*合同"}
#: When a stage's date is known (the tables have none; the key decides).
DATED = {"notice": "o_orderkey % 5 > 0", "application": "o_orderkey % 3 = 0 OR o_orderkey % 7 = 0", "review": "o_orderkey % 4 > 0", "payment": "o_orderkey % 6 > 0", "ticket": "o_orderkey % 2 = 0 OR o_orderkey % 9 = 0"}
_DEALT = f"[1 + o_orderkey % {len(STATEMENTS)}]"


def known(seen: Column) -> Column:
    """A stage's state: confirmed if there is a date or rule, else not collected."""
    return F.when(seen, "CONFIRMED").otherwise("NOT_COLLECTED")


@query(
    "WITH s AS (SELECT *, (" + literal([t for t, _ in STATEMENTS]) + f"){_DEALT} AS text, (" + literal([r for _, r in STATEMENTS]) + f"){_DEALT} AS ruled FROM orders) SELECT o_orderkey, "
    + ", ".join(f"CASE WHEN {when} THEN 'CONFIRMED' ELSE 'NOT_COLLECTED' END AS {name}_state" for name, when in DATED.items()) + ", "
    + ", ".join(f"CASE WHEN ruled[{i}] = '1' THEN 'CONFIRMED' ELSE 'NOT_COLLECTED' END AS {name}_state, CASE WHEN ruled[{i}] = '1' THEN text END AS {name}_rule" for i, name in enumerate(RULED, 1)) + " FROM s"
)
def process_states(spark: SparkSession, sf: str) -> DataFrame:
    """States of the stages of a process, from the dates that are known and from what the notice's statement rules on."""
    text = F.element_at(F.array(*(F.lit(t) for t, _ in STATEMENTS)), (F.col("o_orderkey") % len(STATEMENTS) + 1).cast("int"))
    dated = [known(F.expr(when)).alias(f"{name}_state") for name, when in DATED.items()]
    ruled = [c for name, pattern in RULED.items() for c in (known(text.rlike(pattern)).alias(f"{name}_state"), F.when(text.rlike(pattern), text).alias(f"{name}_rule"))]
    return table(spark, sf, "orders").select("o_orderkey", *dated, *ruled)


@query(" UNION ALL ".join(f"SELECT p_partkey, '{name}' AS field, {picked_sql(name)} AS said FROM part WHERE {picked_sql(name)} IS NOT NULL AND {picked_sql(name, True)} IS NULL" for name in ("age", "experience")))
def import_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of a row that say something of which no single value could be made; the text is kept for a check."""
    read = {"age": tx.age_limit, "experience": tx.experience_years}
    p = table(spark, sf, "part").select("p_partkey", *(picked(name).alias(name) for name in read))
    odd = F.array_compact(F.array(*(F.when(F.col(name).isNotNull() & f(F.col(name)).isNull(), F.struct(F.lit(name).alias("field"), F.col(name).alias("said"))) for name, f in read.items())))
    return p.select("p_partkey", F.explode(odd).alias("w")).select("p_partkey", "w.*")


_REFERENCES = "CASE p_partkey % 5 WHEN 0 THEN {0}{1} WHEN 1 THEN {0}p_partkey{1} WHEN 2 THEN {0}p_partkey, -p_partkey{1} WHEN 3 THEN {0}p_partkey + 1{1} ELSE {0}-p_partkey, p_partkey + 1, p_partkey{1} END"
_STATUS = "CASE p_partkey % 7 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'INTERPRETED' ELSE 'EXPLICIT' END"


@query(f"""WITH p AS (SELECT p_partkey, {_STATUS} AS status, {_REFERENCES.format("[", "]")} AS refs, p_name, CAST(p_size AS VARCHAR) AS size, concat(p_name, '，招聘', p_size, '人') AS text FROM part),
  f AS (SELECT p_partkey, 'title' AS path, p_name AS value, status, refs FROM p UNION ALL SELECT p_partkey, 'headcount', size, status, refs FROM p),
  r AS (SELECT p_partkey, path, value, status, unnest(CASE WHEN len(refs) = 0 THEN [NULL] ELSE refs END) AS ref, generate_subscripts(CASE WHEN len(refs) = 0 THEN [NULL] ELSE refs END, 1) AS pos FROM f WHERE status <> 'UNKNOWN'),
  g AS (SELECT r.p_partkey, path, bool_or(r.status = 'INTERPRETED') AS interpreted, count(ref) = 0 AS unevidenced, count(ref) - count(t.p_partkey) AS n_missing, count(t.p_partkey) AS n_there,
    bool_or(coalesce(CASE WHEN path = 'headcount' THEN regexp_matches(concat(' ', t.text, ' '), concat('[^0-9]', value, '[^0-9]')) ELSE contains(t.text, value) END, false)) AS borne_out, arg_min(ref, pos) FILTER (WHERE t.p_partkey IS NOT NULL) AS first_there
    FROM r LEFT JOIN p t ON t.p_partkey = r.ref GROUP BY r.p_partkey, path)
  SELECT p_partkey, path, interpreted, unevidenced, n_missing, n_there > 0 AND NOT borne_out AS unsupported, CASE WHEN n_there > 0 AND NOT borne_out THEN first_there END AS fragment FROM g WHERE interpreted OR unevidenced OR n_missing > 0 OR (n_there > 0 AND NOT borne_out)""")
def evidence_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Facts that are interpreted, cite nothing, cite fragments that do not exist, or whose fragments do not bear their value out (with the first of these). Unknown facts are not asked for evidence."""
    p = table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    facts = F.array(F.struct(F.lit("title").alias("path"), F.col("p_name").alias("value")), F.struct(F.lit("headcount").alias("path"), size.alias("value")))
    cited = p.select("p_partkey", F.expr(_STATUS).alias("status"), F.expr(_REFERENCES.format("array(", ")")).cast("array<long>").alias("refs"), F.explode(facts).alias("f")).filter("status <> 'UNKNOWN'")
    cited = cited.select("p_partkey", "status", "f.*", F.posexplode_outer("refs").alias("pos", "ref"))
    fragments = p.select(F.col("p_partkey").alias("ref"), F.concat("p_name", F.lit("，招聘"), size, F.lit("人")).alias("text"), F.lit(1).alias("there"))
    there = F.col("there").isNotNull()
    found = cited.join(fragments, "ref", "left").groupBy("p_partkey", "path").agg(
        F.bool_or(F.col("status") == "INTERPRETED").alias("interpreted"),
        (F.count("ref") == 0).alias("unevidenced"),
        (F.count("ref") - F.count("there")).alias("n_missing"),
        ((F.count("there") > 0) & ~F.bool_or(F.when(there, tx.supports(F.col("value"), F.col("text"))).otherwise(False))).alias("unsupported"),
        F.min_by("ref", F.when(there, F.col("pos"))).alias("first"),
    )
    return found.filter("interpreted or unevidenced or n_missing > 0 or unsupported").select("p_partkey", "path", "interpreted", "unevidenced", "n_missing", "unsupported", F.when(F.col("unsupported"), F.col("first")).alias("fragment"))


@query("""SELECT count(DISTINCT CASE WHEN o_orderkey % 11 > 0 THEN o_orderpriority END) AS sources, count(DISTINCT o_custkey) AS events, count(*) AS postings, count(*) FILTER (WHERE o_orderstatus = 'F') AS evidenced,
  coalesce(max(CASE WHEN o_orderkey % 13 > 0 THEN o_orderdate END), TIMESTAMP '2002-01-01') AS loaded FROM orders""")
def analysis_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How many sources (blank ones are none), events and postings an analysis rests on, how many of them have their evidence, and when the last was loaded; with none, the analysis' own time."""
    source = F.nullif(F.trim(F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderpriority")).otherwise(" ")), F.lit(""))
    loaded = F.max(F.when(F.col("o_orderkey") % 13 > 0, F.col("o_orderdate")))
    return table(spark, sf, "orders").agg(F.count_distinct(source).alias("sources"), F.count_distinct("o_custkey").alias("events"), F.count(F.lit(1)).alias("postings"), F.count_if(F.col("o_orderstatus") == "F").alias("evidenced"), F.coalesce(loaded, F.lit("2002-01-01").cast("timestamp_ntz")).alias("loaded"))


#: The day of the list, the days that a deadline is announced before, and how many actions a person is shown.
TODAY, AHEAD, SHOWN = "1999-12-20", 14, 3
#: Tasks that matter more than others.
URGENT = ("CONFIRM_MASTER_GRADUATION_MONTH", "VERIFY_MASTER_CREDENTIAL")


@query(f"""WITH j AS (SELECT o_custkey AS person, o_orderkey, CAST(o_orderdate AS DATE) AS due FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW'),
  a AS (SELECT person, 'CURRENT_JOB_DEADLINE' AS kind, concat('deadline:', o_orderkey) AS id, 1 AS priority, due, 1 AS affected FROM j WHERE due BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + {AHEAD}
  UNION ALL SELECT person, 'CANDIDATE_EVIDENCE', concat('evidence:', code), CASE WHEN code IN {URGENT} THEN 2 ELSE 3 END, NULL, affected FROM ({ORACLE["evidence_tasks"]})
  UNION ALL SELECT user_id, 'TARGET_JOB_CHANGE', concat('change:', event_id), 3, NULL, 1 + event_id % 40 FROM events WHERE event_type = 'error'
  UNION ALL SELECT c_custkey, 'PREPARATION_TIMELINE', 'preparation:PREPARE_WRITTEN_EXAM_BASELINE', 2, NULL, 0 FROM customer WHERE c_custkey NOT IN (SELECT person FROM j)),
  r AS (SELECT person, kind, id, due, affected, row_number() OVER (PARTITION BY person ORDER BY priority, due NULLS LAST, affected DESC, kind, id) AS place FROM a)
  SELECT * FROM r WHERE place <= {SHOWN}""")
def next_actions(spark: SparkSession, sf: str) -> DataFrame:
    """The three actions that come first for each person: deadlines near, evidence to give, changes of postings; who has no posting to apply for is told to prepare."""

    def actions(df: DataFrame, person: str, kind: str, key: Column, priority: Column, due: Column, affected: Column) -> DataFrame:
        return df.select(F.col(person).alias("person"), F.lit(kind).alias("kind"), key.alias("id"), priority.alias("priority"), due.cast("date").alias("due"), affected.cast("long").alias("affected"))

    def labelled(prefix: str, key: str) -> Column:
        return F.concat(F.lit(prefix), F.col(key).cast("string"))

    none, today = F.lit(None), F.lit(TODAY).cast("date")
    open_jobs = table(spark, sf, "orders").filter("o_orderstatus <> 'F' and o_orderpriority <> '5-LOW'").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("due"))
    deadlines = actions(open_jobs.filter(F.col("due").between(today, F.date_add(today, AHEAD))), "o_custkey", "CURRENT_JOB_DEADLINE", labelled("deadline:", "o_orderkey"), F.lit(1), F.col("due"), F.lit(1))
    tasks = actions(evidence_tasks(spark, sf), "person", "CANDIDATE_EVIDENCE", labelled("evidence:", "code"), F.when(F.col("code").isin(*URGENT), 2).otherwise(3), none, F.col("affected"))
    changes = actions(table(spark, sf, "events").filter("event_type = 'error'"), "user_id", "TARGET_JOB_CHANGE", labelled("change:", "event_id"), F.lit(3), none, 1 + F.col("event_id") % 40)
    idle = table(spark, sf, "customer").join(open_jobs.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    prepare = actions(idle, "c_custkey", "PREPARATION_TIMELINE", F.lit("preparation:PREPARE_WRITTEN_EXAM_BASELINE"), F.lit(2), none, F.lit(0))
    place = F.row_number().over(W.partitionBy("person").orderBy("priority", F.asc_nulls_last("due"), F.desc("affected"), "kind", "id"))
    listed = deadlines.unionByName(tasks).unionByName(changes).unionByName(prepare).withColumn("place", place.cast("long"))
    return listed.filter(F.col("place") <= SHOWN).drop("priority")
