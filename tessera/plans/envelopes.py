"""Facts put together: answer blocks, fragments by field, audit envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.postings import EVALUATED, evaluated, postings
from tessera.plans.registry import query
from tessera.session import table

#: Fields of facts by the words that stand for them; restrictions come last, and all of them (fixed values).
LABELS = {"ELIGIBILITY": "资格", "TIER": "层级", "DEADLINE": "截止日", "RESTRICTION": "限制"}
NOTHING = "当前没有符合条件的岗位。"


def answer_blocks(facts: DataFrame) -> DataFrame:
    """posting, block: the facts of each posting as one text that is always the same (X12). facts: posting, title, organisation, place, field, value, evidence (how many), current.

    Of a field the first fact counts; restrictions are kept in full, after the others. A fact that is not current adds a remark at the end.
    """
    limit = F.col("field") == "RESTRICTION"
    first = F.row_number().over(W.partitionBy("posting", "field").orderBy("place"))
    kept = facts.withColumn("_first", first).filter(limit | (F.col("_first") == 1))
    names = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    proof = F.when(F.col("evidence") > 0, F.format_string("［证据 %d 处］", "evidence")).otherwise("")
    line = F.concat(F.lit("\n   - "), F.get(F.array(names[F.col("field")]), F.lit(0)), F.lit("："), "value", proof)
    rows = F.array_sort(F.collect_list(F.struct(limit.alias("last"), "place", line.alias("line"))))
    blocks = kept.groupBy("posting", "title", "organisation").agg(rows.alias("rows"), F.bool_and(F.col("current") | limit).alias("current"))
    head = F.concat("title", F.when(F.coalesce(F.trim("organisation"), F.lit("")) != "", F.concat(F.lit("（"), "organisation", F.lit("）"))).otherwise(""))
    stale = F.when(~F.col("current"), "\n   - 注意：以上基于已过期的评估版本，需重新评估后才能作为当前结论。").otherwise("")
    return blocks.select("posting", F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), ""), stale).alias("block"))


_LIMITS = ("majors_text", "graduates_text", "wanted_text", "gender_text")
_LINE = lambda place, field, value, evidence="0": f"SELECT p_partkey, {place} AS place, '{field}' AS field, {value} AS value, {evidence} AS evidence FROM x WHERE {value} IS NOT NULL"


@query(f"""WITH {EVALUATED}, x AS (SELECT d.p_partkey, d.title, CASE WHEN d.organisation = 'PRIVATE_COMPANY' THEN '' ELSE d.organisation END AS org, status, tier, strftime(o.cutoff, '%Y-%m-%d') AS cut, {', '.join(f'o.{c}' for c in _LIMITS)}, d.p_partkey % 13 <> 0 AS fresh FROM d JOIN o USING (p_partkey) WHERE candidate = 1),
  l AS (SELECT p_partkey, string_agg(chr(10) || '   - ' || CASE field WHEN 'ELIGIBILITY' THEN '资格' WHEN 'TIER' THEN '层级' WHEN 'DEADLINE' THEN '截止日' ELSE '限制' END || '：' || value || CASE WHEN evidence > 0 THEN '［证据 ' || evidence || ' 处］' ELSE '' END, '' ORDER BY field = 'RESTRICTION', place) AS lines
    FROM ({_LINE(1, 'ELIGIBILITY', 'status', 'p_partkey % 3')} UNION ALL {_LINE(2, 'TIER', 'tier')} UNION ALL {_LINE(4, 'DEADLINE', 'cut')} {' '.join('UNION ALL ' + _LINE(5 + i, 'RESTRICTION', c, '1') for i, c in enumerate(_LIMITS))}) GROUP BY p_partkey)
  SELECT p_partkey AS posting, title || CASE WHEN org <> '' THEN '（' || org || '）' ELSE '' END || lines || CASE WHEN fresh THEN '' ELSE chr(10) || '   - 注意：以上基于已过期的评估版本，需重新评估后才能作为当前结论。' END AS block FROM x JOIN l USING (p_partkey)""")
def job_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What the tool for one posting says, for every posting and the first candidate."""
    own = postings(spark, sf).select("p_partkey", "cutoff", *_LIMITS)
    x = evaluated(spark, sf).filter("candidate = 1").join(own, "p_partkey")
    fact = lambda place, field, value, evidence: F.struct(F.lit(place).alias("place"), F.lit(field).alias("field"), value.alias("value"), evidence.cast("int").alias("evidence"))
    zero = F.lit(0)
    told = [fact(1, "ELIGIBILITY", F.col("status"), F.col("p_partkey") % 3), fact(2, "TIER", F.col("tier"), zero), fact(3, "TIER", F.lit("later"), F.lit(9)), fact(4, "DEADLINE", F.col("cutoff").cast("string"), zero), *(fact(5 + i, "RESTRICTION", F.col(c), F.lit(1)) for i, c in enumerate(_LIMITS))]
    organisation = F.when(F.col("organisation") != "PRIVATE_COMPANY", F.col("organisation")).otherwise("")
    facts = x.select(F.col("p_partkey").alias("posting"), "title", organisation.alias("organisation"), (F.col("p_partkey") % 13 != 0).alias("current"), F.explode(F.array(*told)).alias("f")).select("posting", "title", "organisation", "current", "f.*")
    return answer_blocks(facts.filter(F.col("value").isNotNull()))


@query("""WITH f AS (SELECT conv_id, role AS field, turn FROM conversations UNION ALL SELECT conv_id, 'long', turn FROM conversations WHERE length(text) > 300), g AS (SELECT conv_id, field, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns FROM f GROUP BY ALL) SELECT conv_id, string_agg(field || '=' || turns, ';' ORDER BY field) AS fields FROM g GROUP BY conv_id""")
def fragments_by_field(spark: SparkSession, sf: str) -> DataFrame:
    """Of each record a map from its fields to the fragments that bear them out, in order; a fragment may bear out several."""
    t = table(spark, sf, "conversations")
    fields = F.array_compact(F.array("role", F.when(F.length("text") > 300, "long")))
    each = t.select("conv_id", F.explode(fields).alias("field"), "turn").groupBy("conv_id", "field").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    maps = each.groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "turns")))).alias("map"))
    shown = F.transform(F.map_entries("map"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], lambda v: v.cast("string")), ",")))
    return maps.select("conv_id", F.array_join(shown, ";").alias("fields"))


def _folded(values: Column, start: int) -> Column:
    """31 times what came before, plus the next, in 32 bits."""
    return F.aggregate(values, F.lit(start).cast("long"), lambda a, x: (a * 31 + x) % (1 << 32))


def registry_print(registry: DataFrame, code: str) -> DataFrame:
    """One row, hash: of the distinct codes in order, as 32 bits in hex (X20). A registry is a catalogue of targets, some dozens."""
    one = _folded(F.transform(F.filter(F.split(code, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long")), 0)
    codes = registry.select(F.col(code).alias("code"), one.alias("n")).distinct()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("code", "n"))), lambda x: x["n"])
    return codes.agg(F.lower(F.hex(_folded(ordered, 1))).alias("hash"))


FROM, TO = 1995, 2001
_FOLD = "list_reduce({0}, lambda a, x: (a * 31 + x) % 4294967296, CAST({1} AS BIGINT))"
_CODE = _FOLD.format("list_transform(string_split(s, ''), lambda z: CAST(ord(z) AS BIGINT))", 0)
_CODES = _FOLD.format(f"list_transform(codes, lambda s: {_CODE})", 1)


@query(f"""WITH r AS (SELECT n_nationkey, n_name AS code, n_nationkey % 3 <> 1 AS chosen FROM nation), c AS (SELECT list(code ORDER BY code) AS codes FROM r),
  h AS (SELECT printf('%x', {_CODES}) AS hash FROM c),
  o AS (SELECT c_nationkey AS n_nationkey, year(o_orderdate) AS year, count(*) AS n, max(CAST(o_orderdate AS DATE)) AS through FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 4 <> 2 GROUP BY ALL)
  SELECT code, y.year, hash, CASE WHEN NOT chosen THEN 'NOT_SELECTED' WHEN o.n IS NULL THEN 'UNKNOWN' WHEN o.n >= 20 THEN 'COVERED' ELSE 'PARTIAL' END AS conclusion, CASE WHEN chosen THEN o.through END AS through FROM r CROSS JOIN h CROSS JOIN (SELECT unnest(range({FROM}, {TO + 1})) AS year) y LEFT JOIN o ON o.n_nationkey = r.n_nationkey AND o.year = y.year""")
def audit_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """An envelope of JSON for each selected target, with a conclusion for each year, under the registry's print; and read back beside the registry by code and year."""
    registry = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("code"), (F.col("n_nationkey") % 3 != 1).alias("chosen"))
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer").filter("c_nationkey % 4 <> 2"), F.col("o_custkey") == F.col("c_custkey"))
    seen = orders.groupBy(F.col("c_nationkey").alias("n_nationkey"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("o_orderdate").cast("date")).alias("through"))
    grid = registry.withColumn("year", F.explode(F.sequence(F.lit(FROM), F.lit(TO))))
    conclusion = F.when(F.col("n").isNull(), "UNKNOWN").when(F.col("n") >= 20, "COVERED").otherwise("PARTIAL")
    years = F.sort_array(F.collect_list(F.struct("year", conclusion.alias("conclusion"), "through")))
    hash_ = registry_print(registry, "code")
    filled = grid.filter("chosen").join(seen, ["n_nationkey", "year"], "left")
    envelopes = filled.groupBy("code").agg(years.alias("years")).crossJoin(F.broadcast(hash_))  # one row
    payloads = envelopes.select(F.to_json(F.struct("code", "hash", "years")).alias("payload"))
    read = payloads.select(F.from_json("payload", "code string, hash string, years array<struct<year: int, conclusion: string, through: date>>").alias("e")).select("e.code", F.explode("e.years").alias("y")).select("code", "y.*")
    out = grid.select("code", "year", "chosen").join(read, ["code", "year"], "left").crossJoin(F.broadcast(hash_))  # one row
    return out.select("code", F.col("year").cast("long").alias("year"), "hash", F.coalesce("conclusion", F.lit("NOT_SELECTED")).alias("conclusion"), "through")
