"""Queries on snapshots and state (survey families K, U, T)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import stable_key
from tessera.operators import merges
from tessera.plans.registry import query
from tessera.session import table

PRICE = "CASE WHEN p_partkey % 7 = 0 THEN p_retailprice + 10 ELSE p_retailprice END"


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the parts: some only in one, some with another price."""
    p = table(spark, sf, "part")
    price = F.when(F.col("p_partkey") % 7 == 0, F.col("p_retailprice") + 10).otherwise(F.col("p_retailprice"))
    return p.filter("p_partkey % 10 <> 0"), p.filter("p_partkey % 10 <> 1").withColumn("p_retailprice", price)


@query(f"""WITH b AS (SELECT p_partkey, p_retailprice AS x FROM part WHERE p_partkey % 10 <> 0), a AS (SELECT p_partkey, {PRICE} AS x FROM part WHERE p_partkey % 10 <> 1)
  SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'ADDED' WHEN a.p_partkey IS NULL THEN 'REMOVED' WHEN a.x = b.x THEN 'UNCHANGED' ELSE 'CHANGED' END AS status
  FROM b FULL JOIN a ON a.p_partkey = b.p_partkey""")
def snapshot_delta(spark: SparkSession, sf: str) -> DataFrame:
    """What changed between snapshots."""
    before, after = snapshots(spark, sf)
    return merges.snapshot_delta(before, after, "p_partkey", "p_retailprice")


@query(f"""WITH s AS (SELECT p_partkey, p_retailprice AS print, p_size AS first_seen, p_partkey % 13 <> 0 AS active, CASE WHEN p_partkey % 4 = 0 THEN 'VERIFIED' ELSE 'PARSED' END AS quality FROM part WHERE p_partkey % 10 <> 0),
  b AS (SELECT p_partkey, {PRICE} AS print FROM part WHERE p_partkey % 10 <> 1)
  SELECT coalesce(b.p_partkey, s.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL AND NOT s.active THEN 'KEEP' WHEN s.p_partkey IS NULL THEN 'INSERT' WHEN b.p_partkey IS NULL THEN 'DEACTIVATE' WHEN s.print = b.print AND s.active THEN 'UNCHANGED' ELSE 'UPDATE' END AS action,
  coalesce(b.print, s.print) AS print, coalesce(s.first_seen, 100) AS first_seen, CASE WHEN b.p_partkey IS NULL THEN s.first_seen ELSE 100 END AS seen,
  CASE WHEN b.p_partkey IS NULL THEN false ELSE true END AS active,
  CASE WHEN b.p_partkey IS NULL OR (s.print = b.print AND s.active) THEN s.quality ELSE 'RAW' END AS quality FROM s FULL JOIN b ON s.p_partkey = b.p_partkey""")
def upsert_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Upsert by key and print; absence deactivates, change resets quality."""
    before, after = snapshots(spark, sf)
    stored = before.select("p_partkey", F.col("p_retailprice").alias("print"), F.col("p_size").alias("first_seen"), F.col("p_size").alias("seen"), (F.col("p_partkey") % 13 != 0).alias("active"), F.when(F.col("p_partkey") % 4 == 0, "VERIFIED").otherwise("PARSED").alias("quality"))
    batch = after.select("p_partkey", F.col("p_retailprice").alias("print"), F.lit(100).alias("seen"))
    return merges.upserted(stored, batch, "p_partkey", "print")


@query("""SELECT doc_id, min(quality) OVER (PARTITION BY text) AS low, CASE WHEN min(quality) OVER (PARTITION BY text) <> max(quality) OVER (PARTITION BY text) THEN 'CONFLICT' ELSE 'CONFIRMED' END AS status
  FROM documents JOIN labels USING (doc_id)""")
def conflict_facts(spark: SparkSession, sf: str) -> DataFrame:
    """One text, different labels: all of its facts conflict."""
    facts = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.xxhash64("text").alias("entity"), "text", "quality", F.lit("CONFIRMED").alias("status"))
    from pyspark.sql import Window as W

    out = merges.conflicts(facts, ["entity", "text"], "quality")
    return out.select("doc_id", F.min("quality").over(W.partitionBy("entity", "text")).alias("low"), "status")


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY (p_partkey % 3 = 0) DESC, nullif(p_size % 5, 0) NULLS LAST, p_partkey) = 1 AS adopted FROM part""")
def alias_adoption(spark: SparkSession, sf: str) -> DataFrame:
    """Of rows with one identity, verified first, oldest first, one goes on."""
    p = table(spark, sf, "part").withColumn("verified", F.col("p_partkey") % 3 == 0).withColumn("since", F.nullif(F.col("p_size") % 5, F.lit(0)))
    return merges.adopted(p, ["p_brand", "p_type", "p_size"], "verified", "since", "p_partkey").select("p_partkey", "adopted")


@query("""WITH u AS (SELECT p_brand AS k, p_partkey AS v, p_size AS seen, 0 AS r FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_brand, -p_partkey, p_size + 1, 1 FROM part WHERE p_partkey % 2 = 1),
  t AS (SELECT k, seen, r, max(v) AS v FROM u GROUP BY k, seen, r), w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seen DESC, r DESC) AS p FROM t) SELECT k, v, seen FROM w WHERE p = 1""")
def latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The latest row of each key, the batch on a tie."""
    p = table(spark, sf, "part")
    old = p.filter("p_partkey % 2 = 0").groupBy(F.col("p_brand").alias("k"), F.col("p_size").alias("seen")).agg(F.max("p_partkey").alias("v"))
    new = p.filter("p_partkey % 2 = 1").groupBy(F.col("p_brand").alias("k"), (F.col("p_size") + 1).alias("seen")).agg(F.max(-F.col("p_partkey")).alias("v"))
    return merges.latest_wins(old, new, ["k"], "seen").select("k", "v", "seen")


@query("""SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang <> 'fr' GROUP BY ALL) WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'fr' AND n_chars > 4000)
  UNION ALL SELECT source, 'replaced', count(*) FROM documents WHERE lang = 'fr' AND n_chars > 4000 GROUP BY source""")
def replaced_facts(spark: SparkSession, sf: str) -> DataFrame:
    """A batch's facts in place of all with the same identity."""
    d = table(spark, sf, "documents")
    stored = d.filter("lang <> 'fr'").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    batch = d.filter("lang = 'fr' and n_chars > 4000").groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", F.lit("replaced").alias("lang"), "n")
    return merges.replaced(stored, batch, ["source"])


@query("""SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1""")
def content_addressed(spark: SparkSession, sf: str) -> DataFrame:
    """One artifact per content, whatever the number of copies."""
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("""WITH c AS (SELECT o_orderkey AS k, o_orderkey % 3 AS ver FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey + 10000000, 0 FROM orders WHERE o_orderkey % 11 = 0)
  SELECT c.k, CASE WHEN s.o_orderkey IS NULL THEN 'MISSING' WHEN s.o_orderkey % 4 = c.ver THEN 'APPLIED' ELSE 'STALE' END AS outcome FROM c LEFT JOIN orders s ON s.o_orderkey = c.k""")
def guarded_updates(spark: SparkSession, sf: str) -> DataFrame:
    """An update applies if the version that it saw is the stored one."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    stored = o.withColumn("ver", F.col("k") % 4)
    commands = o.filter("k % 5 = 0").withColumn("ver", F.col("k") % 3).unionByName(o.filter("k % 11 = 0").select((F.col("k") + 10000000).alias("k"), F.lit(0).cast("long").alias("ver")))
    return merges.guarded_update(stored, commands, "k", "ver").select("k", "outcome")


@query("""SELECT count(*) FILTER (k IS NOT NULL) AS known, count(*) FILTER (k IS NULL) AS computed FROM (SELECT p.p_partkey, m.p_partkey AS k FROM part p LEFT JOIN (SELECT p_partkey, p_retailprice FROM part WHERE p_partkey % 3 = 0) m
  ON m.p_partkey = p.p_partkey AND m.p_retailprice = CASE WHEN p.p_partkey % 7 = 0 THEN p.p_retailprice + 10 ELSE p.p_retailprice END)""")
def memoised_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Results are known by key and print; only the misses are computed."""
    before, after = snapshots(spark, sf)
    p = table(spark, sf, "part")
    wanted = p.withColumn("p_retailprice", F.when(F.col("p_partkey") % 7 == 0, F.col("p_retailprice") + 10).otherwise(F.col("p_retailprice"))).select("p_partkey", "p_retailprice")
    hits, misses = merges.memoised(wanted, p.filter("p_partkey % 3 = 0").select("p_partkey", "p_retailprice"), ["p_partkey", "p_retailprice"])
    return hits.agg(F.count(F.lit(1)).alias("known")).crossJoin(misses.agg(F.count(F.lit(1)).alias("computed")))


@query(f"""WITH b AS (SELECT p_partkey, p_retailprice AS x FROM part WHERE p_partkey % 10 <> 0), a AS (SELECT p_partkey, {PRICE} AS x, p_size > 5 AS act FROM part WHERE p_partkey % 10 <> 1)
  SELECT a.p_partkey, CASE WHEN NOT act THEN 'CLOSED' WHEN b.p_partkey IS NULL THEN 'BASELINE_MISSING' WHEN a.x <> b.x THEN 'CHANGED' ELSE 'SAME' END AS watch FROM a LEFT JOIN b USING (p_partkey)""")
def watch_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What became of watched records."""
    before, after = snapshots(spark, sf)
    return merges.watched(after.select("p_partkey", "p_retailprice", "p_size"), before, "p_partkey", "p_retailprice", F.col("p_size") > 5).select("p_partkey", "watch")


@query("""SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY conv_id, role""")
def inserted_once(spark: SparkSession, sf: str) -> DataFrame:
    """Inserts that are there already do nothing."""
    c = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"))
    return merges.inserted(c.filter("conv_id % 2 = 0"), c, ["conv_id", "role"])


@query("""SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (year(o_orderdate) < 1998)), ',') AS before, array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (year(o_orderdate) >= 1998)), ',') AS after,
  len(list_intersect(list(DISTINCT o_orderpriority) FILTER (year(o_orderdate) < 1998), list(DISTINCT o_orderpriority) FILTER (year(o_orderdate) >= 1998))) AS common FROM orders GROUP BY o_custkey
  HAVING count(*) FILTER (year(o_orderdate) < 1998) > 0 AND count(*) FILTER (year(o_orderdate) >= 1998) > 0""")
def year_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Sets before and after, and what they share."""
    y = F.year("o_orderdate")
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(y < 1998, F.col("o_orderpriority"))).alias("b"), F.collect_set(F.when(y >= 1998, F.col("o_orderpriority"))).alias("a"))
    return g.filter("size(a) > 0 and size(b) > 0").select("o_custkey", F.array_join(F.array_sort("b"), ",").alias("before"), F.array_join(F.array_sort("a"), ",").alias("after"), F.size(F.array_intersect("a", "b")).cast("long").alias("common"))


@query("""SELECT p_partkey, sha256(concat_ws('|', p_brand, p_type, p_name)) AS key FROM part""")
def stable_keys(spark: SparkSession, sf: str) -> DataFrame:
    """the identity of a record."""
    return table(spark, sf, "part").select("p_partkey", stable_key(F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("key"))
