"""Queries on projections, predicates and joins (survey families P and J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import joins, scan
from tessera.plans.registry import query
from tessera.session import table


@query("""SELECT o.o_orderkey, CAST(o.o_orderdate AS DATE) AS order_date, coalesce(nullif(c.c_mktsegment, 'BUILDING'), 'unknown') AS segment,
  concat_ws('/', n.n_name, nullif(o.o_orderstatus, 'P'), o.o_orderpriority) AS path, (o.o_totalprice > 0 AND c.c_acctbal > 0 AND length(n.n_name) > 5) AS evidence_complete
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
  WHERE year(o.o_orderdate) BETWEEN 1996 AND 1998 AND o.o_orderstatus IN ('F', 'P') AND o.o_orderpriority NOT IN ('5-LOW')
  AND regexp_matches(lower(n.n_name), '^n.*[0-7]$') AND NOT regexp_matches(n.n_name, '3$')""")
def target_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Coalesce, casts, lists, patterns, a derived flag; filters reach the scans."""
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    o = o.filter(F.year("o_orderdate").between(1996, 1998) & F.col("o_orderstatus").isin("F", "P") & ~F.col("o_orderpriority").isin("5-LOW"))
    n = n.filter(F.col("n_name").rlike("(?i)^n.*[0-7]$") & ~F.col("n_name").rlike("3$"))
    joined = o.join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    complete = (F.col("o_totalprice") > 0) & (F.col("c_acctbal") > 0) & (F.length("n_name") > 5)
    segment = F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("unknown"))
    path = F.concat_ws("/", "n_name", F.nullif(F.col("o_orderstatus"), F.lit("P")), "o_orderpriority")
    return joined.select("o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"), segment.alias("segment"), path.alias("path"), complete.alias("evidence_complete"))


@query("""WITH m AS (SELECT c.c_custkey, o.o_orderkey, o.o_orderdate, row_number() OVER (PARTITION BY c.c_custkey ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS p
  FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey OR o.o_custkey = c.c_custkey + 1)
  SELECT c.c_custkey, m.o_orderkey, CAST(m.o_orderdate AS DATE) AS order_date FROM customer c LEFT JOIN m ON m.c_custkey = c.c_custkey AND m.p = 1""")
def lateral_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The latest match over two possible keys, without a nested loop."""
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") + 1).alias("other"))
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    c = c.withColumn("own", F.col("c_custkey"))
    found = joins.latest_match(c, o, [("own", "o_custkey"), ("other", "o_custkey")], "c_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return found.select("c_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("order_date"))


@query("""SELECT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c ON s.s_suppkey = c.c_custkey OR s.s_name = replace(c.c_name, 'Customer', 'Supplier')""")
def or_join_union(spark: SparkSession, sf: str) -> DataFrame:
    """OR of two equalities as a union of equi joins."""
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer").withColumn("as_supplier", F.replace(F.col("c_name"), F.lit("Customer"), F.lit("Supplier")))
    return joins.either_key(s, c, [("s_suppkey", "c_custkey"), ("s_name", "as_supplier")], ["s_suppkey", "c_custkey"]).select("s_suppkey", "c_custkey")


@query("""SELECT o.o_orderkey, max_by(l.l_partkey, (l.l_shipdate, l.l_partkey)) AS part, CAST(max(l.l_shipdate) AS DATE) AS shipped
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_returnflag <> 'R' GROUP BY o.o_orderkey""")
def latest_attachment(spark: SparkSession, sf: str) -> DataFrame:
    """Arg-max per key with an explicit tie-break, from the aggregate alone."""
    lines = table(spark, sf, "lineitem").filter("l_returnflag <> 'R'").select("l_orderkey", "l_partkey", "l_shipdate")
    joined = table(spark, sf, "orders").select("o_orderkey").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.max_by("l_partkey", F.struct("l_shipdate", "l_partkey")).alias("part"), F.max("l_shipdate").cast("date").alias("shipped"))


@query("SELECT o_orderkey, o_totalprice FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def semi_exists(spark: SparkSession, sf: str) -> DataFrame:
    """EXISTS as a left semi join."""
    returned = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.having(table(spark, sf, "orders"), returned, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def anti_absent(spark: SparkSession, sf: str) -> DataFrame:
    """What a listing no longer has."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.lacking(table(spark, sf, "orders"), lines, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("""WITH p AS (SELECT p_partkey, p_brand, replace(lower(p_name), ' ', '') AS stem FROM part)
  SELECT a.p_partkey AS left_key, b.p_partkey AS right_key FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
  WHERE a.stem = b.stem OR (least(length(a.stem), length(b.stem)) >= 6 AND least(length(a.stem), length(b.stem)) >= 0.75 * greatest(length(a.stem), length(b.stem))
  AND (CASE WHEN length(a.stem) <= length(b.stem) THEN contains(b.stem, a.stem) ELSE contains(a.stem, b.stem) END))""")
def fuzzy_stem_join(spark: SparkSession, sf: str) -> DataFrame:
    """Containment of stems inside an equality block."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.replace(F.lower("p_name"), F.lit(" "), F.lit("")).alias("stem"))
    a, b = p.select(F.col("p_partkey").alias("left_key"), "p_brand", F.col("stem").alias("a")), p.select(F.col("p_partkey").alias("right_key"), "p_brand", F.col("stem").alias("b"))
    return joins.similar_stems(a, b, ["p_brand"], "a", "b", least=6).filter("left_key < right_key").select("left_key", "right_key")


@query("""WITH m AS (SELECT p_partkey, ps.s_suppkey FROM part JOIN supplier ps ON ps.s_nationkey = p_partkey % 40 AND ps.s_acctbal > 6000)
  SELECT p.p_partkey, CASE count(DISTINCT m.s_suppkey) WHEN 0 THEN 'UNMATCHED' WHEN 1 THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS status,
  count(DISTINCT m.s_suppkey) AS targets, CASE WHEN count(DISTINCT m.s_suppkey) = 1 THEN min(m.s_suppkey) END AS s_suppkey
  FROM part p LEFT JOIN m USING (p_partkey) GROUP BY p.p_partkey""")
def match_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    """Resolved only if the match is unique."""
    # parts of a nation have the same matches, so these are counted once a nation
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 40).cast("int").alias("s_nationkey"))
    s = table(spark, sf, "supplier").filter("s_acctbal > 6000").select("s_suppkey", "s_nationkey")
    return joins.resolved(p, s, "s_nationkey", "s_suppkey").select("p_partkey", "status", "targets", "s_suppkey")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'NOT_COLLECTED' WHEN l.quality = 1 THEN 'CONFIRMED' ELSE 'CONFLICTING' END AS quality_state,
  CASE WHEN l.toxic = 1 THEN 'quality,toxic' WHEN l.doc_id IS NOT NULL THEN 'quality' ELSE '' END AS fields FROM documents d LEFT JOIN labels l USING (doc_id)""")
def field_evidence_left_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Facts with their evidence; missing is a state of its own."""
    l = table(spark, sf, "labels").withColumn("seen", F.lit(True))
    d = table(spark, sf, "documents").select("doc_id").join(l, "doc_id", "left")
    state = F.when(F.col("seen").isNull(), "NOT_COLLECTED").when(F.col("quality") == 1, "CONFIRMED").otherwise("CONFLICTING")
    fields = F.concat_ws(",", F.when(F.col("seen"), "quality"), F.when(F.col("toxic") == 1, "toxic"))
    return d.select("doc_id", state.alias("quality_state"), fields.alias("fields"))


@query("""SELECT s.s_suppkey, (SELECT count(*) FROM lineitem l WHERE l.l_suppkey = s.s_suppkey) AS n_lines,
  CASE WHEN EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_returnflag = 'R') AND (SELECT count(*) FROM lineitem l WHERE l.l_suppkey = s.s_suppkey) >= 600 THEN 'CONNECTED'
  WHEN EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_discount > 0.09) THEN 'PARTIAL' ELSE 'NOT_CONNECTED' END AS status FROM supplier s""")
def status_case_exists(spark: SparkSession, sf: str) -> DataFrame:
    """Correlated counts and EXISTS as one grouped pass."""
    l = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.bool_or(F.col("l_discount") > 0.09).alias("cut"))
    s = table(spark, sf, "supplier").join(l, F.col("l_suppkey") == F.col("s_suppkey"), "left").withColumn("n_lines", F.coalesce("n", F.lit(0)))
    status = F.when(F.coalesce("returned", F.lit(False)) & (F.col("n_lines") >= 600), "CONNECTED").when(F.coalesce("cut", F.lit(False)), "PARTIAL").otherwise("NOT_CONNECTED")
    return s.select("s_suppkey", "n_lines", status.alias("status"))


@query("""SELECT p.p_partkey, coalesce(nullif(b.p_type, 'ECONOMY'), p.p_type) AS p_type, coalesce(b.p_size, p.p_size) AS p_size
  FROM part p LEFT JOIN (SELECT p_partkey + 1 AS p_partkey, p_type, CASE WHEN p_size > 10 THEN p_size END AS p_size FROM part WHERE p_partkey % 3 = 0) b USING (p_partkey)""")
def overlay_preference(spark: SparkSession, sf: str) -> DataFrame:
    """What comes in wins unless it is null or not collected."""
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    new = p.filter("p_partkey % 3 = 0").select((F.col("p_partkey") + 1).alias("p_partkey"), F.nullif(F.col("p_type"), F.lit("ECONOMY")).alias("p_type"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size"))
    return joins.overlaid(p, new, "p_partkey", ["p_type", "p_size"])


@query("""SELECT a.p_partkey AS a_key, b.p_partkey AS b_key FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_type = b.p_type AND a.p_size = b.p_size
  AND ((CASE WHEN a.p_partkey % 3 = 0 THEN NULL ELSE a.p_brand END) IS NOT DISTINCT FROM (CASE WHEN b.p_partkey % 3 = 0 THEN NULL ELSE b.p_brand END))
  AND ((CASE WHEN a.p_partkey % 3 = 0 THEN NULL ELSE a.p_brand END) IS NOT NULL OR a.p_name = b.p_name)""")
def null_safe_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Equal codes, or no code on either side and equal names."""
    code = F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand"))
    # rows without a code meet by name from the start, not by having none
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_size", code.isNull().alias("bare"), F.coalesce(code, "p_name").alias("known"))
    keys = ["p_type", "p_size", "bare", "known"]
    pairs = joins.spread(p.withColumnRenamed("p_partkey", "a_key"), p.withColumnRenamed("p_partkey", "b_key"), keys)
    return pairs.filter("a_key < b_key").select("a_key", "b_key")


@query("""SELECT e.event_id, o.o_orderkey, s.s_suppkey FROM events e JOIN orders o ON o.o_orderkey = e.event_id LEFT JOIN supplier s ON s.s_suppkey = e.user_id AND s.s_acctbal > 0""")
def change_mixed_joins(spark: SparkSession, sf: str) -> DataFrame:
    """Inner where a record must exist, left where it may be missing."""
    e, o, s = table(spark, sf, "events"), table(spark, sf, "orders"), table(spark, sf, "supplier").filter("s_acctbal > 0")
    return e.join(o, F.col("o_orderkey") == F.col("event_id")).join(s, F.col("s_suppkey") == F.col("user_id"), "left").select("event_id", "o_orderkey", "s_suppkey")


@query("""WITH f AS (SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000)
  SELECT c.c_custkey, c.c_name, f.o_orderkey, f.o_orderpriority FROM f JOIN customer c ON c.c_custkey = f.o_custkey WHERE array_length([x FOR x IN ['1-URGENT', '2-HIGH'] IF x = f.o_orderpriority]) > 0""")
def queue_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Gate, list membership and array containment after a join."""
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F' and o_totalprice > 250000")
    o = o.withColumn("wanted", F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).filter(F.array_contains("wanted", F.col("o_orderpriority")))
    return o.join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "o_orderkey", "o_orderpriority")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS due, CASE WHEN o_orderpriority = '1-URGENT' THEN 'P0' WHEN o_orderpriority = '2-HIGH' THEN 'P1' ELSE 'P2' END AS priority
  FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-01-01' + 45 ORDER BY 3, 2, 1""")
def deadline_window(spark: SparkSession, sf: str) -> DataFrame:
    """Dates in a window ahead, by rank of priority."""
    today = F.lit("1998-01-01").cast("date")
    due = F.col("o_orderdate").cast("date")
    priority = F.when(F.col("o_orderpriority") == "1-URGENT", "P0").when(F.col("o_orderpriority") == "2-HIGH", "P1").otherwise("P2")
    return table(spark, sf, "orders").filter(due.between(today, F.date_add(today, 45))).select("o_orderkey", due.alias("due"), priority.alias("priority")).orderBy("priority", "due", "o_orderkey")


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 7 AND s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 5""")
def finder_limit(spark: SparkSession, sf: str) -> DataFrame:
    """By equality and condition, in order, limited."""
    return scan.finder(table(spark, sf, "supplier"), {"s_nationkey": 7}, [F.col("s_acctbal") > 0], [F.desc("s_acctbal"), F.col("s_suppkey")], 5).select("s_suppkey", "s_name")


@query("""SELECT p_partkey, 'size' AS broken FROM part WHERE NOT p_size BETWEEN 1 AND 45 UNION ALL SELECT p_partkey, 'price' FROM part WHERE NOT p_retailprice < 1900""")
def violated_checks(spark: SparkSession, sf: str) -> DataFrame:
    """R38 and table checks: violating rows, one for each check."""
    return scan.violations(table(spark, sf, "part"), {"size": F.col("p_size").between(1, 45), "price": F.col("p_retailprice") < 1900}).select("p_partkey", "broken")


@query("""WITH r AS (SELECT s_suppkey, s_suppkey * 7 % 50 AS low, s_suppkey * 7 % 50 + 2 AS high FROM supplier)
  SELECT p.p_partkey, r.s_suppkey FROM part p JOIN r ON p.p_size BETWEEN r.low AND r.high AND p.p_partkey % 25 = r.s_suppkey % 25""")
def range_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells inside ranges as an equality on stretches."""
    low = F.col("s_suppkey") * 7 % 50
    r = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 25).alias("g"), low.alias("low"), (low + 2).alias("high"))
    cells = table(spark, sf, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 25).alias("g"))
    return joins.in_ranges(cells, r, "p_size", "low", "high", ["g"], step=8).select("p_partkey", "s_suppkey")


@query("""SELECT r.r_name, count(DISTINCT s.s_suppkey) AS suppliers, sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned
  FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN supplier s ON s.s_nationkey = n.n_nationkey JOIN lineitem l ON l.l_suppkey = s.s_suppkey GROUP BY r.r_name""")
def dimension_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Facts aggregated by key before the dimensions join them."""
    l = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    s = table(spark, sf, "supplier").join(l, F.col("l_suppkey") == F.col("s_suppkey"))
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).groupBy("r_name").agg(F.countDistinct("s_suppkey").alias("suppliers"), F.sum("returned").alias("returned"))


@query("""SELECT n.n_nationkey, y.year, count(o.o_orderkey) AS n_orders FROM nation n CROSS JOIN (SELECT unnest(range(1995, 2002)) AS year) y
  LEFT JOIN (SELECT c_nationkey, o_orderkey, year(o_orderdate) AS yr FROM orders JOIN customer ON c_custkey = o_custkey) o ON o.c_nationkey = n.n_nationkey AND o.yr = y.year GROUP BY n.n_nationkey, y.year""")
def registry_years(spark: SparkSession, sf: str) -> DataFrame:
    """A registry expanded by years, with what was observed."""
    grid = table(spark, sf, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(1995).cast("long"), F.lit(2001).cast("long"))).alias("year"))
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    seen = o.groupBy(F.col("c_nationkey").alias("n_nationkey"), F.year("o_orderdate").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(seen, ["n_nationkey", "year"], "left").select("n_nationkey", "year", F.coalesce("n", F.lit(0)).alias("n_orders"))
