"""The registered queries over the driver's tables, each beside the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.payload import payload_number, payload_text
from ..operators.joins import asof_join, range_join
from ..operators.validate import accepted, judge_lines, rejected
from ..schema import from_driver_events
from ..sources.scratch import scratch
from ..streaming.ingest import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) under its own name."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def views(spark: SparkSession, sf_dir: str, *names: str) -> SparkSession:
    """A session of its own with the tables as views, for queries that are SQL."""
    own = spark.newSession()
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    for n in names:
        table(own, sf_dir, n).createOrReplaceTempView(n)
    return own


def money(column: str):
    """A sum that doesn't depend on the order of its terms."""
    return F.sum(F.col(column).cast("decimal(18,4)")).cast("double")


MONEY = "CAST(sum(CAST({} AS DECIMAL(18,4))) AS DOUBLE)"

# ---- scans, filters, counts


@query("SELECT event_id, user_id, event_type, props FROM events WHERE event_id = 42")
def point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_id = 42").select("event_id", "user_id", "event_type", "props")


@query("SELECT event_type AS event_name, count(*) AS cnt FROM events GROUP BY event_type")
def count_by_type(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("event_name")).agg(F.count("*").alias("cnt"))


@query("SELECT user_id, count(*) AS cnt FROM events GROUP BY user_id ORDER BY cnt DESC, user_id LIMIT 100")
def topn_users(spark, sf_dir):
    """The 100 most active users; the user id breaks ties."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "user_id").limit(100)


@query("SELECT event_id, event_type FROM events")
def project_columns(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type")


@query("SELECT event_id, user_id, value FROM events WHERE event_type IN ('click', 'view') AND value BETWEEN 10 AND 50 AND user_id IS NOT NULL AND event_type LIKE 'c%'")
def row_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type IN ('click', 'view') AND value BETWEEN 10 AND 50 AND user_id IS NOT NULL AND event_type LIKE 'c%'").select("event_id", "user_id", "value")


@query("SELECT count(*) AS n FROM events")
def global_count(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"))


@query("SELECT CAST(42 AS INTEGER) AS val, 'x' AS txt")
def constant_params(spark, sf_dir):
    return spark.sql("SELECT CAST(:a AS INT) AS val, :b AS txt", args={"a": 42, "b": "x"})


# ---- validation of the events under the contract


def _lines(spark, sf_dir):
    """The events table as JSON lines."""
    e = from_driver_events(table(spark, sf_dir, "events"))
    body = F.to_json(F.struct("event_id", "user_id", "event_name", F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("event_ts"), F.lit(0).alias("_")))
    return e.select("event_id", F.concat(F.regexp_replace(body, ',"_":0\\}$', ',"payload":'), F.coalesce("payload", F.lit("null")), F.lit("}")).alias("raw"))


@query("SELECT event_id, user_id, event_type AS event_name, ts AS event_ts, CAST(json(props) AS VARCHAR) AS payload FROM events WHERE event_id > 0")
def validate_accepted(spark, sf_dir):
    """Every event goes through the validator as JSON; an accepted payload is canonical JSON, without spaces."""
    return accepted(judge_lines(_lines(spark, sf_dir))).withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))


@query("SELECT 'validation' AS reason, 'greater_than' AS kind, count(*) AS n FROM events WHERE event_id <= 0 GROUP BY ALL")
def validate_reject_reasons(spark, sf_dir):
    bad = rejected(judge_lines(_lines(spark, sf_dir)))
    return bad.select("reason", F.get("errors", F.lit(0))["type"].alias("kind")).groupBy("reason", "kind").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k_text, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_number FROM events")
def payload_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", payload_text("k", "props").alias("k_text"), payload_number("k", "props").alias("k_number"))


# ---- joins


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join_inner(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c.where("c_mktsegment = 'BUILDING'"), o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT o_orderkey, count(l_linenumber) AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def join_left(spark, sf_dir):
    """Lines are counted before they are joined, so only one row an order is shuffled."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("l_linenumber").alias("n"))
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.join(n, o.o_orderkey == n.l_orderkey, "left").select("o_orderkey", F.coalesce("n", F.lit(0).cast("long")).alias("n_lines"))


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 50")
def join_full(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.join(s, c.c_custkey == s.s_suppkey + 50, "full").select("c_custkey", "s_suppkey")


@query("SELECT c_custkey, s_suppkey FROM customer RIGHT JOIN supplier ON c_custkey = s_suppkey * 100")
def join_right(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.join(s, c.c_custkey == s.s_suppkey * 100, "right").select("c_custkey", "s_suppkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join_semi(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark, sf_dir):
    o, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(n, o.o_orderkey == n.l_orderkey, "left_anti").select("o_orderkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross_small(spark, sf_dir):
    return table(spark, sf_dir, "region").crossJoin(table(spark, sf_dir, "nation")).select("r_name", "n_name")


@query("SELECT p_partkey, q.band FROM part JOIN (VALUES (0, 900.0, 940.0), (1, 930.0, 975.0), (2, 975.0, 1100.0)) q(band, lo, hi) ON p_retailprice >= q.lo AND p_retailprice < q.hi")
def join_range(spark, sf_dir):
    bands = spark.createDataFrame([(0, 900.0, 940.0), (1, 930.0, 975.0), (2, 975.0, 1100.0)], "band int, lo double, hi double")
    return range_join(table(spark, sf_dir, "part"), bands, "p_retailprice", "lo", "hi", 50.0).select("p_partkey", "band")


@query("SELECT p.event_id AS event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON p.user_id = v.user_id AND p.ts >= v.ts")
def join_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    views_ = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"))
    return asof_join(e.where("event_type = 'purchase'").select("user_id", "event_id", "ts"), views_, ["user_id"], "ts", "view_ts", ["view_id"]).select("event_id", "view_id")


@query("SELECT c.c_custkey, t.o_orderkey FROM customer c JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t ON true")
def join_lateral(spark, sf_dir):
    """Orders are ranked within their customer before the join: Spark numbers the rows of a correlated ORDER BY ... LIMIT in
    whatever order its shuffle delivers them."""
    ranked = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST) AS place FROM orders"
    return views(spark, sf_dir, "customer", "orders").sql(f"SELECT c.c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM ({ranked}) WHERE place = 1 AND o_custkey = c.c_custkey) t")


# ---- aggregates


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, {MONEY.format('l_quantity')} AS qty, {MONEY.format('l_extendedprice')} AS price, min(l_discount) AS low, max(l_discount) AS high, round(avg(l_quantity), 6) AS mean FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def agg_basic(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), money("l_quantity").alias("qty"), money("l_extendedprice").alias("price"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def agg_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) AS n FROM events GROUP BY user_id")
def agg_filter(spark, sf_dir):
    return views(spark, sf_dir, "events").sql("SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) AS n FROM events GROUP BY user_id")


_SETS = "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) + 2 * grouping(l_linestatus) AS BIGINT) AS level, count(*) AS n FROM lineitem GROUP BY {}"


@query(_SETS.format("ROLLUP (l_returnflag, l_linestatus)"))
def agg_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg((F.grouping("l_returnflag") + 2 * F.grouping("l_linestatus")).cast("long").alias("level"), F.count("*").alias("n"))


@query(_SETS.format("CUBE (l_returnflag, l_linestatus)"))
def agg_cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg((F.grouping("l_returnflag") + 2 * F.grouping("l_linestatus")).cast("long").alias("level"), F.count("*").alias("n"))


@query(_SETS.format("GROUPING SETS ((l_returnflag), (l_linestatus), ())"))
def agg_grouping_sets(spark, sf_dir):
    return views(spark, sf_dir, "lineitem").sql(_SETS.format("GROUPING SETS ((l_returnflag), (l_linestatus), ())"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15")
def agg_having(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 15")


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, arg_max(event_id, ts + to_microseconds(event_id)) AS last_id FROM events GROUP BY user_id")
def agg_collect(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"), F.max_by("event_id", F.struct(F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") / 1_000_000).cast("decimal(18,6)")))).alias("last_id"))


@query("SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS var, round(corr(l_quantity, l_discount), 6) AS c, median(l_quantity) AS med, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag")
def agg_statistics(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.var_pop("l_quantity"), 6).alias("var"), F.round(F.corr("l_quantity", "l_discount"), 6).alias("c"), F.median("l_quantity").alias("med"), F.percentile("l_quantity", F.lit(0.9)).alias("p90"))


@query()
def agg_approximate(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5).alias("median"))


# ---- windows


@query("SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
def win_rank(spark, sf_dir):
    w, v = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(v).cast("long").alias("rk"), F.dense_rank().over(v).cast("long").alias("dr"))


@query("SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after, first_value(event_id) OVER w AS head, nth_value(event_id, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_lag_lead(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id", 2).over(w).alias("after"), F.first("event_id").over(w).alias("head"), F.nth_value("event_id", 2).over(whole).alias("second"))


@query("SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total FROM events")
def win_running_sum(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.sum(F.col("value").cast("decimal(18,4)")).over(w).cast("double").alias("total"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_events FROM events")
def win_range_frame(spark, sf_dir):
    return views(spark, sf_dir, "events").sql("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_events FROM events")


@query("SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS quarter FROM customer")
def win_ntile(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.ntile(4).over(Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")).cast("long").alias("quarter"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def win_qualify(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w)).where("k = 1").select("o_custkey", "o_orderkey")


# ---- sorts, sets, subqueries


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def sort_limit_offset(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20).select("o_orderkey", "o_totalprice")


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()


def _keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))


def _set(word):
    return f"SELECT c_nationkey AS k FROM customer {word} SELECT s_nationkey AS k FROM supplier"


@query(_set("UNION ALL"))
def set_union_all(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.unionByName(b)


@query(_set("UNION"))
def set_union(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.unionByName(b).distinct()


@query(_set("INTERSECT"))
def set_intersect(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.intersect(b)


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey AS k FROM supplier")
def set_except(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")))


@query(_set("EXCEPT ALL"))
def set_except_all(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.exceptAll(b)


@query(_set("INTERSECT ALL"))
def set_intersect_all(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.intersectAll(b)


_CHAIN = f"WITH big AS (SELECT o_custkey, {MONEY.format('o_totalprice')} AS total FROM orders GROUP BY o_custkey), top AS (SELECT o_custkey, total FROM big WHERE total > 100000) SELECT c_nationkey, count(*) AS n FROM top JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey"


@query(_CHAIN)
def cte_chain(spark, sf_dir):
    return views(spark, sf_dir, "orders", "customer").sql(_CHAIN)


@query("WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t")
def cte_recursive(spark, sf_dir):
    return spark.sql("WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t")


_EXISTS = "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_discount > 0.09)"


@query(_EXISTS)
def subq_exists(spark, sf_dir):
    return views(spark, sf_dir, "supplier", "lineitem").sql(_EXISTS)


_SCALAR = "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * max(i.o_totalprice) / 2 FROM orders i WHERE i.o_custkey = o.o_custkey)"


@query(_SCALAR)
def subq_scalar_correlated(spark, sf_dir):
    return views(spark, sf_dir, "orders").sql(_SCALAR)


# ---- functions


@query("SELECT p_partkey, upper(p_name) AS up, substr(p_brand, 1, 5) AS head, CAST(length(p_type) AS BIGINT) AS n, replace(p_type, ' ', '_') AS under, CAST(strpos(p_name, 'a') AS BIGINT) AS at, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, regexp_replace(p_brand, '[0-9]', '#', 'g') AS masked, concat_ws('-', p_brand, p_type) AS joined FROM part")
def fn_string(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.upper("p_name").alias("up"), F.substring("p_brand", 1, 5).alias("head"), F.length("p_type").cast("long").alias("n"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("under"), F.instr("p_name", "a").cast("long").alias("at"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.regexp_replace("p_brand", "[0-9]", "#").alias("masked"), F.concat_ws("-", "p_brand", "p_type").alias("joined"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(extract(dow FROM o_orderdate) + 1 AS BIGINT) AS dow, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS start, CAST(datediff('day', o_orderdate, TIMESTAMP '2000-01-01') AS BIGINT) AS days, strftime(o_orderdate, '%Y-%m-%d') AS txt FROM orders")
def fn_date(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(d).cast("long").alias("y"), F.month(d).cast("long").alias("m"), F.dayofweek(d).cast("long").alias("dow"), F.date_trunc("month", d).cast("timestamp_ntz").alias("start"), F.datediff(F.lit("2000-01-01").cast("date"), d.cast("date")).cast("long").alias("days"), F.date_format(d, "yyyy-MM-dd").alias("txt"))


@query("SELECT p_partkey, round(p_retailprice, 1) AS r, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, abs(p_size - 25) AS a, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, round(pow(p_size, 2), 3) AS p, p_size % 7 AS m, p_retailprice / nullif(p_size - 10, 0) AS q FROM part")
def fn_math(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "round(p_retailprice, 1) AS r", "CAST(floor(p_retailprice) AS BIGINT) AS f", "CAST(ceil(p_retailprice) AS BIGINT) AS c", "abs(p_size - 25) AS a", "round(sqrt(p_retailprice), 6) AS s", "round(ln(p_retailprice), 6) AS l", "round(pow(p_size, 2), 3) AS p", "p_size % 7 AS m", "p_retailprice / nullif(p_size - 10, 0) AS q")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS band, CAST(c_custkey AS VARCHAR) AS txt, TRY_CAST(c_name AS INTEGER) AS bad, coalesce(nullif(c_mktsegment, 'BUILDING'), '-') AS seg FROM customer")
def fn_case_cast(spark, sf_dir):
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(b < 0, "debt").when(b < 1000, "low").otherwise("high").alias("band"), F.col("c_custkey").cast("string").alias("txt"), F.col("c_name").try_cast("int").alias("bad"), F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("-")).alias("seg"))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, CAST(embedding[1] AS DOUBLE) AS head, CAST(list_max(embedding) AS DOUBLE) AS top, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive FROM embeddings")
def fn_array(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(e).cast("long").alias("n"), F.element_at(e, 1).cast("double").alias("head"), F.array_max(e).cast("double").alias("top"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"))


@query("SELECT vec_id, CAST(i AS BIGINT) AS i, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def fn_unnest(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding")).select("vec_id", (F.col("pos") + 1).cast("long").alias("i"), F.col("col").cast("double").alias("x"))


@query("SELECT r_regionkey, map_extract_value(m, 'name') AS name, s.k AS k FROM (SELECT r_regionkey, MAP {'name': r_name, 'x': 'y'} AS m, {'k': r_regionkey + 1} AS s FROM region)")
def fn_map_struct(spark, sf_dir):
    r = table(spark, sf_dir, "region").select("r_regionkey", F.create_map(F.lit("name"), "r_name", F.lit("x"), F.lit("y")).alias("m"), F.struct((F.col("r_regionkey") + 1).alias("k")).alias("s"))
    return r.select("r_regionkey", F.col("m")["name"].alias("name"), F.col("s.k").alias("k"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS none, json_keys(props)[1] AS first_key FROM events")
def fn_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.none").alias("none"), F.element_at(F.json_object_keys("props"), 1).alias("first_key"))



@query("SELECT p_partkey, string_split(p_type, ' ')[1] AS head, CAST(len(string_split(p_type, ' ')) AS BIGINT) AS words, regexp_extract(p_brand, '([A-Za-z]+)#?([0-9]*)', 1) AS name, CAST(levenshtein(p_type, p_brand) AS BIGINT) AS apart, trim('  ' || p_type || ' ') AS trimmed, ltrim('xx' || p_brand, 'x') AS cut, reverse(p_brand) AS turned, starts_with(p_type, 'S') AS s, contains(p_name, 'a') AS a, lower(p_type) AS low, rpad(p_brand, 12, '.') AS padded, repeat('ab', 2) AS twice, CAST(ascii(p_type) AS BIGINT) AS code FROM part")
def fn_string_more(spark, sf_dir):
    t, b = F.col("p_type"), F.col("p_brand")
    words = F.split(t, " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey", words[0].alias("head"), F.size(words).cast("long").alias("words"), F.regexp_extract(b, "([A-Za-z]+)#?([0-9]*)", 1).alias("name"), F.levenshtein(t, b).cast("long").alias("apart"), F.trim(F.concat(F.lit("  "), t, F.lit(" "))).alias("trimmed"), F.ltrim(F.concat(F.lit("xx"), b), F.lit("x")).alias("cut"),
        F.reverse(b).alias("turned"), t.startswith("S").alias("s"), F.col("p_name").contains("a").alias("a"), F.lower(t).alias("low"), F.rpad(b, 12, ".").alias("padded"), F.repeat(F.lit("ab"), 2).alias("twice"), F.ascii(t).cast("long").alias("code"),
    )


@query("SELECT p_partkey, round(log10(p_retailprice), 9) AS l10, round(ln(p_size) / ln(2), 9) AS l2, round(exp(p_size / 50.0), 9) AS e, sign(p_size - 25) AS s, CAST(CASE WHEN p_retailprice < 900 THEN 0 WHEN p_retailprice >= 1000 THEN 11 ELSE floor((p_retailprice - 900) / 10) + 1 END AS BIGINT) AS bucket, greatest(p_size, 20) AS hi, least(p_size, 20) AS lo, round(atan2(p_size, 10), 9) AS angle, CAST(p_size & 7 AS BIGINT) AS bits, CAST(p_size // 7 AS BIGINT) AS whole FROM part")
def fn_math_more(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "round(log10(p_retailprice), 9) AS l10", "round(log(2, p_size), 9) AS l2", "round(exp(p_size / 50.0D), 9) AS e", "sign(p_size - 25) AS s", "width_bucket(p_retailprice, 900, 1000, 10) AS bucket", "greatest(p_size, 20) AS hi", "least(p_size, 20) AS lo", "round(atan2(p_size, 10), 9) AS angle", "CAST(p_size & 7 AS BIGINT) AS bits", "p_size div 7 AS whole")


@query("SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH + INTERVAL 3 DAY AS TIMESTAMP) AS later, CAST(last_day(o_orderdate) AS DATE) AS month_end, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(dayofyear(o_orderdate) AS BIGINT) AS doy, make_date(year(o_orderdate), 1, 1) AS first, CAST(epoch(o_orderdate) AS BIGINT) AS secs FROM orders")
def fn_date_more(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderdate + make_interval(0, 1, 0, 3) AS later", "last_day(o_orderdate) AS month_end", "CAST(quarter(o_orderdate) AS BIGINT) AS q", "CAST(dayofyear(o_orderdate) AS BIGINT) AS doy", "make_date(year(o_orderdate), 1, 1) AS first", "unix_timestamp(o_orderdate) AS secs")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2)), 4) AS twice, round(list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda a, b: greatest(a, b)), 6) AS top, CAST(len(list_distinct([label, label, label + 1])) AS BIGINT) AS n, list_contains([1, 2, 3], label) AS few, array_to_string(list_sort([label, 3, 1]), ',') AS joined, CAST(len(embedding[2:5]) AS BIGINT) AS part, CAST(len(flatten([[1, 2], [label]])) AS BIGINT) AS flat FROM embeddings")
def fn_array_more(spark, sf_dir):
    e, l = F.transform("embedding", lambda x: x.cast("double")), F.col("label")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(F.aggregate(F.transform(e, lambda x: x * 2), F.lit(0.0), lambda a, x: a + x), 4).alias("twice"), F.round(F.reduce(e, F.lit(float("-inf")), lambda a, x: F.greatest(a, x)), 6).alias("top"), F.size(F.array_distinct(F.array(l, l, l + 1))).cast("long").alias("n"), F.array_contains(F.array(F.lit(1), F.lit(2), F.lit(3)), l).alias("few"),
        F.array_join(F.sort_array(F.array(l, F.lit(3), F.lit(1))).cast("array<string>"), ",").alias("joined"), F.size(F.slice("embedding", 2, 4)).cast("long").alias("part"), F.size(F.flatten(F.array(F.array(F.lit(1), F.lit(2)), F.array(l)))).cast("long").alias("flat"),
    )


@query("SELECT n_nationkey, map_extract_value(m, 'name') AS name, CAST(cardinality(m) AS BIGINT) AS n, array_to_string(list_sort(map_keys(m)), ',') AS keys, map_contains(m, 'key') AS has FROM (SELECT n_nationkey, map_from_entries([{'k': 'name', 'v': n_name}, {'k': 'key', 'v': CAST(n_nationkey AS VARCHAR)}]) AS m FROM nation)")
def fn_map_more(spark, sf_dir):
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    m = table(spark, sf_dir, "nation").select("n_nationkey", F.map_from_entries(F.array(entry("name", F.col("n_name")), entry("key", F.col("n_nationkey").cast("string")))).alias("m"))
    return m.select("n_nationkey", F.col("m")["name"].alias("name"), F.size("m").cast("long").alias("n"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), F.map_contains_key("m", "key").alias("has"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"id\":' || event_id || ',\"tags\":[\"' || event_type || '\"]}' AS made FROM events")
def fn_json_typed(spark, sf_dir):
    """from_json by a schema, to_json of a struct."""
    made = F.to_json(F.struct(F.col("event_id").alias("id"), F.array("event_type").alias("tags")))
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k BIGINT").k.alias("k"), made.alias("made"))


@query("SELECT o_orderkey FROM orders WHERE regexp_matches(o_orderpriority, '^[0-9]-(HIGH|URGENT)') OR o_orderstatus IS NOT DISTINCT FROM nullif(o_orderpriority, o_orderpriority) OR o_orderpriority LIKE '5%' AND o_orderstatus IN ('F', 'P')")
def filter_patterns(spark, sf_dir):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").where(p.rlike("^[0-9]-(HIGH|URGENT)") | s.eqNullSafe(F.nullif(p, p)) | (p.like("5%") & s.isin("F", "P"))).select("o_orderkey")


_SPREAD = "SELECT o_orderkey, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS tile, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_key, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice)"


@query(_SPREAD)
def win_distribution(spark, sf_dir):
    return views(spark, sf_dir, "orders").sql(_SPREAD)


@query()
def sample_table(spark, sf_dir):
    """TABLESAMPLE, repeatable."""
    return views(spark, sf_dir, "events").sql("SELECT event_id FROM events TABLESAMPLE (20 PERCENT) REPEATABLE (3)")


@query("SELECT column_name AS col_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' END AS data_type FROM (DESCRIBE customer)")
def describe_table(spark, sf_dir):
    return views(spark, sf_dir, "customer").sql("DESCRIBE TABLE customer").select("col_name", "data_type")


@query()
def explain_query(spark, sf_dir):
    """The plan of a query as rows; nothing is run."""
    return views(spark, sf_dir, "events").sql("EXPLAIN FORMATTED SELECT event_type, count(*) FROM events WHERE event_id = 42 GROUP BY event_type")


# ---- reshaping, time windows


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id")
def pivot_types(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type IN ('click', 'view')")
    return e.groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.count("event_id")).na.fill(0)


@query("SELECT p_partkey, 'size' AS what, CAST(p_size AS DOUBLE) AS x FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def unpivot_part(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "what", "x")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS cnt FROM events GROUP BY ALL")
def tumbling_window_batch(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("cnt")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "cnt")


@query("WITH m AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS session_start, count(*) AS cnt FROM s GROUP BY user_id, k")
def session_window_batch(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("cnt")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "cnt")


@query()
def sample_rows(spark, sf_dir):
    """A sampling operator: a tenth of the rows, the same ones at each call."""
    return table(spark, sf_dir, "events").sample(0.1, seed=7)


# ---- the table's life

_ALL = "SELECT event_id, user_id, event_type AS event_name, ts AS event_ts, props AS payload FROM events"


def _new_table(spark):
    from ..table.log import SnapshotLog

    return SnapshotLog(spark, scratch(spark, "table")).open()


def _shown(df):
    return df.withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))


@query(_ALL)
def roundtrip_ingest(spark, sf_dir):
    """The events written to a new table and read back."""
    from ..query import scan
    from ..table.writer import append_frame

    log = _new_table(spark)
    append_frame(log, from_driver_events(table(spark, sf_dir, "events")), "all")
    return _shown(scan(spark, log))


def _in_parts(spark, sf_dir, parts: int = 4):
    from ..table.writer import append_frame

    log, e = _new_table(spark), from_driver_events(table(spark, sf_dir, "events"))
    done = [append_frame(log, e.where(F.pmod("event_id", F.lit(parts)) == k), f"part-{k}") for k in range(parts)]
    return log, done


@query(_ALL)
def roundtrip_compacted(spark, sf_dir):
    """The events written in four commits, compacted, and read back."""
    from ..config import Buffer, Compaction, Runtime
    from ..operators.lease import Leases
    from ..query import scan
    from ..table.compact import Compactor

    log, _ = _in_parts(spark, sf_dir)
    compactor = Compactor(log, Compaction(min_input_files=2), Buffer(), Leases(Runtime()))
    compactor.run(compactor.plan())
    return _shown(scan(spark, log))


@query(f"{_ALL} WHERE event_id % 4 = 0")
def time_travel_first_snapshot(spark, sf_dir):
    """The first of four snapshots, read after the fourth."""
    from ..query import scan

    log, done = _in_parts(spark, sf_dir)
    return _shown(scan(spark, log, done[0].snapshot_id))


@query("SELECT count(*) AS n, true AS replayed FROM events")
def replay_is_noop(spark, sf_dir):
    """A flush id that is committed twice adds its rows once."""
    from ..query import scan
    from ..table.writer import append_frame

    log, e = _new_table(spark), from_driver_events(table(spark, sf_dir, "events"))
    append_frame(log, e, "once")
    again = append_frame(log, e, "once")
    return scan(spark, log).agg(F.count("*").alias("n")).withColumn("replayed", F.lit(again.replayed))


@query("SELECT event_type AS event_name, count(*) AS cnt FROM events WHERE event_id > 0 GROUP BY event_type")
def stream_ingest(spark, sf_dir):
    """The events as NDJSON files through the streaming ingest, then counted."""
    from ..config import Settings
    from ..query import scan
    from ..streaming.ingest import start

    log, folder = _new_table(spark), scratch(spark, "stream")
    _lines(spark, sf_dir).select("raw").write.text(f"{folder}/in")
    settings = Settings.load(environ={}, ingestion={"dlq_dir": f"{folder}/dlq"})
    start(spark, log, settings, f"{folder}/in", f"{folder}/checkpoint", "events", available_now=True).awaitTermination()
    return scan(spark, log).groupBy("event_name").agg(F.count("*").alias("cnt"))


#: How late an event may be in stream_late_data, in days, and the hours of its windows.
LATE, HOURS = 10, 24


@query(f"""
WITH e AS (SELECT CAST(ts AS TIMESTAMP) AS ts, event_id % 2 = 0 AS early, event_id % 4 = 0 AS first, time_bucket(INTERVAL {HOURS} HOUR, ts, TIMESTAMP '1970-01-01') AS w FROM events),
m AS (SELECT max(ts) FILTER (first) - INTERVAL {LATE} DAY AS first_mark, max(ts) - INTERVAL {LATE} DAY AS last_mark FROM e)
SELECT w AS window_start, count(*) AS cnt FROM e, m WHERE (early OR w + INTERVAL {HOURS} HOUR > first_mark) AND w + INTERVAL {HOURS} HOUR <= last_mark GROUP BY w
""")
def stream_late_data(spark, sf_dir):
    """Windows over a stream whose third file comes late: what is behind the first one's watermark is dropped (Spark
    drops by the mark of the batch before the last), and a window is told once the watermark has passed it."""
    import time

    folder = scratch(spark, "late")
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.lit("x").alias("event_name"), "event_id")
    for k, some in enumerate(("event_id % 4 = 0", "event_id % 4 = 2", "event_id % 2 <> 0")):
        e.where(some).coalesce(1).write.parquet(f"{folder}/in/part={k}")
        time.sleep(1.1)  # files are taken in the order of their times
    read = spark.readStream.schema("ts timestamp, event_name string, event_id long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/part=*")
    told = windowed_counts(read.withColumnRenamed("ts", "event_ts"), f"{HOURS} hours", late=f"{LATE} days")
    writer = told.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "cnt")
