"""Integrity queries over the supplied tables, with their oracles. Where the tables hold no violation, a rule injects some in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.operators import integrity as I

QUERIES, SQL = {}, {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("SELECT l_orderkey, l_linenumber, count(*) - 1 AS surplus FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys(spark, sf_dir):
    return I.duplicate_keys(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query("SELECT sha256(text) AS text_sha256, count(*) - 1 AS surplus FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dup_texts(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))
    return I.duplicate_keys(d, ["text_sha256"])


@_query(
    "SELECT * FROM (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS n_distinct, min(l_linenumber)::BIGINT AS low, max(l_linenumber)::BIGINT AS high FROM lineitem GROUP BY 1) WHERE n <> n_distinct OR low <> 1 OR high <> n"
)
def sequence_gaps(spark, sf_dir):
    return I.sequence_gaps(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@_query(
    "SELECT * FROM (SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS n_distinct, min(turn) AS low, max(turn) AS high FROM conversations WHERE conv_id % 7 <> 3 OR turn <> 1 GROUP BY 1) WHERE n <> n_distinct OR low <> 0 OR high <> n - 1"
)
def turn_gaps(spark, sf_dir):
    return I.sequence_gaps(_t(spark, sf_dir, "conversations").filter("conv_id % 7 <> 3 OR turn <> 1"), ["conv_id"], "turn", 0)


@_query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 0)")
def fk_missing(spark, sf_dir):
    found = I.missing_references(_t(spark, sf_dir, "lineitem"), "l_orderkey", _t(spark, sf_dir, "orders").filter("o_orderkey % 97 <> 0"), "o_orderkey")
    return found.select("l_orderkey", "l_linenumber", "l_partkey")


@_query(
    """SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'customer' WHEN n_nationkey IS NULL THEN 'nation' ELSE 'region' END AS missing FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 53 <> 0) ON o_custkey = c_custkey
    LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 7) ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) ON n_regionkey = r_regionkey WHERE r_regionkey IS NULL"""
)
def reference_chain(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").filter("c_custkey % 53 <> 0").select("c_custkey", "c_nationkey")
    n = _t(spark, sf_dir, "nation").filter("n_nationkey <> 7").select("n_nationkey", "n_regionkey")
    r = _t(spark, sf_dir, "region").filter("r_regionkey <> 2").select("r_regionkey")
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = rows.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").filter("r_regionkey IS NULL")
    return rows.select("o_orderkey", F.when(F.col("c_custkey").isNull(), "customer").when(F.col("n_nationkey").isNull(), "nation").otherwise("region").alias("missing"))


@_query(
    """WITH a AS (SELECT o_orderkey AS key, floor(o_totalprice)::BIGINT % 2 AS v FROM orders WHERE o_orderkey % 89 <> 0), b AS (SELECT l_orderkey AS key, min(l_linenumber)::BIGINT % 2 AS v FROM lineitem GROUP BY 1)
    SELECT * FROM (SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'only_left' WHEN a.key IS NULL THEN 'only_right' WHEN a.v IS DISTINCT FROM b.v THEN 'differs' END AS state FROM a FULL JOIN b ON a.key = b.key) WHERE state IS NOT NULL"""
)
def full_outer_diff(spark, sf_dir):
    a = _t(spark, sf_dir, "orders").filter("o_orderkey % 89 <> 0").select(F.col("o_orderkey").alias("key"), (F.floor("o_totalprice").cast("long") % 2).alias("v"))
    b = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg((F.min("l_linenumber").cast("long") % 2).alias("v"))
    return I.full_difference(a, b, "key", "v")


@_query(
    """WITH c AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 11 = 4 THEN 'x' ELSE role END AS role FROM conversations),
    l AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS previous FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, role, previous FROM l WHERE n > 1 AND (role = 'x' OR previous = 'x')"""
)
def chain_breaks(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.when((F.col("conv_id") + F.col("turn")) % 11 == 4, "x").otherwise(F.col("role")).alias("role"))
    # a link's `before` is the role that its own would follow
    c = c.withColumn("before", F.when(F.col("role") == "x", "?").otherwise(F.when(F.col("turn") > 0, "any")))
    c = c.withColumn("after", F.when(F.col("role") == "x", "!").otherwise("any"))
    linked = I.chain_breaks(c, ["conv_id"], "turn", "before", "after").select("conv_id", "turn", "role")
    previous = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("previous"))
    return linked.join(previous, ["conv_id", "turn"])


@_query(
    """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 41 = 0 THEN ts - INTERVAL 30 DAY ELSE ts END AS ts FROM events), l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM e)
    SELECT user_id, event_id FROM l WHERE ts < previous"""
)
def order_violations(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", F.expr("CASE WHEN event_id % 41 = 0 THEN ts - INTERVAL 30 DAY ELSE ts END").alias("ts"))
    return I.order_violations(e, ["user_id"], "event_id", "ts").select("user_id", "event_id")


@_query(
    """(SELECT doc_id, 'missing' AS state FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) UNION ALL
    (SELECT doc_id, 'unexpected' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents))"""
)
def coverage_set_equality(spark, sf_dir):
    return I.set_difference(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id")


FINDINGS = """f AS (SELECT 'asset_integrity' AS "check", 'error' AS severity, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'id_uniqueness', 'error', min(doc_id) FROM documents GROUP BY text HAVING count(*) > 1
    UNION ALL SELECT 'profile', 'warning', doc_id FROM documents WHERE n_chars < 100),
    c AS (SELECT unnest(['manifest_schema', 'asset_integrity', 'id_uniqueness', 'profile', 'page_coverage']) AS "check")"""


def _rollup(spark, sf_dir):
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    uncovered = I.missing_references(docs, "doc_id", labels, "doc_id").select(F.lit("asset_integrity").alias("check"), F.lit("error").alias("severity"), "doc_id")
    twice = docs.groupBy("text").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).filter("n > 1").select(F.lit("id_uniqueness").alias("check"), F.lit("error").alias("severity"), "doc_id")
    short = docs.filter("n_chars < 100").select(F.lit("profile").alias("check"), F.lit("warning").alias("severity"), "doc_id")
    checks = spark.createDataFrame([(c, c != "page_coverage") for c in ("manifest_schema", "asset_integrity", "id_uniqueness", "profile", "page_coverage")], "check string, ran boolean")
    return I.status_rollup(uncovered.unionByName(twice).unionByName(short), checks)


ROLLUP = f"""WITH {FINDINGS}, n AS (SELECT "check", count(*) AS n, bool_or(severity = 'error') AS bad FROM f GROUP BY 1),
    s AS (SELECT c."check", CASE WHEN c."check" = 'page_coverage' THEN 'not-run' WHEN coalesce(bad, false) THEN 'failed' ELSE 'passed' END AS status, coalesce(n, 0) AS n_findings FROM c LEFT JOIN n ON c."check" = n."check")"""


@_query(f"{ROLLUP} SELECT * FROM s")
def status_rollup(spark, sf_dir):
    return _rollup(spark, sf_dir)


@_query(f"{ROLLUP} SELECT bool_and(status = 'passed') AS valid, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'not-run') AS n_not_run FROM s")
def report_validity(spark, sf_dir):
    return I.is_valid(_rollup(spark, sf_dir))


@_query(
    r"""WITH i AS (SELECT item_id, regexp_extract_all(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\p{L}\p{N}_]+') AS t FROM benchmark WHERE text IS NOT NULL), d AS (SELECT doc_id, regexp_extract_all(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[\p{L}\p{N}_]+') AS t FROM documents WHERE text IS NOT NULL),
    iw AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(t) AS w FROM i) GROUP BY 1, 2), dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(t) AS w FROM d) GROUP BY 1, 2),
    s AS (SELECT item_id, doc_id, sum(least(iw.n, dw.n)) AS s FROM iw JOIN dw ON iw.w = dw.w GROUP BY 1, 2)
    SELECT i.item_id, d.doc_id, round(coalesce(s, 0) / greatest(len(i.t), 1), 6) AS overlap FROM i CROSS JOIN d LEFT JOIN s ON s.item_id = i.item_id AND s.doc_id = d.doc_id"""
)
def token_overlap(spark, sf_dir):
    return I.overlaps(_t(spark, sf_dir, "benchmark"), _t(spark, sf_dir, "documents"))


@_query(
    """WITH d AS (SELECT doc_id, CASE doc_id % 29 WHEN 3 THEN chr(65279) || text WHEN 5 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 7 THEN text || chr(8232) ELSE text END AS text FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, starts_with(text, chr(65279)) AS has_bom, contains(text, chr(13)) AS has_cr, regexp_matches(text, '[\\x{85}\\x{2028}\\x{2029}]') AS has_odd_line_ends FROM d"""
)
def text_hygiene(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").filter("text IS NOT NULL")
    k = F.col("doc_id") % 29
    changed = F.when(k == 3, F.concat(F.lit("\ufeff"), "text")).when(k == 5, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(k == 7, F.concat("text", F.lit("\u2028"))).otherwise(F.col("text"))
    return I.text_hygiene(d.select("doc_id", changed.alias("text"))).drop("text")


@_query(
    """WITH c AS (SELECT l_orderkey AS "table", l_linenumber % 4 AS "row", 1 + (l_partkey % 3) AS colspan FROM lineitem), r AS (SELECT "table", "row", sum(colspan)::BIGINT AS width FROM c GROUP BY 1, 2), w AS (SELECT *, max(width) OVER (PARTITION BY "table") AS widest FROM r)
    SELECT "table", "row", width, widest FROM w WHERE width <> widest"""
)
def table_grid(spark, sf_dir):
    c = _t(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS table", "l_linenumber % 4 AS row", "1 + (l_partkey % 3) AS colspan")
    return I.grid_occupancy(c)
