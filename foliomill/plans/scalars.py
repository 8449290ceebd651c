"""Queries of scalar rules and text operators, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.functions import scalars as S
from foliomill.operators import golden as G
from foliomill.operators import prose
from foliomill.plans.layout import join_sql
from foliomill.sources.bridge import BOXES, boxes

QUERIES, SQL = {}, {}
#: Parts that rows are dealt to for each block of queries.
ROW_BLOCKS = 64


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(
    """WITH h AS (SELECT doc_id, sha1(unhex('6d4d259c105b5feea87aefd4ad4d9bf8') || encode('package:0.1:' || sha256(coalesce(text, '')))) AS h FROM documents)
    SELECT doc_id, 'urn:uuid:' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ('89ab89ab89ab89ab')[1 + strpos('0123456789abcdef', h[17:17]) - 1] || h[18:20] || '-' || h[21:32] AS package_id FROM h"""
)
def package_uuid5(spark, sf_dir):
    name = F.concat(F.lit("package:0.1:"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256))
    return _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("urn:uuid:"), S.uuid5(S.PACKAGE_NAMESPACE, name)).alias("package_id"))


@_query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size FROM documents WHERE text IS NOT NULL")
def sha256_digest(spark, sf_dir):
    raw = F.encode("text", "UTF-8")
    return _t(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2(raw, 256).alias("sha256"), F.length(raw).cast("long").alias("size"))


@_query("""SELECT conv_id, sha256('[' || string_agg('{"role":"' || role || '","turn":' || turn || '}', ',' ORDER BY turn) || ']') AS digest FROM conversations GROUP BY conv_id""")
def canonical_digest(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    json = F.concat(F.lit('{"role":"'), "role", F.lit('","turn":'), F.col("turn").cast("string"), F.lit("}"))
    return G.canonical_digest(c.withColumn("json", json), ["conv_id"], "turn", "json")


@_query(
    """WITH b AS (SELECT vec_id, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1 ELSE 0 END * (CASE WHEN i = 63 THEN -(1::HUGEINT << 63) ELSE 1::HUGEINT << i::INT END)))::BIGINT AS bits FROM embeddings WHERE embedding IS NOT NULL)
    SELECT a.vec_id, b.vec_id AS other, bit_count(xor(a.bits, b.bits))::INT AS distance FROM b a JOIN b b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND bit_count(xor(a.bits, b.bits)) <= 20"""
)
def hamming_near(spark, sf_dir):
    bits = F.expr("aggregate(sequence(1, 64), 0L, (acc, i) -> acc + CASE WHEN embedding[i - 1] > 0 THEN shiftleft(1L, i - 1) ELSE 0L END)")
    e = _t(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL").select("vec_id", bits.alias("bits"))
    # every row with an id divisible by 50 is a query against all rows, in blocks of 1024 queries
    queries = e.filter("vec_id % 50 = 0")
    blocks = max(1, -(-queries.count() // 1024))
    q = queries.select(F.col("vec_id").alias("q_id"), F.col("bits").alias("q_bits"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(ROW_BLOCKS - 1))).alias("part"))
    rows = e.select("vec_id", "bits", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(ROW_BLOCKS)).cast("int").alias("part"))
    distance = S.hamming(F.col("q_bits"), F.col("bits"))
    near = rows.join(q, (rows["block"] == q["block"]) & (rows["part"] == q["part"]) & (F.col("q_id") != F.col("vec_id")) & (distance <= 20))
    return near.select(F.col("q_id").alias("vec_id"), F.col("vec_id").alias("other"), distance.alias("distance"))


MIME_SQL = "CASE lower(regexp_extract(p, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.MIME.items()) + " END"


@_query(
    f"""WITH u AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS p, CAST(page_id % 30 AS INT) AS k FROM pages WHERE url IS NOT NULL),
    q AS (SELECT page_id, CASE k WHEN 1 THEN '../' || p WHEN 2 THEN '/' || p WHEN 3 THEN p || '.png' WHEN 4 THEN replace(p, '/', chr(92)) ELSE regexp_replace(p, '[?#].*$', '') END AS p FROM u)
    SELECT page_id, p AS path, p <> '' AND NOT contains(p, chr(92)) AND NOT starts_with(p, '/') AND NOT contains('/' || p || '/', '/../') AS is_safe, {MIME_SQL} AS mime FROM q"""
)
def package_paths(spark, sf_dir):
    p, k = F.regexp_replace("url", "^https?://", ""), F.col("page_id") % 30
    path = F.when(k == 1, F.concat(F.lit("../"), p)).when(k == 2, F.concat(F.lit("/"), p)).when(k == 3, F.concat(p, F.lit(".png"))).when(k == 4, F.replace(p, F.lit("/"), F.lit("\\"))).otherwise(F.regexp_replace(p, "[?#].*$", ""))
    rows = _t(spark, sf_dir, "pages").filter("url IS NOT NULL").select("page_id", path.alias("path"))
    return rows.select("page_id", "path", S.is_safe_path(F.col("path")).alias("is_safe"), S.mime_of(F.col("path")).alias("mime"))


@_query(
    """SELECT l_orderkey, l_linenumber, printf('lp-%06d', l_linenumber) AS logical_page, 'assets/evidence/pages/src-' || printf('%03d', l_suppkey % 1000) || '/page-' || printf('%06d', l_linenumber) || '.png' AS image,
    abs(l_quantity * 300 / 72 - floor(l_quantity * 300 / 72 + l_tax * 20)) <= 1 AS geometry_ok FROM lineitem"""
)
def page_records(spark, sf_dir):
    source = F.concat(F.lit("src-"), F.lpad((F.col("l_suppkey") % 1000).cast("string"), 3, "0"))
    px = F.floor(F.col("l_quantity") * 300 / 72 + F.col("l_tax") * 20)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.logical_page(F.col("l_linenumber")).alias("logical_page"), S.page_image(source, F.col("l_linenumber")).alias("image"), S.pixels_match(F.col("l_quantity"), px).alias("geometry_ok"))


@_query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_discount * 12 - 0.1 AS x0, l_tax * 10 AS y0, l_quantity / 45 AS x1, l_tax * 10 + l_discount AS y1 FROM lineitem)
    SELECT l_orderkey, l_linenumber, x0 BETWEEN 0 AND 1 AND y0 BETWEEN 0 AND 1 AND x1 BETWEEN 0 AND 1 AND y1 BETWEEN 0 AND 1 AND x0 < x1 AND y0 < y1 AS valid FROM b"""
)
def bbox_validity(spark, sf_dir):
    b = _t(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_discount * 12 - 0.1D AS x0", "l_tax * 10 AS y0", "l_quantity / 45 AS x1", "l_tax * 10 + l_discount AS y1")
    return b.select("l_orderkey", "l_linenumber", S.bbox_is_valid(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("valid"))


# every other month is written in small letters
DATES = "'stamp ' || (1 + doc_id % 28) || ' ' || (['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[1 + doc_id % 13] || ' ' || (2000 + doc_id % 30)"


@_query(
    f"""WITH d AS (SELECT doc_id, coalesce({DATES}, 'no date') AS s, CASE WHEN doc_id % 3 = 0 THEN 'see arXiv:' || lpad((doc_id % 10000)::VARCHAR, 4, '0') || '.' || lpad((doc_id * 7 % 100000)::VARCHAR, 5, '0') || 'v2 end' ELSE text END AS t FROM documents)
    SELECT doc_id, CASE WHEN s <> 'no date' THEN (1 + doc_id % 28) || '' || (1 + doc_id % 13) || '' || (2000 + doc_id % 30) END AS stamp_date, nullif(regexp_extract(t, '(?:arXiv:)?([0-9]{{4}}\\.[0-9]{{4,5}}v[0-9]+)', 1), '') AS preprint_id FROM d"""
)
def stamp_dates(spark, sf_dir):
    k = F.col("doc_id")
    month = F.get(F.array(*[F.lit(m) for m in S.MONTHS]), (k % 13).cast("int"))
    stamp = F.coalesce(F.concat(F.lit("stamp "), (1 + k % 28).cast("string"), F.lit(" "), month, F.lit(" "), (2000 + k % 30).cast("string")), F.lit("no date"))
    number = F.concat(F.lit("see arXiv:"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad((k * 7 % 100000).cast("string"), 5, "0"), F.lit("v2 end"))
    text = F.when(k % 3 == 0, number).otherwise(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", S.stamp_date(stamp).alias("stamp_date"), S.preprint_id(text).alias("preprint_id"))


@_query(
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]*)', 1) AS scheme, CASE page_id % 12 WHEN 1 THEN 'localhost' WHEN 2 THEN '10.1.2.3' WHEN 3 THEN '8.8.8.8:80' WHEN 4 THEN 'a@' || regexp_extract(url, '^(https?)://([^/?#]*)', 2) WHEN 5 THEN '172.20.0.1' WHEN 6 THEN 'x.localhost' WHEN 7 THEN '[::1]' WHEN 8 THEN '[2606:4700::1]' ELSE regexp_extract(url, '^(https?)://([^/?#]*)', 2) END AS host FROM pages WHERE url IS NOT NULL)
    SELECT page_id, scheme <> '' AND host <> '' AND page_id % 12 NOT IN (1, 2, 4, 5, 6, 7) AS is_public FROM p"""
)
def public_urls(spark, sf_dir):
    m, k = r"^(https?)://([^/?#]*)", F.col("page_id") % 12
    host = F.regexp_extract("url", m, 2)
    changed = F.when(k == 1, "localhost").when(k == 2, "10.1.2.3").when(k == 3, "8.8.8.8:80").when(k == 4, F.concat(F.lit("a@"), host)).when(k == 5, "172.20.0.1").when(k == 6, "x.localhost").when(k == 7, "[::1]").when(k == 8, "[2606:4700::1]").otherwise(host)
    url = F.concat(F.regexp_extract("url", m, 1), F.lit("://"), changed, F.lit("/x"))
    return _t(spark, sf_dir, "pages").filter("url IS NOT NULL").select("page_id", S.is_public_url(url).alias("is_public"))


@_query(f"WITH {BOXES}, l AS (SELECT doc_id, seq, text, lead(text) OVER (PARTITION BY doc_id ORDER BY seq) AS nxt FROM boxes) SELECT doc_id, seq, {join_sql('text', 'nxt')} AS joined FROM l WHERE nxt IS NOT NULL")
def line_join(spark, sf_dir):
    return prose.joined_neighbours(boxes(spark, sf_dir))


@_query(None)
def line_merge(spark, sf_dir):
    return prose.merged_fragments(boxes(spark, sf_dir)).select("doc_id", "page", "nth", "text", "x0", "y0", "x1", "y1")


@_query(None)
def paragraph_blocks(spark, sf_dir):
    return prose.blocks(boxes(spark, sf_dir)).select("doc_id", "nth", "kind", "page", "n_boxes", "text")


@_query(None)
def candidate_consistency(spark, sf_dir):
    return prose.supported(_t(spark, sf_dir, "benchmark"), _t(spark, sf_dir, "documents"))


LINKS = "links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages WHERE html IS NOT NULL)"


@_query(f"WITH {LINKS} SELECT page_id, href, count(*) AS n FROM links GROUP BY page_id, href")
def markup_links(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").filter("html IS NOT NULL")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@_query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages WHERE html IS NOT NULL")
def markup_title(spark, sf_dir):
    return _t(spark, sf_dir, "pages").filter("html IS NOT NULL").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"))


@_query("WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<h([1-6])', 1)) AS l FROM pages WHERE html IS NOT NULL) SELECT page_id, least(l::INT, 4) AS level, count(*) AS n FROM h GROUP BY 1, 2")
def toc_levels(spark, sf_dir):
    h = _t(spark, sf_dir, "pages").filter("html IS NOT NULL").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<h([1-6])"), 1)).alias("l"))
    return h.select("page_id", S.toc_level(F.col("l").cast("int") - 1).alias("level")).groupBy("page_id", "level").agg(F.count("*").alias("n"))


@_query(
    """SELECT page_id, len(regexp_extract_all(html, '<p[ >]'))::BIGINT AS paragraphs, len(regexp_extract_all(html, '<a '))::BIGINT AS links, len(regexp_extract_all(html, '<h[1-6]'))::BIGINT AS headings, len(regexp_extract_all(html, '<li[ >]'))::BIGINT AS items,
    CASE WHEN len(regexp_extract_all(html, '<h[1-6]')) = 0 OR len(regexp_extract_all(html, '<p[ >]')) = 0 THEN 'failed' ELSE 'partial' END AS criteria FROM pages WHERE html IS NOT NULL"""
)
def quality_metrics(spark, sf_dir):
    def n(pattern):
        return F.regexp_count("html", F.lit(pattern)).cast("long")

    p = _t(spark, sf_dir, "pages").filter("html IS NOT NULL").select("page_id", n("<p[ >]").alias("paragraphs"), n("<a ").alias("links"), n("<h[1-6]").alias("headings"), n("<li[ >]").alias("items"))
    return p.withColumn("criteria", G.criteria(F.col("headings") == 0, F.col("paragraphs") == 0))


@_query("SELECT event_type, array_to_string(list_sort(list_distinct(list(user_id % 5))), ',') AS versions FROM events GROUP BY event_type")
def engine_versions(spark, sf_dir):
    found = G.distinct_versions(_t(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("version")), "event_type", "version")
    return found.select("event_type", F.array_join(F.transform("versions", lambda v: v.cast("string")), ",").alias("versions"))
