"""Projections of packages for regression tests, one package for each document, and their comparison with changed ones; with oracles.

Pages and elements are those of the bridge's boxes. An image's facts come from the hash of its place: no engine renders here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import scalars as S
from foliomill.operators import golden as G
from foliomill.sources.bridge import BOXES, boxes, page_numbers
from foliomill.sources.written import written

#: What the changed packages have otherwise; the same words in Spark and in the oracle.
CHANGES = {
    "texts": "doc_id % 7 = 1", "engine": "doc_id % 11 = 2", "pixels": "doc_id % 5 = 3", "short": "doc_id % 17 = 4", "codes": "doc_id % 19 = 5", "identity": "doc_id % 23 = 6", "renamed": "doc_id % 29 = 7", "lost": "doc_id % 31 = 8",
}
FLIPPED = "(doc_id + page) % 13"


def _json(**values: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]), {"ignoreNullFields": "false"})


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, document_sha256, pages): numbers of the pages that hold boxes."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text IS NOT NULL")
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.encode("text", "UTF-8"), 256).alias("document_sha256"), page_numbers().alias("pages"))


def _projection(spark: SparkSession, sf_dir: str, docs: DataFrame, changed: bool) -> DataFrame:
    def on(name: str) -> Column:
        return F.expr(CHANGES[name]) if changed else F.lit(False)

    package, source = F.col("doc_id").cast("string").alias("package"), F.lit("src-001")
    docs = docs.filter(~on("lost")).withColumn("pages", F.when(on("short"), F.slice("pages", 1, F.greatest(F.size("pages") - 1, F.lit(0)))).otherwise(F.col("pages")))
    manifests = docs.select(package, _json(package_id=F.concat(F.lit("urn:doc:"), "doc_id", F.when(on("identity"), ":again").otherwise("")), sources=F.array(F.struct(F.lit("src-001").alias("id"), F.col("document_sha256").alias("sha256")))).alias("json"))
    pages = docs.select("doc_id", F.explode("pages").alias("page"))
    place = F.concat(S.page_image(source, F.col("page")), F.when(on("renamed") & (F.col("page") == 1), ".new").otherwise(""))
    page_json = _json(source_id=source, physical_page=F.col("page"), logical_page_id=S.logical_page(F.col("page")), image=S.page_image(source, F.col("page")), printed_label=F.lit(None).cast("string"), render_dpi=F.lit(S.DPI))
    b = boxes(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("long")).filter(~on("lost"))
    ident = F.concat(F.lit("p-"), F.lpad(F.col("seq").cast("string"), 6, "0"))

    def said(method: str, text: Column) -> Column:
        return F.struct(F.lit(method).alias("method"), F.when(on("engine"), "2").otherwise("1").alias("engine_version"), text.alias("text"))

    read = [said("native-pdf", F.concat("text", F.when(on("texts"), "!").otherwise(""))), F.when(F.col("seq") % 3 != 1, said("ocr", F.when(F.col("seq") % 3 == 2, "").otherwise("read")))]
    at = F.struct(source.alias("source_id"), F.col("page").alias("physical_page"), S.logical_page(F.col("page")).alias("logical_page_id"), S.page_image(source, F.col("page")).alias("page_image"), F.array(F.struct(F.array("x0", "y0", "x1", "y1").alias("bbox"))).alias("regions"), F.array_compact(F.array(*read)).alias("candidates"))
    elements = b.select("doc_id", "seq", ident.alias("element_id"), F.concat(F.lit("//*[@id='"), ident, F.lit("']")).alias("xml_path"), F.array(at).alias("sources"))
    element_json = _json(element_id=F.col("element_id"), xml_path=F.col("xml_path"), reading_order=F.col("seq"), sources=F.col("sources"), decision=F.struct(F.lit("ocr").alias("method")))
    records = elements.select(package, F.lit("elements").alias("kind"), F.col("seq").alias("nth"), element_json.alias("json")).unionByName(pages.select(package, F.lit("pages").alias("kind"), F.col("page").alias("nth"), page_json.alias("json")))
    key = F.sha2(F.concat_ws("/", "doc_id", "page"), 256)
    flipped = F.conv(F.substring(key, 13, 4), 16, 10).cast("int").bitwiseXOR(F.expr(f"CAST(shiftleft(1, CAST({FLIPPED} AS INT)) - 1 AS INT)"))
    dhash = F.when(on("pixels"), F.concat(F.substring(key, 1, 12), F.lpad(F.lower(F.hex(flipped)), 4, "0"))).otherwise(F.substring(key, 1, 16))
    fact = F.struct(F.lit(2550).alias("width"), F.lit(3300).alias("height"), F.when(on("pixels") & (F.col("page") % 2 == 1), F.reverse(key)).otherwise(key).alias("rgb_sha256"), dhash.alias("dhash"), F.lit(None).cast("string").alias("error"))
    images = pages.select(package, F.col("page").alias("nth"), place.alias("path"), fact.alias("fact"))
    codes = F.array(F.struct(F.when(on("codes"), "checksum_mismatch").otherwise("page_coverage_not_audited").alias("code")))
    none = F.array().cast("array<struct<code:string>>")
    reports = docs.select(package, _json(valid=F.lit(False), checks=F.struct(F.lit("partial").alias("page_coverage")), statistics=F.struct(F.size("pages").alias("pages")), errors=codes, warnings=none).alias("json"))
    quality = docs.select(package, _json(status=F.lit("partial"), pages=F.size("pages")).alias("json"))
    return G.projection(manifests, docs.select(package, "document_sha256"), records, images, G.engine_versions(elements.select(package, "sources")), reports, quality)


def golden_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projection for each document, its nested values as canonical JSON."""
    p = _projection(spark, sf_dir, written(_documents(spark, sf_dir)), False)
    versions = F.concat_ws("/", F.array_join("engine_fingerprint.native", ","), F.array_join("engine_fingerprint.recognised", ","))
    images = F.sha2(F.array_join(F.transform("page_images", lambda i: F.concat_ws(" ", i["path"], i["width"], i["rgb_sha256"], i["dhash"])), ","), 256)
    kept = ("source", "package_id", "document_sha256", "pages_sha256", "elements_sha256", "omissions_sha256", "page_count", "element_count", "omission_count", "validation", "content_quality")
    return p.select(F.col("package").cast("long").alias("doc_id"), *kept, versions.alias("engines"), images.alias("images_sha256"), F.size("faults").alias("faults"))


def projection_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the projections of changed packages differ from the expected ones."""
    docs = written(_documents(spark, sf_dir))
    found = G.differences(_projection(spark, sf_dir, docs, False), _projection(spark, sf_dir, docs, True))
    return found.select(F.col("package").cast("long").alias("doc_id"), "difference")


_IMAGE = "'assets/evidence/pages/src-001/page-' || lpad(page::VARCHAR, 6, '0') || '.png'"
_LP = "'lp-' || lpad(page::VARCHAR, 6, '0')"
_LIST = "sha256('[' || coalesce(string_agg({}, ',' ORDER BY {}), '') || ']')"
_DOCS = f"docs AS (SELECT doc_id::BIGINT AS doc_id, sha256(text) AS document_sha256 FROM documents WHERE text IS NOT NULL), {BOXES}, pgs AS (SELECT DISTINCT doc_id, page FROM boxes)"
_PAGE = f"""'{{"image":"' || {_IMAGE} || '","logical_page_id":"' || {_LP} || '","physical_page":' || page || ',"printed_label":null,"render_dpi":{S.DPI},"source_id":"src-001"}}'"""
_ELEMENT = (
    f"""'{{"decision_method":"ocr","element_id":"p-' || lpad(seq::VARCHAR, 6, '0') || '","reading_order":' || seq || ',"resources":[],"revisions":[],"sources":[{{"logical_page_id":"' || {_LP} || '","native_text_sha256":"' || sha256(text)"""
    f""" || '","ocr_nonempty":' || (seq % 3 = 0)::VARCHAR || ',"ocr_present":' || (seq % 3 <> 1)::VARCHAR || ',"page_image":"' || {_IMAGE} || '","physical_page":' || page || ',"regions":[{{"bbox":[' || x0 || ',' || y0 || ',' || x1 || ',' || y1"""
    """ || ']}],"source_id":"src-001"}],"xml_path":"//*[@id=''p-' || lpad(seq::VARCHAR, 6, '0') || ''']"}'"""
)
_FLAGS = ", ".join(f"d.{v} AS {k}" for k, v in CHANGES.items())

QUERIES = {"golden_projection": golden_projection, "projection_diff": projection_diff}
SQL = {
    "golden_projection": f"""WITH {_DOCS}, pg AS (SELECT doc_id, count(*) AS n, {_LIST.format(_PAGE, 'page')} AS pages_sha256,
      sha256(string_agg({_IMAGE} || ' 2550 ' || sha256(doc_id || '/' || page) || ' ' || sha256(doc_id || '/' || page)[1:16], ',' ORDER BY page)) AS images_sha256 FROM pgs GROUP BY doc_id),
    el AS (SELECT doc_id, count(*) AS n, {_LIST.format(_ELEMENT, 'seq')} AS elements_sha256, '1' || CASE WHEN bool_or(seq % 3 <> 1) THEN '/1' ELSE '/' END AS engines FROM boxes GROUP BY doc_id)
    SELECT d.doc_id, '{{"id":"src-001","sha256":"' || document_sha256 || '"}}' AS source, 'urn:doc:' || d.doc_id AS package_id, document_sha256, coalesce(pages_sha256, sha256('[]')) AS pages_sha256, coalesce(elements_sha256, sha256('[]')) AS elements_sha256, sha256('[]') AS omissions_sha256,
      coalesce(pg.n, 0) AS page_count, coalesce(el.n, 0) AS element_count, 0::BIGINT AS omission_count, '{{"checks":{{"page_coverage":"partial"}},"error_codes":["page_coverage_not_audited"],"statistics":{{"pages":' || coalesce(pg.n, 0) || '}},"valid":false,"warning_codes":[]}}' AS validation,
      '{{"pages":' || coalesce(pg.n, 0) || ',"status":"partial"}}' AS content_quality, coalesce(engines, '/') AS engines, coalesce(images_sha256, sha256('')) AS images_sha256, 0 AS faults
    FROM docs d LEFT JOIN pg ON pg.doc_id = d.doc_id LEFT JOIN el ON el.doc_id = d.doc_id""",
    "projection_diff": f"""WITH {_DOCS}, seen AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM pgs),
    told AS (SELECT d.doc_id, coalesce(max(n), 0) > 0 AS filled, {_FLAGS} FROM docs d LEFT JOIN seen ON seen.doc_id = d.doc_id GROUP BY d.doc_id),
    named AS (SELECT doc_id, unnest([CASE WHEN identity THEN 'package_id' END, CASE WHEN texts AND filled THEN 'elements_sha256' END, CASE WHEN short AND filled THEN 'pages_sha256' END, CASE WHEN short AND filled THEN 'page_count' END,
      CASE WHEN codes OR (short AND filled) THEN 'validation' END, CASE WHEN short AND filled THEN 'content_quality' END, CASE WHEN short AND filled THEN 'page_images.count' END]) AS difference FROM told WHERE NOT lost),
    pictured AS (SELECT t.doc_id, i, unnest([CASE WHEN renamed AND page = 1 THEN 'path' END, CASE WHEN pixels AND NOT engine AND page % 2 = 1 THEN 'rgb_sha256' END, CASE WHEN pixels AND engine AND (t.doc_id + page) % 13 > {G.MOST_BITS} THEN 'dhash' END]) AS k
      FROM told t JOIN seen ON seen.doc_id = t.doc_id WHERE NOT lost AND NOT (short AND i = n))
    SELECT doc_id, difference FROM named WHERE difference IS NOT NULL UNION ALL SELECT doc_id, 'page_images[' || i || '].' || k FROM pictured WHERE k IS NOT NULL UNION ALL SELECT doc_id, 'package' FROM told WHERE lost""",
}
