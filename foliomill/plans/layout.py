"""Layout queries over the bridge's boxes, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions import scalars as S
from foliomill.operators import layout as L
from foliomill.operators import pages as P
from foliomill.sources.bridge import BOXES, boxes

QUERIES, SQL = {}, {}
STAMP = "((x0 < 0.12 OR x1 > 0.88) AND length(text) >= 12 AND ((y1 - y0) > 2.5 * (x1 - x0) OR (x1 - x0) < 0.08))"
WORDS = "len(regexp_extract_all(text, '[A-Za-z]{3,}'))"
SIGNALS = f"len(regexp_extract_all(text, '{S.MATH_SIGNS}'))"
PAGE_NUMBER = "(y0 > 0.74 AND regexp_full_match(trim(text), '\\d{1,4}'))"
SHORT = "len(regexp_extract_all(text, '[A-Za-z]+')) >= 2"
FRAGMENT = f"({WORDS} = 0 AND NOT regexp_matches(text, '\\([0-9]{{4}}\\)') AND ({SIGNALS} > 0 OR {SHORT} OR regexp_full_match(trim(text), '[^A-Za-z0-9]+')))"
SEED = f"(contains(text, '=') AND {WORDS} <= 2 AND {SIGNALS} >= 3 AND x1 - x0 >= 0.1)"
ENVELOPE = "round(least(greatest(min(x0), 0.0), 1.0), 6) AS x0, round(least(greatest(min(y0), 0.0), 1.0), 6) AS y0, round(least(greatest(max(x1), 0.0), 1.0), 6) AS x1, round(least(greatest(max(y1), 0.0), 1.0), 6) AS y1, round(coalesce(avg(confidence), 0.0), 6) AS confidence, count(*) AS n_boxes"
BY_ROW = "ORDER BY y0, x0, seq"


def median_sql(used: str = "") -> str:
    but = "AND (doc_id, seq) NOT IN (SELECT doc_id, seq FROM used)" if used else ""
    return f"med AS (SELECT doc_id, page, coalesce(median(font_size) FILTER (font_size >= 8 AND NOT {PAGE_NUMBER} {but}), 10.0) AS med FROM boxes GROUP BY doc_id, page)"


def join_sql(a: str, x: str) -> str:
    """H3 and H2 without a lexicon."""
    word = f"lower(regexp_extract({x}, '^\\s*(\\S+)', 1))"
    glue = f"CASE WHEN {a} = '' THEN '' WHEN ends_with({a}, '-') AND {word} IN ('and', 'or') THEN ' ' WHEN ends_with({a}, '-') AND regexp_matches({word}, '^(and|or)-') THEN '' WHEN ends_with({a}, '-') AND regexp_matches({x}, '^\\p{{Ll}}') THEN '' ELSE ' ' END"
    return repair_sql(f"trim(regexp_replace({a} || {glue} || {x}, '\\s+', ' ', 'g'))")


def repair_sql(t: str) -> str:
    t = f"regexp_replace({t}, '([a-z])([A-Z][A-Z])', '\\1 \\2', 'g')"
    t = f"regexp_replace({t}, '({S.JOINED_GREEK})([A-Za-z])', '\\1 \\2', 'g')"
    return f"regexp_replace({t}, '(^|[^\\p{{L}}\\p{{N}}_])({S.JOINED_UNITS})([A-Za-z])', '\\1\\2 \\3', 'g')"


READING = """ro0 AS (SELECT *, ((x1 - x0) >= 0.58 OR (x0 < 0.46 AND x1 > 0.46))::INT AS "full", (NOT ((x0 + x1) / 2 < 0.5))::INT AS side, ((x1 - x0) >= 0.45)::INT AS wide, round(y0, 4) AS ry FROM boxes),
    ro1 AS (SELECT *, sum(("full" = 0 AND side = 0)::INT) OVER p AS nl, sum(("full" = 0 AND side = 1)::INT) OVER p AS nr, sum(wide) OVER p AS nw, count(*) OVER p AS na,
      sum("full") OVER (PARTITION BY doc_id, page ORDER BY ry, x0, seq ROWS UNBOUNDED PRECEDING) AS band FROM ro0 WINDOW p AS (PARTITION BY doc_id, page)),
    ro2 AS (SELECT *, (nl < 2 OR nr < 2 OR nw >= 0.35 * na) AS plain FROM ro1),
    ro AS (SELECT doc_id, page, seq, text, x0, y0, x1, y1, font_size, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN plain THEN 0 ELSE band END, CASE WHEN plain THEN 0 ELSE 1 - "full" END, CASE WHEN plain THEN 0 ELSE side END, ry, x0, seq) AS INT) AS reading_order FROM ro2)"""
TITLE = f"""ti0 AS (SELECT *, (NOT {STAMP} AND x1 - x0 >= 0.18 AND x1 - x0 >= 2.5 * (y1 - y0) AND len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]')) >= 3 AND y0 < 0.45) AS g FROM boxes WHERE page = 1),
    ti1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g::INT DESC, font_size DESC, CASE WHEN g THEN x1 - x0 ELSE length(text) END DESC, CASE WHEN g THEN -abs((x0 + x1) / 2 - 0.5) ELSE 0 END DESC, CASE WHEN g THEN -y0 ELSE 0 END DESC, seq) AS n FROM ti0),
    title AS (SELECT doc_id, seq, text AS title, y1 AS title_bottom, font_size AS title_font FROM ti1 WHERE n = 1)"""
TABLES = f"""ts AS (SELECT doc_id, page, seq AS start_seq, y0 AS sy FROM boxes WHERE regexp_matches(text, '^Table\\s+[0-9]+\\b')),
    tr AS (SELECT b.*, start_seq, lag(y1) OVER (PARTITION BY b.doc_id, b.page, start_seq ORDER BY y0, x0, seq) AS prev FROM boxes b JOIN ts ON b.doc_id = ts.doc_id AND b.page = ts.page WHERE y0 >= sy),
    tq AS (SELECT *, sum(CASE WHEN font_size >= 9.5 AND y0 - prev > 0.015 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, start_seq ORDER BY y0, x0, seq ROWS UNBOUNDED PRECEDING) AS stops FROM tr),
    tn AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page, start_seq) AS n_in FROM tq WHERE stops = 0), tb AS (SELECT * FROM tn WHERE n_in >= 2),
    tables AS (SELECT doc_id, page, start_seq, {ENVELOPE} FROM tb GROUP BY doc_id, page, start_seq)"""
FIGURES = f"""fg AS (SELECT b.doc_id, b.page, b.seq AS start_seq, any_value(b.x0) AS sx, any_value(b.y0) AS sy, any_value(b.font_size) AS sf, min(p.y0) AS top FROM boxes b JOIN (SELECT * FROM boxes WHERE NOT {PAGE_NUMBER}) p ON p.doc_id = b.doc_id AND p.page = b.page AND p.y1 < b.y0 - 0.005
      WHERE regexp_matches(b.text, '^Fig\\.\\s*[0-9]+\\b') AND b.y0 < 0.6 GROUP BY b.doc_id, b.page, b.seq HAVING count(*) >= 3),
    fr AS (SELECT b.*, start_seq, sy, top, max(y1) OVER (PARTITION BY b.doc_id, b.page, start_seq ORDER BY y0, x0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low
      FROM boxes b JOIN fg ON b.doc_id = fg.doc_id AND b.page = fg.page WHERE sy - 0.002 <= y0 AND y1 <= sy + 0.23 AND font_size <= sf + 0.5 AND x0 >= sx - 0.02),
    fq AS (SELECT *, sum(coalesce(y0 - low > 0.018, false)::INT) OVER (PARTITION BY doc_id, page, start_seq ORDER BY y0, x0, seq ROWS UNBOUNDED PRECEDING) AS gaps FROM fr), fb AS (SELECT * FROM fq WHERE gaps = 0),
    graphics AS (SELECT doc_id, page, start_seq, 0.14::DOUBLE AS x0, round(greatest(any_value(top) - 0.01, 0.0), 6) AS y0, 0.86::DOUBLE AS x1, round(any_value(sy) - 0.008, 6) AS y1, any_value(sy) AS sy FROM fb GROUP BY doc_id, page, start_seq)"""


def overlap_sql(a: str, r: str) -> str:
    return f"greatest(least({a}.x1, {r}.x1) - greatest({a}.x0, {r}.x0), 0) * greatest(least({a}.y1, {r}.y1) - greatest({a}.y0, {r}.y0), 0)"


def formulas_sql(source: str = "boxes") -> str:
    """Seeds of the bridge never lie in another seed's cluster; a test covers such seeds."""
    return f"""fs AS (SELECT doc_id, page, seq AS seed, (y0 + y1) / 2 AS cy, font_size AS sf FROM {source} WHERE {SEED}),
    fm0 AS (SELECT b.*, seed, count(*) OVER (PARTITION BY b.doc_id, b.page, seed) AS n_in FROM {source} b JOIN fs ON b.doc_id = fs.doc_id AND b.page = fs.page WHERE abs((y0 + y1) / 2 - cy) <= 0.018 AND ({WORDS} <= 2 OR font_size < 0.85 * sf)),
    fm AS (SELECT * FROM fm0 WHERE n_in >= 2), formulas AS (SELECT doc_id, page, seed, {ENVELOPE} FROM fm GROUP BY doc_id, page, seed)"""


USED = f"""{TITLE}, {TABLES}, {FIGURES}, regions AS (SELECT doc_id, page, x0, y0, x1, y1 FROM graphics UNION ALL SELECT doc_id, page, x0, y0, x1, y1 FROM fb UNION ALL SELECT doc_id, page, x0, y0, x1, y1 FROM tables),
    free AS (SELECT * FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.doc_id = b.doc_id AND r.page = b.page AND (b.x1 - b.x0) * (b.y1 - b.y0) > 0 AND {overlap_sql('b', 'r')} / ((b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.2)),
    {formulas_sql('free')},
    used AS (SELECT doc_id, 1 AS page, seq, 'title' AS kind FROM title UNION SELECT doc_id, page, seq, 'figure' FROM fb UNION SELECT doc_id, page, seq, 'table' FROM tb UNION SELECT doc_id, page, seq, 'formula' FROM fm
      UNION SELECT b.doc_id, b.page, b.seq, 'figure' FROM boxes b JOIN graphics g ON b.doc_id = g.doc_id AND b.page = g.page WHERE b.y1 < g.sy - 0.005 AND NOT {PAGE_NUMBER.replace('y0', 'b.y0').replace('text', 'b.text')} AND {overlap_sql('b', 'g')} > 0)"""


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {BOXES}, {sql}" if not sql.startswith("SELECT") else f"WITH {BOXES} {sql}"
        return f

    return add


@_query(f"{READING} SELECT doc_id, page, seq, text, reading_order FROM ro")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reading_order(boxes(spark, sf_dir)).select("doc_id", "page", "seq", "text", "reading_order")


@_query(f"SELECT doc_id, page, seq, text FROM boxes WHERE {PAGE_NUMBER}")
def page_numbers(spark, sf_dir):
    return boxes(spark, sf_dir).filter(S.is_page_number()).select("doc_id", "page", "seq", "text")


@_query(f"SELECT doc_id, page, seq, text FROM boxes WHERE {STAMP}")
def stamps(spark, sf_dir):
    return boxes(spark, sf_dir).filter(S.is_stamp()).select("doc_id", "page", "seq", "text")


@_query(f"{TITLE} SELECT doc_id, seq, title FROM title")
def title_candidate(spark, sf_dir):
    return L.titles(boxes(spark, sf_dir))


@_query(f"{USED}, {median_sql('used')} SELECT doc_id, page, med AS median FROM med")
def median_font(spark, sf_dir):
    return P.page_structures(boxes(spark, sf_dir), "median").select("doc_id", "page", "median")


@_query(f"SELECT doc_id, page, {ENVELOPE} FROM boxes GROUP BY doc_id, page")
def bbox_envelope(spark, sf_dir):
    return L.envelopes(boxes(spark, sf_dir), "doc_id", "page")


@_query("SELECT doc_id, page, seq, (x1 - x0 >= 0.58 OR (x0 < 0.46 AND x1 > 0.46)) AS full_width, x1 - x0 >= 0.45 AS wide, (x0 + x1) / 2 < 0.5 AS is_left FROM boxes")
def column_classes(spark, sf_dir):
    return boxes(spark, sf_dir).select("doc_id", "page", "seq", S.is_full_width().alias("full_width"), S.is_wide_prose().alias("wide"), S.is_left().alias("is_left"))


HEADINGS = f"{median_sql()}, heads AS (SELECT b.doc_id, b.page, seq, text, CASE WHEN NOT (length(text) <= 140 AND font_size >= 1.15 * med AND regexp_matches(text, '[A-Za-z]')) THEN 0 WHEN regexp_matches(text, '^[A-Z][0-9]+\\.') THEN 2 ELSE 1 END AS level FROM boxes b JOIN med m ON b.doc_id = m.doc_id AND b.page = m.page)"


def _headings(b: DataFrame) -> DataFrame:
    return L.with_median(b).withColumn("level", S.heading_level(F.col("median"))).filter("level > 0")


@_query(f"{HEADINGS} SELECT doc_id, seq, text, CAST(level AS INT) AS level FROM heads WHERE level > 0")
def heading_kind(spark, sf_dir):
    return _headings(boxes(spark, sf_dir)).select("doc_id", "seq", "text", F.col("level").cast("int").alias("level"))


@_query(
    f"""{HEADINGS}, t AS (SELECT *, sum((level = 1)::INT) OVER (PARTITION BY doc_id ORDER BY seq) AS top, row_number() OVER (PARTITION BY doc_id ORDER BY seq) + 2 AS n FROM heads WHERE level > 0)
    SELECT doc_id, seq, CAST(level AS INT) AS level, printf('title-%06d', n) AS title_id, CASE WHEN level = 2 AND top > 0 THEN printf('sec-%06d', top::BIGINT) END AS parent, top::BIGINT AS top,
    CASE WHEN level = 2 THEN sum((level = 2)::INT) OVER (PARTITION BY doc_id, top ORDER BY seq) ELSE 0 END::BIGINT AS sub FROM t"""
)
def section_nesting(spark, sf_dir):
    out = L.sections(_headings(boxes(spark, sf_dir)))
    return out.withColumn("level", F.col("level").cast("int")).withColumn("sub", F.col("sub").cast("long"))


@_query(f"SELECT doc_id, seq, {WORDS}::INT AS words, {SIGNALS}::INT AS signals, {SEED} AS seed, {FRAGMENT} AS fragment, ({WORDS} = 0 AND ({SIGNALS} > 0 OR {SHORT})) AS quality_fragment FROM boxes")
def math_fragments(spark, sf_dir):
    return boxes(spark, sf_dir).select("doc_id", "seq", S.natural_words().alias("words"), S.math_signals().alias("signals"), S.is_math_seed().alias("seed"), S.is_formula_fragment().alias("fragment"), S.is_quality_fragment().alias("quality_fragment"))


@_query(
    f"""{FIGURES}, {TABLES}, r AS (SELECT doc_id, page, 'graphic' AS kind, start_seq, x0, y0, x1, y1 FROM graphics UNION ALL SELECT doc_id, page, 'table', start_seq, x0, y0, x1, y1 FROM tables)
    SELECT a.doc_id, a.page, kind, start_seq, b.seq AS b_seq, round({overlap_sql('a', 'b')}, 9) AS area FROM r a JOIN boxes b ON a.doc_id = b.doc_id AND a.page = b.page WHERE {overlap_sql('a', 'b')} > 0"""
)
def spatial_overlap_join(spark, sf_dir):
    b = boxes(spark, sf_dir)
    found = L.overlapping(L.regions(b), b.select("doc_id", "page", "seq", *L.BOX))
    return found.select("doc_id", "page", F.col("a_kind").alias("kind"), F.col("a_start_seq").alias("start_seq"), "b_seq", F.round("area", 9).alias("area"))


@_query(
    f"""{FIGURES}, {TABLES}, r AS (SELECT doc_id, page, x0, y0, x1, y1 FROM graphics UNION ALL SELECT doc_id, page, x0, y0, x1, y1 FROM fb UNION ALL SELECT doc_id, page, x0, y0, x1, y1 FROM tables)
    SELECT doc_id, page, seq FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = b.doc_id AND r.page = b.page AND (b.x1 - b.x0) * (b.y1 - b.y0) > 0 AND {overlap_sql('b', 'r')} / ((b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.2)"""
)
def excluded_regions(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return L.without_regions(b, L.math_exclusions(b)).select("doc_id", "page", "seq")


@_query(
    f"""{USED}, {median_sql('used')}, m AS (SELECT b.*, med FROM boxes b JOIN med ON b.doc_id = med.doc_id AND b.page = med.page), p AS (SELECT * FROM m WHERE font_size >= 0.85 * med AND {WORDS} >= 1)
    SELECT doc_id, page, seq FROM m WHERE font_size < 0.8 * med AND EXISTS (SELECT 1 FROM p WHERE p.doc_id = m.doc_id AND p.page = m.page AND p.seq <> m.seq AND m.y0 < p.y1 AND p.y0 < m.y1)"""
)
def overlay_math(spark, sf_dir):
    return P.each_of(P.page_structures(boxes(spark, sf_dir), "beside"), "beside", "seq").select("doc_id", "page", "seq")


FRONT = f"""{TITLE}, label AS (SELECT doc_id, y0 AS abstract_top, y1 AS abstract_bottom FROM (SELECT *, row_number() OVER (PARTITION BY doc_id {BY_ROW}) AS n FROM boxes WHERE page = 1 AND lower(trim(text)) = 'abstract') WHERE n = 1),
    f0 AS (SELECT t.doc_id, title_bottom, title_font, coalesce(abstract_top, 0.7) AS abstract_top, abstract_bottom FROM title t LEFT JOIN label l ON t.doc_id = l.doc_id),
    al0 AS (SELECT b.*, max(font_size) OVER (PARTITION BY b.doc_id) AS author_font FROM boxes b JOIN f0 ON b.doc_id = f0.doc_id WHERE page = 1 AND title_bottom < y0 AND y0 < abstract_top AND NOT {STAMP} AND font_size >= greatest(10.5, title_font * 0.6) AND contains(text, ',')),
    al AS (SELECT * FROM al0 WHERE font_size >= author_font - 0.5), bottom AS (SELECT doc_id, max(y1) AS b FROM al GROUP BY doc_id),
    front AS (SELECT f0.*, b IS NOT NULL AS has_authors, coalesce(b, title_bottom) AS author_bottom FROM f0 LEFT JOIN bottom ON f0.doc_id = bottom.doc_id),
    mk AS (SELECT b.* FROM boxes b JOIN front f ON b.doc_id = f.doc_id WHERE page = 1 AND title_bottom < y0 AND y0 <= author_bottom + 0.012 AND regexp_full_match(trim(text), '[0-9,†]+')),
    an0 AS (SELECT doc_id, page, seq, text, x0, x1, y0, string_split(text, ',') AS p FROM al), an1 AS (SELECT *, unnest(range(len(p))) AS part FROM an0),
    an2 AS (SELECT *, p[part + 1] AS raw, length(array_to_string(p[1:part], ',')) + (part > 0)::INT AS lead FROM an1), an3 AS (SELECT *, trim(raw) AS name, lead + length(raw) - length(ltrim(raw)) AS before, x1 - x0 AS w, length(text) AS n FROM an2 WHERE regexp_matches(raw, '[A-Za-z]')),
    names AS (SELECT doc_id, page, seq, (row_number() OVER (PARTITION BY doc_id, seq ORDER BY part) - 1)::INT AS nth, name, round(x0 + w * before / n, 6) AS x0, round(x0 + w * (before + length(name)) / n, 6) AS x1, y0 FROM an3)"""


@_query(f"{FRONT} SELECT doc_id, title_bottom, title_font, abstract_top, abstract_bottom, has_authors, author_bottom FROM front")
def front_matter(spark, sf_dir):
    return L.front_matter(boxes(spark, sf_dir)).select("doc_id", "title_bottom", "title_font", "abstract_top", "abstract_bottom", F.col("author_font").isNotNull().alias("has_authors"), "author_bottom")


@_query(f"{FRONT} SELECT doc_id, seq, 'author' AS kind, text FROM al UNION ALL SELECT doc_id, seq, 'marker', text FROM mk")
def author_lines(spark, sf_dir):
    return L.front_lines(boxes(spark, sf_dir))


@_query(
    f"""{FRONT}, c0 AS (SELECT n.doc_id, n.page, n.seq, nth, n.x0, n.x1, m.seq AS marker_seq, m.text AS marker, m.x0 AS m_x0, m.y0 AS m_y0, (m.x0 + m.x1) / 2 AS centre, row_number() OVER (PARTITION BY n.doc_id, n.seq, nth ORDER BY m.x0, m.seq) AS m_rank,
      count(*) OVER (PARTITION BY n.doc_id, n.seq, nth) AS n_markers FROM names n JOIN mk m ON n.doc_id = m.doc_id AND n.page = m.page WHERE abs(m.y0 - n.y0) < 0.015),
    c1 AS (SELECT c0.*, k FROM c0 JOIN (SELECT doc_id, seq, count(*) AS k FROM names GROUP BY doc_id, seq) q ON c0.doc_id = q.doc_id AND c0.seq = q.seq),
    c2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seq, nth ORDER BY abs(m_x0 - x1), m_y0, m_x0, marker_seq) AS r FROM c1 WHERE CASE WHEN n_markers = k THEN m_rank = nth + 1 ELSE centre >= x0 - 0.015 AND centre <= x1 + 0.035 END)
    SELECT doc_id, page, seq, nth, marker_seq, marker FROM c2 WHERE r = 1"""
)
def nearest_marker(spark, sf_dir):
    b = boxes(spark, sf_dir)
    front = L.front_matter(b)
    return L.nearest_markers(L.authors(L.author_lines(b, front)), L.author_markers(b, front))


@_query(
    """o AS (SELECT *, max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM boxes),
    s AS (SELECT *, sum(CASE WHEN low IS NULL OR y0 - low > 0.018 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, seq ROWS UNBOUNDED PRECEDING) AS island FROM o)
    SELECT doc_id, page, island::BIGINT AS island, count(*) AS n, min(seq) AS first_seq FROM s GROUP BY doc_id, page, island"""
)
def paragraph_islands(spark, sf_dir):
    return L.gap_islands(boxes(spark, sf_dir), 0.018).groupBy("doc_id", "page", "island").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@_query(f"{TABLES} SELECT * FROM tables")
def table_extent(spark, sf_dir):
    return L.table_regions(boxes(spark, sf_dir))


def fold_sql(texts: str) -> str:
    return f"list_reduce({texts}, lambda a, x: {join_sql('a', 'x')})"


@_query(
    f"""{READING}, h AS (SELECT *, lower(trim(text)) = 'references' AS head, row_number() OVER (PARTITION BY doc_id, page {BY_ROW}) AS row FROM ro),
    h1 AS (SELECT *, page * 1000000 + CASE WHEN bool_or(head) OVER (PARTITION BY doc_id, page) THEN row ELSE reading_order END AS place, bool_or(head) OVER (PARTITION BY doc_id) AS has_head FROM h),
    h2 AS (SELECT *, CASE WHEN has_head THEN sum(head::INT) OVER (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING) ELSE 1 END AS begun FROM h1),
    r AS (SELECT *, sum(regexp_matches(text, '^\\[[0-9]+\\]')::INT) OVER (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS reference FROM h2 WHERE begun > 0 AND NOT head),
    g AS (SELECT doc_id, reference::BIGINT AS reference, count(*) AS n_lines, list(text ORDER BY place, seq) AS texts FROM r WHERE reference > 0 GROUP BY doc_id, reference)
    SELECT doc_id, reference, regexp_extract(texts[1], '^\\[([0-9]+)\\]', 1) AS label, n_lines, {fold_sql('texts')} AS text FROM g"""
)
def reference_groups(spark, sf_dir):
    return L.reference_groups(boxes(spark, sf_dir))


@_query(f"{FIGURES} SELECT doc_id, page, start_seq, {ENVELOPE} FROM fb GROUP BY doc_id, page, start_seq")
def figure_captions(spark, sf_dir):
    return L.figure_captions(boxes(spark, sf_dir))


@_query(f"{FIGURES} SELECT doc_id, page, start_seq, x0, y0, x1, y1 FROM graphics")
def figure_graphics(spark, sf_dir):
    return L.figure_graphics(boxes(spark, sf_dir))


@_query(f"{formulas_sql()} SELECT * FROM formulas")
def formula_clusters(spark, sf_dir):
    return L.formula_clusters(boxes(spark, sf_dir))


@_query(
    f"""{FRONT}, l AS (SELECT b.*, row_number() OVER (PARTITION BY b.doc_id {BY_ROW}) AS n FROM boxes b JOIN front f ON b.doc_id = f.doc_id WHERE page = 1 AND has_authors AND author_bottom < y0 AND y0 < abstract_top AND NOT {STAMP} AND font_size BETWEEN 8.5 AND 11.5 AND NOT starts_with(text, '†')),
    a AS (SELECT *, sum((n = 1 OR regexp_matches(text, '^[1-9][0-9]?\\s+[A-Z]'))::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS affiliation FROM l),
    g AS (SELECT doc_id, affiliation::BIGINT AS affiliation, count(*) AS n_lines, list(text ORDER BY n) AS texts FROM a GROUP BY doc_id, affiliation)
    SELECT doc_id, affiliation, regexp_extract(texts[1], '^([0-9]+)\\s*(.*)$', 1) AS label, {fold_sql('texts')} AS text, n_lines FROM g"""
)
def affiliation_split(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return L.affiliations(L.affiliation_lines(b, L.front_matter(b)))


@_query(f"{FRONT} SELECT doc_id, seq, nth, trim(regexp_replace(name, '[^\\s]+$', '')) AS given, regexp_extract(name, '([^\\s]+)$', 1) AS surname, x0, x1 FROM names")
def author_slices(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return L.authors(L.author_lines(b, L.front_matter(b))).select("doc_id", "seq", "nth", "given", "surname", "x0", "x1")


@_query(
    f"""{FRONT}, last AS (SELECT b.doc_id, arg_max(font_size, (y0, x0, seq)) AS lf, arg_max(y1, (y0, x0, seq)) AS ly FROM boxes b JOIN front f ON b.doc_id = f.doc_id WHERE page = 1 AND NOT {PAGE_NUMBER} AND y0 > abstract_bottom GROUP BY b.doc_id),
    s AS (SELECT b.*, lf, lag(y1) OVER w AS py, lag(font_size) OVER w AS pf FROM boxes b JOIN last ON b.doc_id = last.doc_id WHERE page = 2 AND ly > 0.68 AND NOT {STAMP} AND NOT {PAGE_NUMBER} WINDOW w AS (PARTITION BY b.doc_id {BY_ROW})),
    g AS (SELECT *, sum((coalesce(y0 - py > 0.025, false) OR abs(font_size - coalesce(pf, lf)) > 1)::INT) OVER (PARTITION BY doc_id {BY_ROW} ROWS UNBOUNDED PRECEDING) AS stops FROM s)
    SELECT doc_id, count(*) AS n_lines, max(seq) AS last_seq FROM g WHERE stops = 0 GROUP BY doc_id"""
)
def abstract_continuation(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return L.abstract_continuation(b, L.front_matter(b))


def _said(kind: str) -> str:
    return ", ".join("'" + x + "'" for x in L.REASONS[kind])


OMISSIONS = f"""{USED}, {median_sql('used')}, {READING}, p AS (SELECT b.*, med FROM boxes b JOIN med ON b.doc_id = med.doc_id AND b.page = med.page WHERE font_size >= 0.85 * med AND {WORDS} >= 1),
    rest AS (SELECT r.*, (font_size < 0.8 * med AND EXISTS (SELECT 1 FROM p WHERE p.doc_id = r.doc_id AND p.page = r.page AND p.seq <> r.seq AND r.y0 < p.y1 AND p.y0 < r.y1)) AS beside FROM ro r JOIN med ON r.doc_id = med.doc_id AND r.page = med.page WHERE (r.doc_id, r.seq) NOT IN (SELECT doc_id, seq FROM used)),
    u AS (SELECT doc_id, page, start_seq AS seq, 0 AS turn, start_seq AS place, {_said('table').replace(', ', ' AS type, ', 1)} AS reason FROM tables UNION ALL SELECT doc_id, page, seed, 1, seed, {_said('formula')} FROM formulas
    UNION ALL SELECT doc_id, page, seq, 2, reading_order, {_said('page-number')} FROM rest WHERE {PAGE_NUMBER} UNION ALL SELECT doc_id, page, seq, 2, reading_order, {_said('stamp')} FROM rest WHERE {STAMP} AND NOT {PAGE_NUMBER}
    UNION ALL SELECT doc_id, page, seq, 2, reading_order, {_said('fragment')} FROM rest WHERE (beside OR {FRAGMENT}) AND NOT {PAGE_NUMBER} AND NOT {STAMP}),
    omissions AS (SELECT doc_id, page, seq, type, reason, printf('omit-%06d', row_number() OVER (PARTITION BY doc_id ORDER BY turn, page, place, seq)) AS id FROM u)"""


@_query(f"{OMISSIONS} SELECT * FROM omissions")
def omission_union(spark, sf_dir):
    return L.omissions(boxes(spark, sf_dir))


@_query(f"{OMISSIONS} SELECT type, reason, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM omissions GROUP BY type, reason")
def omission_counts(spark, sf_dir):
    return L.omissions(boxes(spark, sf_dir)).groupBy("type", "reason").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@_query(f"{USED} SELECT doc_id, page, seq, kind FROM used")
def consumed_union(spark, sf_dir):
    return L.consumed(boxes(spark, sf_dir))
