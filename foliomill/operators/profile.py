"""The XML profile as a table of rules over nodes (V4). A node fires only the first rule of a pattern whose context it meets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values of the format -------------------------------------------------------------------------------------
TITLES = ("article-title", "subtitle", "title", "book-title", "book-subtitle", "journal-title", "journal-subtitle")
ADDRESSABLE = (
    *TITLES, "article-id", "book-id", "journal-id", "isbn", "issn", "contrib", "name", "collab", "aff", "pub-date", "abstract", "kwd", "funding-source", "license-p", "copyright-statement", "sec", "p", "list", "list-item",
    "disp-formula", "inline-formula", "caption", "td", "th", "fn", "ref", "boxed-text", "preformat", "supplementary-material", "book-part", "fig", "table-wrap",
)
PREFIXES = {
    "book-part": "part-[0-9]{4}", "sec": "sec-[0-9]{6}", **dict.fromkeys(TITLES, "title-[0-9]{6}"), "p": "p-[0-9]{6}", "list": "list-[0-9]{6}", "list-item": "li-[0-9]{6}", "disp-formula": "eq-[0-9]{6}",
    "inline-formula": "ineq-[0-9]{6}", "fig": "fig-[0-9]{6}", "caption": "caption-[0-9]{6}", "table-wrap": "tbl-[0-9]{6}", "td": "cell-[0-9]{6}", "th": "cell-[0-9]{6}", "fn": "fn-[0-9]{6}", "ref": "ref-[0-9]{6}",
    "supplementary-material": "supp-[0-9]{6}", "boxed-text": "quote-[0-9]{6}", "preformat": "code-[0-9]{6}",
}
XREFS = {"fig": ("fig",), "table": ("table-wrap",), "disp-formula": ("disp-formula",), "fn": ("fn",), "bibr": ("ref",), "sec": ("sec", "book-part")}
# ----------------------------------------------------------------------------------------------------------------------


def attr(name: str) -> Column:
    return F.coalesce(F.element_at("attrs", F.lit(name)), F.lit(""))


def _fail(df: DataFrame, rule: str, ok: Column, severity: str = "error") -> DataFrame:
    return df.filter(~F.coalesce(ok, F.lit(False))).select("package", "path", "line", "id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))


def violations(nodes: DataFrame) -> DataFrame:
    """(package, path, line, id, rule, severity)."""
    inside = nodes.filter("parent IS NOT NULL").groupBy("package", F.col("parent").alias("seq")).agg(F.collect_list("tag").alias("kids"), F.first(F.when(F.col("tag") == "tex-math", F.trim("full_text")), ignorenulls=True).alias("tex"))
    n = nodes.join(inside, ["package", "seq"], "left").withColumn("kids", F.coalesce("kids", F.array().cast("array<string>")))
    tag, kids, ident = F.col("tag"), F.col("kids"), F.col("id")
    has = lambda *names: F.arrays_overlap(kids, F.array(*[F.lit(x) for x in names]))
    every = lambda *names: F.size(F.array_intersect(kids, F.array(*[F.lit(x) for x in names]))) == len(names)
    out = []
    root = n.filter("depth = 0")
    out += [
        _fail(root, "root-name", tag.isin("article", "book")),
        _fail(root, "no-default-namespace", ~F.contains(tag, F.lit("|"))),
        _fail(root, "document-id", ident.rlike("^doc-[0-9]{6}$")),
        _fail(root, "document-language", F.trim(attr("xml:lang")) != ""),
        _fail(root.filter("tag = 'article'"), "jats-version", attr("dtd-version") == "1.3"),
        _fail(root.filter("tag = 'article'"), "article-structure", every("front", "body", "back")),
        _fail(root.filter("tag = 'book'"), "bits-version", attr("dtd-version") == "2.1"),
        _fail(root.filter("tag = 'book'"), "book-structure", every("book-meta", "book-body")),
    ]
    with_id = n.filter("id IS NOT NULL")
    twice = with_id.groupBy("package", "id").count().filter("count > 1").select("package", "id")
    out += [
        _fail(with_id, "id-lexical-form", ident.rlike("^[a-z][a-z0-9]*(-[a-z0-9]+)*$")),
        _fail(with_id.join(twice, ["package", "id"], "left_semi"), "id-unique", F.lit(False)),
        _fail(n.filter(ident.isNull() & tag.isin(*ADDRESSABLE)), "addressable-element-id", F.lit(False)),
    ]
    prefix = F.element_at(F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv]), tag)
    out.append(_fail(n.filter(prefix.isNotNull()), "id-prefix", F.regexp_like(ident, F.concat(F.lit("^"), prefix, F.lit("$")))))
    formula = n.filter("tag IN ('inline-formula', 'disp-formula')")
    tex = F.coalesce("tex", F.lit(""))
    out += [
        _fail(formula, "formula-tex", (F.size(F.filter(kids, lambda x: x == "tex-math")) == 1) & (tex != "")),
        _fail(formula, "formula-no-outer-delimiters", ~tex.rlike(r"^(\$|\\\(|\\\[)") & ~tex.rlike(r"(\$|\\\)|\\\])$")),
    ]
    fig, image = n.filter("tag = 'fig'"), F.col("attrs")["specific-use"]
    table = n.filter("tag = 'table-wrap'").withColumn("image_only", F.coalesce(image == "image-only", F.lit(False)))
    out += [
        _fail(fig, "figure-graphic", has("graphic")),
        _fail(fig, "figure-caption", has("caption")),
        _fail(_with_cells(table.filter("NOT image_only"), nodes), "structured-table", F.col("full_grid")),
        _fail(table.filter("image_only"), "image-table-graphic", has("graphic")),
        _fail(table.filter("image_only"), "image-table-warning", F.lit(False), "warning"),
    ]
    xref = n.filter("tag = 'xref'")
    out.append(_fail(xref, "xref-rid", F.trim(attr("rid")) != ""))
    token = xref.select("package", "path", "line", "id", attr("ref-type").alias("kind"), F.explode(F.split(F.trim(attr("rid")), r"\s+")).alias("rid")).filter("rid <> ''")
    target = nodes.filter("id IS NOT NULL").select("package", F.col("id").alias("rid"), F.col("tag").alias("hit"))
    seen = token.join(target, ["package", "rid"], "left").groupBy("package", "path", "line", "id", "kind", "rid").agg(F.collect_set("hit").alias("hits"))
    out.append(_fail(seen, "xref-target-exists", F.size("hits") > 0))
    for kind, tags in XREFS.items():
        out.append(_fail(seen.filter(F.col("kind") == kind), f"xref-{kind}", F.arrays_overlap("hits", F.array(*[F.lit(t) for t in tags]))))
    link = n.filter(tag.isin("graphic", "media") | ((tag == "supplementary-material") & F.element_at("attrs", F.lit("xlink:href")).isNotNull()))
    href = attr("xlink:href")
    out += [
        _fail(link, "resource-href", F.trim(href) != ""),
        _fail(link, "resource-relative", href.startswith("../assets/content/") & ~F.contains(F.expr("substring(coalesce(element_at(attrs, 'xlink:href'), ''), 4)"), F.lit("../"))),
    ]
    first, *rest = out
    for x in rest:
        first = first.unionByName(x)
    return first


def _with_cells(tables: DataFrame, nodes: DataFrame) -> DataFrame:
    """tables with full_grid: a table, a row and a cell lie below. Nodes below a node follow it until one of its depth comes."""
    last = nodes.select("package", F.col("seq").alias("s2"), F.col("depth").alias("d2"))
    ends = tables.join(last, "package").filter("s2 > seq AND d2 <= depth").groupBy("package", "seq").agg(F.min("s2").alias("stop"))
    below = tables.select("package", "seq").join(ends, ["package", "seq"], "left")
    inner = nodes.select("package", F.col("seq").alias("s3"), F.col("tag").alias("t3"))
    kinds = below.join(inner, "package").filter("s3 > seq AND (stop IS NULL OR s3 < stop)").groupBy("package", "seq").agg(F.collect_set("t3").alias("t"))
    full = F.array_contains("t", "table") & F.array_contains("t", "tr") & (F.array_contains("t", "td") | F.array_contains("t", "th"))
    return tables.join(kinds, ["package", "seq"], "left").withColumn("full_grid", F.coalesce(full, F.lit(False)))
