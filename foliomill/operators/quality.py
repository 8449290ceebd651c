"""The quality report of packages: 22 metrics in one pass over the nodes, texts against their candidates, criteria and status.

Nodes are rows of `packages.parsed`, elements hold element_id, sources (with candidates), revisions and resources. Everything is keyed by
`package`. Nodes that did not parse count nothing. Element ids are unique in a package: the validator says where they are not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions import scalars as S
from foliomill.operators import validation
from foliomill.operators.layout import REASONS
from foliomill.operators.profile import ADDRESSABLE
from foliomill.sources.packages import _flat

#: The names of the metrics and of the criteria.
METRICS = (
    "pages", "addressable_elements", "article_titles", "authors", "author_affiliation_xrefs", "equal_contribution_notes", "affiliations", "abstracts", "publication_dates", "body_sections", "body_paragraphs", "references", "figures", "tables", "formulas",
    "display_math_regions_omitted_with_evidence", "tables_omitted_with_evidence", "omissions", "page_number_omissions", "page_number_paragraphs", "short_fragment_paragraphs", "formula_only_paragraphs",
)
CRITERIA = ("package_integrity", "xml_provenance_consistency", "resource_integrity", "front_matter", "semantic_structure", "references", "figures_tables_formulas", "non_body_classification")
#: A failure of this code does not count against a package's integrity.
NOT_AUDITED = "page_coverage_not_audited"
SHARED, ALIKE = 0.9, 0.78


def node_metrics(nodes: DataFrame) -> DataFrame:
    """(package, counts of nodes, labels, fragments): one aggregate with a condition for each metric, over the node table as it is."""
    tag, trail = F.col("tag"), F.col("trail")
    in_body = F.contains(trail, F.lit("/body/"))
    p = (tag == "p") & in_body

    def below(path: str) -> Column:
        return trail.endswith("/" + path)

    fragment = p & (F.length("flat") <= 4) & ~F.col("flat").rlike("[A-Za-z]{2,}")
    counted = {
        "article_titles": tag == "article-title", "authors": (tag == "contrib") & (F.col("attrs")["contrib-type"] == "author"), "author_affiliation_xrefs": below("contrib/xref") & (F.col("attrs")["ref-type"] == "aff"),
        "equal_contribution_notes": below("author-notes/fn") & (F.col("attrs")["fn-type"] == "equal"), "affiliations": below("article-meta/aff"), "abstracts": below("article-meta/abstract"), "publication_dates": below("article-meta/pub-date"),
        "body_sections": (tag == "sec") & in_body, "body_paragraphs": p, "references": below("ref-list/ref"), "figures": tag == "fig", "tables": tag == "table-wrap", "formulas": tag.isin("disp-formula", "inline-formula"),
        "page_number_paragraphs": p & F.col("flat").rlike(r"(?U)^\d{1,4}$"), "short_fragment_paragraphs": fragment, "formula_only_paragraphs": p & S.is_quality_fragment("flat"),
    }
    label = below("ref/label") & F.col("own_text").rlike(r"^\d+$")
    labels = F.transform(F.array_sort(F.collect_list(F.when(label, F.struct("seq", F.expr("try_cast(own_text AS decimal(38,0))").alias("n"))))), lambda x: x["n"])
    fragments = F.transform(F.array_sort(F.collect_list(F.when(fragment, F.struct("seq", "flat")))), lambda x: x["flat"])
    return nodes.filter("error IS NULL").groupBy("package").agg(*[F.count_if(c).alias(k) for k, c in counted.items()], labels.alias("labels"), F.slice(fragments, 1, 10).alias("short_fragment_examples"))


def candidate_texts(sources: Column) -> Column:
    """A5: for each method of a record's candidates its texts, over all sources in their order, joined by blanks; null for a record without sources."""
    of_each = F.transform(sources, lambda s: F.transform(s["candidates"], lambda c: F.struct(F.coalesce(c["method"], F.lit("unknown")).alias("method"), c["text"].alias("text"))))
    every = F.filter(F.flatten(F.filter(of_each, lambda x: x.isNotNull())), lambda c: c["text"] != "")
    methods = F.array_distinct(F.transform(every, lambda c: c["method"]))
    return F.transform(methods, lambda m: F.array_join(F.transform(F.filter(every, lambda c: c["method"] == m), lambda c: c["text"]), " "))


def supports(final: str, candidate: str) -> bool:
    """Whether a candidate stands for the final text: one holds the other, they share 0.9 of the tokens at a like size, or they are alike to 0.78."""
    a, b = final.casefold(), candidate.casefold()
    if a in b or b in a:
        return True
    x, y = Counter(re.findall(r"\w+", a)), Counter(re.findall(r"\w+", b))
    n, m = x.total(), y.total()
    if (x & y).total() >= SHARED * max(n, 1) and m <= max(2 * n, n + 6):
        return True
    likeness = SequenceMatcher(None, a, b)  # its two cheap bounds come first
    return likeness.real_quick_ratio() >= ALIKE and likeness.quick_ratio() >= ALIKE and likeness.ratio() >= ALIKE


def _compact(text: str) -> str:
    return re.sub(r"[^\w]", "", text.casefold())


def agrees(final: str, candidates: Iterable[str], after: Iterable[str | None]) -> bool:
    """Whether a text is one that a revision states, or a candidate supports it. A text that is empty is not asked."""
    if any(_compact(_flat(x or "")) == _compact(final) for x in after):
        return True
    return not final or any(supports(final, _flat(c)) for c in candidates)


def consistency(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """(package, code, element_id): addressable nodes without a record, and such whose text neither candidates nor revisions support. Figures are not compared."""
    asked = nodes.filter(F.col("error").isNull() & F.col("id").isNotNull() & F.col("tag").isin(*ADDRESSABLE)).select("package", F.col("id").alias("element_id"), "tag", "spaced")
    revised = F.transform("revisions", lambda r: r["after"])
    records = elements.select("package", "element_id", F.lit(True).alias("known"), candidate_texts(F.col("sources")).alias("candidates"), revised.alias("after"))

    @F.pandas_udf("boolean")
    def fine(final: pd.Series, candidates: pd.Series, after: pd.Series) -> pd.Series:
        none: tuple = ()
        return pd.Series([f is None or agrees(f, none if c is None else c, none if a is None else a) for f, c, a in zip(final, candidates, after, strict=True)])

    # one join for both codes; what is not compared goes to the tasks as null
    both = asked.join(records, ["package", "element_id"], "left").withColumn("compared", F.col("known") & (F.col("tag") != "fig"))
    both = both.withColumn("fine", fine(F.when(F.col("compared"), F.col("spaced")), F.when(F.col("compared"), F.col("candidates")), F.when(F.col("compared"), F.col("after"))))
    code = F.when(F.col("known").isNull(), "provenance_missing").when(~F.col("fine"), "candidate_text_mismatch")
    return both.select("package", code.alias("code"), "element_id").filter("code IS NOT NULL")


def resource_findings(elements: DataFrame, files: DataFrame, facts: DataFrame) -> DataFrame:
    """(package, code, element_id): records' resources without a path, that can't be read, or that are images of another kind. facts: validation.png_facts of the files named."""
    used = elements.select("package", "element_id", F.explode("resources").alias("r")).select("package", "element_id", F.col("r.path").alias("path"))
    other = F.expr("hex(substring(content, 1, 3)) = 'FFD8FF' OR substring(content, 1, 4) IN (X'47494638', X'49492A00', X'4D4D002A') OR substring(content, 1, 2) = X'424D'")
    held = files.filter("kind = 'file'").select("package", "path", other.alias("other"))
    rows = used.join(held, ["package", "path"], "left").join(facts.select("package", "path", F.col("error").alias("fault"), F.lit(True).alias("read")), ["package", "path"], "left")
    code = F.when(F.col("path").isNull(), "resource_path_invalid").when(F.col("other"), "resource_not_png").when(F.col("read").isNull() | F.col("fault").isNotNull(), "resource_unreadable")
    return rows.withColumn("code", code).filter("code IS NOT NULL").select("package", "code", "element_id")


def quality_report(nodes: DataFrame, elements: DataFrame, omissions: DataFrame, pages: DataFrame, *, failures: DataFrame | None = None, resources: DataFrame | None = None) -> DataFrame:
    """(package, status, METRICS, CRITERIA, labels_consecutive, short_fragment_examples, findings), one row for each package that has
    nodes. failures (package, code) come from the validator, resources from resource_findings."""
    n = node_metrics(nodes)

    def reason(kind: str) -> Column:
        return F.count_if(F.col("reason") == REASONS[kind][1])

    left = omissions.groupBy("package").agg(F.count("*").alias("omissions"), F.count_if(F.col("type") == "page-number").alias("page_number_omissions"), reason("formula").alias("display_math_regions_omitted_with_evidence"), reason("table").alias("tables_omitted_with_evidence"))
    found = consistency(nodes, elements).withColumn("of", F.lit("xml_provenance_consistency"))
    if failures is not None:
        found = found.unionByName(failures.filter(F.col("code") != NOT_AUDITED).select("package", "code", F.lit(None).cast("string").alias("element_id"), F.lit("package_integrity").alias("of")))
    if resources is not None:
        found = found.unionByName(resources.withColumn("of", F.lit("resource_integrity")))
    said = found.groupBy("package").agg(F.array_sort(F.collect_list(F.struct("of", "code", "element_id"))).alias("findings"))
    out = n.join(elements.groupBy("package").agg(F.count("*").alias("addressable_elements")), "package", "left").join(pages.groupBy("package").agg(F.count("*").alias("pages")), "package", "left")
    out = out.join(left, "package", "left").join(said, "package", "left").na.fill(0, list(METRICS))
    findings = F.coalesce("findings", F.array().cast("array<struct<of:string,code:string,element_id:string>>"))
    consecutive = F.forall(F.transform("labels", lambda x, i: x.eqNullSafe(i + 1)), lambda x: x)
    out = out.withColumns({"findings": findings, "labels_consecutive": consecutive})

    def no(of: str) -> Column:
        return ~F.exists("findings", lambda f: f["of"] == of)

    plain = F.col("page_number_paragraphs") == 0
    good = {
        "package_integrity": no("package_integrity"), "xml_provenance_consistency": no("xml_provenance_consistency"), "resource_integrity": no("resource_integrity"),
        "front_matter": (F.col("article_titles") == 1) & (F.col("abstracts") == 1), "semantic_structure": (F.col("body_sections") >= 1) & (F.col("body_paragraphs") > 0) & plain & (F.col("formula_only_paragraphs") == 0),
        "references": (F.size("labels") > 0) & F.col("labels_consecutive"), "figures_tables_formulas": F.lit(True), "non_body_classification": plain,
    }
    best = {c: "passed" if i < 3 else "partial" for i, c in enumerate(CRITERIA)}
    # a criterion's name may be a metric's: criteria go by their own prefix
    out = out.withColumns({f"criterion_{c}": F.when(good[c], best[c]).otherwise("failed") for c in CRITERIA})
    failed = F.greatest(*[(F.col(f"criterion_{c}") == "failed").cast("int") for c in CRITERIA])
    status = F.when(failed == 1, "failed").otherwise("partial")
    return out.select("package", status.alias("status"), *METRICS, *[f"criterion_{c}" for c in CRITERIA], "labels_consecutive", "short_fragment_examples", "findings")


def of_packages(p: validation.Package) -> DataFrame:
    """The reports of packages that validation.load has read. A check whose engine is missing here says nothing about a package."""
    used = p.elements.select("package", F.explode("resources").alias("r")).select("package", F.col("r.path").alias("path")).distinct()
    facts = validation.png_facts(p.files.filter("kind = 'file'").join(used, ["package", "path"], "left_semi"))
    failures = validation.findings(p).filter((F.col("severity") == "error") & ~F.col("code").isin(*validation.OPERATIONAL))
    return quality_report(p.nodes, p.elements, p.omissions, p.pages, failures=failures, resources=resource_findings(p.elements, p.files, facts))
