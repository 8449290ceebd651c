"""Operators over positioned boxes: reading order, joins by place, islands of lines, grouping.

All are DataFrame to DataFrame, keyed by doc_id (and page); ties fall back to `seq`, the order of extraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliomill.functions import scalars as S
from foliomill.operators import pages as P

PAGE = ["doc_id", "page"]
BOX = ["x0", "y0", "x1", "y1"]


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def reading_order(boxes: DataFrame) -> DataFrame:
    """Full-width boxes part a page into bands, each read left column first; pages with a sparse column, or where 0.35 of all boxes are wide, are read by row."""
    b = boxes.withColumns({"full": _flag(S.is_full_width()), "wide": _flag(S.is_wide_prose()), "side": _flag(~S.is_left()), "ry": F.round("y0", 4)})
    page = Window.partitionBy(*PAGE)
    narrow = F.col("full") == 0
    b = b.withColumns({"n_left": F.sum(_flag(narrow & (F.col("side") == 0))).over(page), "n_right": F.sum(_flag(narrow & (F.col("side") == 1))).over(page),
                       "n_wide": F.sum("wide").over(page), "n_all": F.count("*").over(page)})
    plain = (F.col("n_left") < 2) | (F.col("n_right") < 2) | (F.col("n_wide") >= 0.35 * F.col("n_all"))
    rows = Window.partitionBy(*PAGE).orderBy("ry", "x0", "seq")
    b = b.withColumns({"plain": plain, "band": F.sum("full").over(rows.rowsBetween(Window.unboundedPreceding, 0))})
    keys = [F.when(F.col("plain"), 0).otherwise(F.col("band")), F.when(F.col("plain"), 0).otherwise(1 - F.col("full")), F.when(F.col("plain"), 0).otherwise(F.col("side")), F.col("ry"), F.col("x0"), F.col("seq")]
    return b.withColumn("reading_order", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*keys))).select(*boxes.columns, "reading_order")


def median_fonts(boxes: DataFrame, consumed: DataFrame | None = None) -> DataFrame:
    """A2: each page's exact median of fonts of at least 8, else 10; page numbers and consumed boxes (doc_id, seq) do not count."""
    left = boxes if consumed is None else boxes.join(consumed.select("doc_id", "seq"), ["doc_id", "seq"], "left_anti")
    fonts = left.filter((F.col("font_size") >= 8) & ~S.is_page_number()).groupBy(*PAGE).agg(F.median("font_size").alias("median"))
    return boxes.select(*PAGE).distinct().join(fonts, PAGE, "left").select(*PAGE, F.coalesce("median", F.lit(10.0)).alias("median"))


def with_median(boxes: DataFrame) -> DataFrame:
    return boxes.join(median_fonts(boxes), PAGE)


def envelopes(boxes: DataFrame, *keys: str) -> DataFrame:
    """A1, A3, H6: bounding box of each group, clamped, with the mean confidence."""
    made = [S.clamped(F.min("x0")).alias("x0"), S.clamped(F.min("y0")).alias("y0"), S.clamped(F.max("x1")).alias("x1"), S.clamped(F.max("y1")).alias("y1")]
    return boxes.groupBy(*keys).agg(*made, F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("confidence"), F.count("*").alias("n_boxes"))


def titles(boxes: DataFrame) -> DataFrame:
    """The best candidate above 0.45 of the first page by (font, width, nearness to the middle, height); else the largest font, longest text."""
    first = boxes.filter("page = 1")
    centre = F.abs((F.col("x0") + F.col("x1")) / 2 - 0.5)
    good = S.is_title_candidate() & (F.col("y0") < 0.45)
    score = F.struct(_flag(good).alias("g"), F.col("font_size").alias("f"), F.when(good, S.width()).otherwise(F.length("text").cast("double")).alias("w"),
                     F.when(good, -centre).otherwise(0.0).alias("c"), F.when(good, -F.col("y0")).otherwise(0.0).alias("y"), (-F.col("seq")).alias("s"))
    return first.groupBy("doc_id").agg(F.max_by(F.struct("seq", "text"), score).alias("t")).select("doc_id", F.col("t.seq").alias("seq"), F.col("t.text").alias("title"))


def _as(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("doc_id", "page", *[F.col(c).alias(prefix + c) for c in df.columns if c not in PAGE])


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of boxes of one page that share area, with the area (a_ and b_ columns)."""
    area = S.overlap([F.col("a_" + c) for c in BOX], [F.col("b_" + c) for c in BOX])
    return _as(left, "a_").join(_as(right, "b_"), PAGE).withColumn("area", area).filter("area > 0")


def without_regions(boxes: DataFrame, regions: DataFrame, ratio: float = 0.2) -> DataFrame:
    """Boxes of which no region covers `ratio` or more."""
    r = regions.select(F.col("doc_id").alias("r_doc"), F.col("page").alias("r_page"), *[F.col(c).alias("r_" + c) for c in BOX])
    area = S.width() * S.height()
    covered = (area > 0) & (S.overlap([F.col(c) for c in BOX], [F.col("r_" + c) for c in BOX]) / area >= ratio)
    return boxes.join(r, (F.col("doc_id") == F.col("r_doc")) & (F.col("page") == F.col("r_page")) & covered, "left_anti")


def nearest_markers(names: DataFrame, markers: DataFrame) -> DataFrame:
    """The marker of each name (doc_id, page, seq of its line, nth, x0, x1, y0): that of the same rank where a line has as many
    markers as names, else the one nearest to the name's end of those whose centre lies from 0.015 before the name to 0.035 after it."""
    m = markers.select("doc_id", "page", F.col("seq").alias("marker_seq"), F.col("text").alias("marker"), F.col("x0").alias("m_x0"), F.col("x1").alias("m_x1"), F.col("y0").alias("m_y0"))
    line = ["doc_id", "page", "seq"]
    near = names.join(m, PAGE).filter(F.abs(F.col("m_y0") - F.col("y0")) < 0.015)
    ranked = Window.partitionBy(*line, "nth").orderBy("m_x0", "marker_seq")
    n_names = names.groupBy(*line).agg(F.count("*").alias("n_names"))
    rank = names.select(*line, "nth", F.row_number().over(Window.partitionBy(*line).orderBy("nth")).alias("rank"))
    near = near.withColumns({"m_rank": F.row_number().over(ranked), "n_markers": F.count("*").over(Window.partitionBy(*line, "nth"))}).join(n_names, line).join(rank, [*line, "nth"])
    centre = (F.col("m_x0") + F.col("m_x1")) / 2
    beside = (centre >= F.col("x0") - 0.015) & (centre <= F.col("x1") + 0.035)
    fits = F.when(F.col("n_markers") == F.col("n_names"), F.col("m_rank") == F.col("rank")).otherwise(beside)
    best = F.min_by(F.struct("marker_seq", "marker"), F.struct(F.abs(F.col("m_x0") - F.col("x1")), F.col("m_y0"), F.col("m_x0"), F.col("marker_seq"))).alias("m")
    return near.filter(fits).groupBy(*line, "nth").agg(best).select(*line, "nth", "m.marker_seq", "m.marker")


def gap_islands(boxes: DataFrame, gap: float) -> DataFrame:
    """Islands of boxes by row; a new one starts where the gap to the lowest bottom so far is over `gap`."""
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "seq")
    low = F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    b = boxes.withColumn("starts", F.when(low.isNull() | (F.col("y0") - low > gap), 1).otherwise(0))
    return b.withColumn("island", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def table_boxes(boxes: DataFrame) -> DataFrame:
    """The boxes of each table (start_seq)."""
    return P.rows_of(boxes, "tables", "start_seq")


def table_regions(boxes: DataFrame) -> DataFrame:
    """B3, F10."""
    return envelopes(table_boxes(boxes), "doc_id", "page", "start_seq")


def _texts(name: str = "text") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("at", "seq", name))), lambda x: x[name])


def _joined(texts: Column) -> Column:
    """The fold of joined_lines. What lies before the last blank of a text without a unit left to part stays as it is, whatever follows: only the rest
    is joined with the next line, so that the work grows with the texts and not with their square."""

    def step(a: Column, line: Column) -> Column:
        def parted(j: Column) -> Column:
            rest = F.when(S.has_joined_unit(j), j).otherwise(F.substring_index(j, " ", -1))
            return F.struct(F.concat(a["done"], F.left(j, F.length(j) - F.length(rest))).alias("done"), rest.alias("rest"))

        return P.bound(S.joined_lines(a["rest"], line), parted)

    begin = F.struct(F.lit("").alias("done"), F.element_at(texts, 1).alias("rest"))
    return F.aggregate(F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0))), begin, step, lambda a: F.concat(a["done"], a["rest"]))


def reference_groups(boxes: DataFrame) -> DataFrame:
    """Once references have begun (at a `References` heading, or where a document has none at its first `[n]`) each `[n]` starts a
    reference and all else continues the last one; boxes between the heading and the first `[n]` are left out. Texts are joined line by line."""
    heading = F.lower(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")) == "references"
    on_page = F.max(_flag(heading)).over(Window.partitionBy(*PAGE)) == 1
    b = reading_order(boxes).withColumns({"head": heading, "row": F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "seq")), "by_row": on_page})
    b = b.withColumn("at", F.col("page") * F.lit(1_000_000) + F.when(F.col("by_row"), F.col("row")).otherwise(F.col("reading_order")))
    b = b.withColumn("has_head", F.max(_flag(F.col("head"))).over(Window.partitionBy("doc_id")))
    order = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.when(F.col("has_head") == 1, F.sum(_flag(F.col("head"))).over(order)).otherwise(1)
    b = b.withColumn("begun", begun).filter((F.col("begun") > 0) & ~F.col("head"))
    b = b.withColumn("reference", F.sum(_flag(S.is_reference_start())).over(order)).filter("reference > 0")
    label = S.labelled(F.element_at(F.col("texts"), 1), "reference")[0]
    made = b.groupBy("doc_id", "reference").agg(F.count("*").alias("n_lines"), _texts().alias("texts"))
    return made.select("doc_id", "reference", label.alias("label"), "n_lines", _joined(F.col("texts")).alias("text"))


def figure_boxes(boxes: DataFrame) -> DataFrame:
    """The caption boxes of each figure (start_seq), with the least y0 of the boxes above it (`top`)."""
    return P.rows_of(boxes, "figures", "start_seq", "s_y0", "top")


def figure_captions(boxes: DataFrame) -> DataFrame:
    return envelopes(figure_boxes(boxes), "doc_id", "page", "start_seq")


def figure_graphics(boxes: DataFrame) -> DataFrame:
    """B2: the region of each figure above its caption."""
    g = P.each_of(P.page_structures(boxes, "figures"), "figures", "f")
    return g.select(*PAGE, "f.start_seq", P.graphic(F.col("f.top"), F.col("f.s_y0")).alias("g")).select(*PAGE, "start_seq", "g.*")


def formula_boxes(boxes: DataFrame, *, outside: bool = False) -> DataFrame:
    """The boxes of each formula (seed); `outside`: of those outside figures and tables."""
    return P.rows_of(boxes, "formulas" if outside else "open_formulas", "seed")


def formula_clusters(boxes: DataFrame, *, outside: bool = False) -> DataFrame:
    return envelopes(formula_boxes(boxes, outside=outside), "doc_id", "page", "seed")


def regions(boxes: DataFrame) -> DataFrame:
    """(doc_id, page, kind, start_seq, x0, y0, x1, y1): the tables and the graphics of figures."""
    named = F.concat(
        F.transform("tables", lambda t: F.struct(F.lit("table").alias("kind"), t["start_seq"].alias("start_seq"), P.envelope(t["rows"]).alias("at"))),
        F.transform("figures", lambda f: F.struct(F.lit("graphic").alias("kind"), f["start_seq"].alias("start_seq"), P.graphic(f["top"], f["s_y0"]).alias("at"))),
    )
    found = P.page_structures(boxes, "figures", "tables").withColumn("named", named)
    return P.each_of(found, "named", "r").select(*PAGE, "r.kind", "r.start_seq", "r.at.*")


def math_exclusions(boxes: DataFrame) -> DataFrame:
    """Regions in which no formula is sought: graphics, caption boxes and tables."""
    return P.each_of(P.page_structures(boxes, "regions"), "regions", "r").select(*PAGE, "r.*")


def consumed(boxes: DataFrame) -> DataFrame:
    """U4: (doc_id, page, seq, kind) of the boxes that the title, figures (captions and what their graphics touch), tables and formulas use up."""
    return P.each_of(P.page_structures(boxes, "used"), "used", "u").select(*PAGE, "u.*")


def sections(headings: DataFrame) -> DataFrame:
    """Level-2 headings lie under the last level-1 heading before them; ids count up by level."""
    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    top = F.sum(_flag(F.col("level") == 1)).over(order)
    sub = F.sum(_flag(F.col("level") == 2)).over(Window.partitionBy("doc_id", "top").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    h = headings.withColumn("top", top).withColumn("sub", sub)
    parent = F.when((F.col("level") == 2) & (F.col("top") > 0), F.format_string("sec-%06d", F.col("top")))
    title = F.format_string("title-%06d", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) + 2)
    return h.select("doc_id", "seq", "level", title.alias("title_id"), parent.alias("parent"), "top", F.when(F.col("level") == 2, F.col("sub")).otherwise(0).alias("sub"))


def _fronts(boxes: DataFrame) -> DataFrame:
    """A row for each document with a first page: the values of front_matter, and `lines` and `markers` (arrays of seq, text, y1, font_size).

    The first page's boxes are gathered once, by document, with the texts of possible author lines and markers alone; all else is told from that array.
    """
    flags = {
        "names": (F.col("font_size") >= 10.5) & ~S.is_stamp() & F.contains("text", F.lit(",")), "marks": F.trim("text").rlike("^[0-9,†]+$"), "label": F.lower(F.trim("text")) == "abstract",
        "titles": S.is_title_candidate(), "n_chars": F.length("text"),
    }
    first = boxes.filter("page = 1").withColumns({k: F.coalesce(c, F.lit(0) if k == "n_chars" else F.lit(False)) for k, c in flags.items()})
    first = first.withColumn("text", F.when(F.col("names") | F.col("marks"), F.col("text")))
    d = first.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "text", *BOX, "font_size", *flags)).alias("boxes"))
    d = d.withColumn("title", P.title_of(F.col("boxes")))
    d = d.withColumn("title", F.element_at(F.filter("boxes", lambda x: x["seq"] == F.col("title")), 1))
    d = d.withColumn("label", F.array_min(F.transform(F.filter("boxes", lambda x: x["label"]), lambda x: F.struct(*[x[c].alias(c) for c in ("y0", "x0", "seq", "y1")]))))
    d = d.select("doc_id", "boxes", F.col("title.y1").alias("title_bottom"), F.col("title.font_size").alias("title_font"), F.coalesce("label.y0", F.lit(0.7)).alias("abstract_top"), F.col("label.y1").alias("abstract_bottom"))
    large = F.greatest(F.lit(10.5), F.col("title_font") * 0.6)
    d = d.withColumn("lines", F.filter("boxes", lambda x: x["names"] & (F.col("title_bottom") < x["y0"]) & (x["y0"] < F.col("abstract_top")) & (x["font_size"] >= large)))
    d = d.withColumn("author_font", F.array_max(F.transform("lines", lambda x: x["font_size"])))
    d = d.withColumn("lines", F.filter("lines", lambda x: x["font_size"] >= F.col("author_font") - 0.5))
    d = d.withColumn("author_bottom", F.coalesce(F.array_max(F.transform("lines", lambda x: x["y1"])), "title_bottom"))
    return d.withColumn("markers", F.filter("boxes", lambda x: x["marks"] & (F.col("title_bottom") < x["y0"]) & (x["y0"] <= F.col("author_bottom") + 0.012))).drop("boxes")


def front_matter(boxes: DataFrame) -> DataFrame:
    """B1: per document the title's bottom and font, the top of the abstract's label (0.7 without one), the author lines' font and bottom."""
    return _fronts(boxes).select("doc_id", "title_bottom", "title_font", "abstract_top", "abstract_bottom", "author_font", "author_bottom")


def front_lines(boxes: DataFrame) -> DataFrame:
    """(doc_id, seq, kind, text) of the author lines and the markers beside them."""

    def said(name: str, kind: str) -> Column:
        return F.transform(name, lambda x: F.struct(x["seq"].alias("seq"), F.lit(kind).alias("kind"), x["text"].alias("text")))

    each = _fronts(boxes).select("doc_id", F.explode_outer(F.concat(said("lines", "author"), said("markers", "marker"))).alias("x"))
    return each.filter("x IS NOT NULL").select("doc_id", "x.*")


def possible_author_lines(first: DataFrame, front: DataFrame) -> DataFrame:
    """F5 before the font of the largest: lines with a comma between title and abstract, not in a small font."""
    between = (F.col("title_bottom") < F.col("y0")) & (F.col("y0") < F.col("abstract_top"))
    large = F.col("font_size") >= F.greatest(F.lit(10.5), F.col("title_font") * 0.6)
    rows = first.join(front.select("doc_id", "title_bottom", "title_font", "abstract_top"), "doc_id")
    return rows.filter(between & ~S.is_stamp() & large & F.contains("text", F.lit(","))).select(*first.columns)


def author_lines(boxes: DataFrame, front: DataFrame) -> DataFrame:
    """F5, A16."""
    first = boxes.filter("page = 1")
    rows = possible_author_lines(first, front).join(front.select("doc_id", "author_font"), "doc_id")
    return rows.filter(F.col("font_size") >= F.col("author_font") - 0.5).select(*first.columns)


def author_markers(boxes: DataFrame, front: DataFrame) -> DataFrame:
    """boxes of digits, commas and daggers beside the author lines."""
    rows = boxes.filter("page = 1").join(front.select("doc_id", "title_bottom", "author_bottom"), "doc_id")
    beside = (F.col("title_bottom") < F.col("y0")) & (F.col("y0") <= F.col("author_bottom") + 0.012)
    return rows.filter(beside & F.trim("text").rlike("^[0-9,†]+$")).select(*boxes.columns)


def affiliation_lines(boxes: DataFrame, front: DataFrame) -> DataFrame:
    """lines between authors and abstract in a font of 8.5 to 11.5; notes that start with a dagger are none."""
    rows = boxes.filter("page = 1").join(front.filter("author_font IS NOT NULL").select("doc_id", "author_bottom", "abstract_top"), "doc_id")
    between = (F.col("author_bottom") < F.col("y0")) & (F.col("y0") < F.col("abstract_top"))
    return rows.filter(between & ~S.is_stamp() & F.col("font_size").between(8.5, 11.5) & ~F.col("text").startswith("†")).select(*boxes.columns)


def affiliations(lines: DataFrame) -> DataFrame:
    """Lines by place; one that starts with a number and a capital starts an affiliation, as the first line does; others continue it."""
    order = Window.partitionBy("doc_id").orderBy("y0", "x0", "seq")
    starts = (F.row_number().over(order) == 1) | F.col("text").rlike(r"(?U)^[1-9]\d?\s+[A-Z]")
    rows = lines.withColumns({"starts": _flag(starts), "at": F.row_number().over(order)})
    rows = rows.withColumn("affiliation", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    made = rows.groupBy("doc_id", "affiliation").agg(F.count("*").alias("n_lines"), _texts().alias("texts"))
    text = _joined(F.col("texts"))
    return made.select("doc_id", "affiliation", S.labelled(F.element_at("texts", 1), "affiliation")[0].alias("label"), text.alias("text"), "n_lines")


def authors(lines: DataFrame) -> DataFrame:
    """The names of comma-separated lines that hold a letter, without the white space around them, placed along the line in proportion to their characters."""
    parts = F.split("text", ",", -1)
    rows = lines.select("doc_id", "page", "seq", "text", "x0", "x1", "y0", "y1", F.posexplode(parts).alias("part", "raw"), parts.alias("parts")).filter(F.col("raw").rlike("[A-Za-z]"))
    name = F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")
    before = F.aggregate(F.slice("parts", 1, F.col("part")), F.lit(0), lambda a, x: a + F.length(x) + 1) + F.length("raw") - F.length(F.regexp_replace("raw", r"(?U)^\s+", ""))
    rows = rows.withColumns({"name": name, "before": before, "width": F.col("x1") - F.col("x0"), "n": F.length("text")})
    x0, x1 = S.clamped(F.col("x0") + F.col("width") * F.col("before") / F.col("n")), S.clamped(F.col("x0") + F.col("width") * (F.col("before") + F.length("name")) / F.col("n"))
    x1 = F.when(x1 <= x0, F.least(x0 + 0.000001, F.lit(1.0))).otherwise(x1)
    given, surname = S.name_parts(F.col("name"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "seq").orderBy("part")) - 1
    return rows.select("doc_id", "page", "seq", nth.alias("nth"), "name", given.alias("given"), surname.alias("surname"), x0.alias("x0"), x1.alias("x1"), "y0")


def abstract_continuation(boxes: DataFrame, front: DataFrame) -> DataFrame:
    """How far page 2 continues an abstract whose last box on page 1 ends below 0.68: until a gap over 0.025 or a font that differs
    from the box before by over 1; stamps and page numbers are passed over."""
    label = front.filter("abstract_bottom IS NOT NULL").select("doc_id", "abstract_bottom")
    rest = boxes.filter((F.col("page") == 1) & ~S.is_page_number()).join(label, "doc_id").filter(F.col("y0") > F.col("abstract_bottom"))
    last = rest.groupBy("doc_id").agg(F.max_by(F.struct("y1", "font_size"), F.struct("y0", "x0", "seq")).alias("l")).filter(F.col("l.y1") > 0.68).select("doc_id", F.col("l.font_size").alias("last_font"))
    second = boxes.filter((F.col("page") == 2) & ~S.is_stamp() & ~S.is_page_number()).join(last, "doc_id")
    order = Window.partitionBy("doc_id").orderBy("y0", "x0", "seq")
    gap = F.coalesce(F.col("y0") - F.lag("y1").over(order) > 0.025, F.lit(False))
    jump = F.abs(F.col("font_size") - F.coalesce(F.lag("font_size").over(order), F.col("last_font"))) > 1
    rows = second.withColumn("stop", _flag(gap | jump))
    rows = rows.withColumn("stops", F.sum("stop").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("stops = 0")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max("seq").alias("last_seq"))


#: The types and reasons of omissions.
REASONS = {
    "table": ("other", "Table detected, but reliable cell structure cannot yet be reconstructed."),
    "formula": ("other", "Detected display-math region; semantic formula recovery remains partial."),
    "page-number": ("page-number", "Printed page number is not canonical article content."),
    "stamp": ("page-header", "Repository side stamp is recorded as source metadata, not body text."),
    "fragment": ("other", "Isolated mathematical typesetting fragment cannot yet be reconstructed reliably."),
    "reference": ("other", "Reference continuation could not be assigned safely."),
}


def omissions(boxes: DataFrame) -> DataFrame:
    """Tables, formulas, then what no structure used: page numbers, stamps, fragments and small signs beside prose, numbered in that order."""
    rows = reading_order(P.tagged_boxes(boxes))
    single = F.when(S.is_page_number(), "page-number").when(S.is_stamp(), "stamp").when(F.col("beside") | S.is_formula_fragment(), "fragment")
    found = [("table", F.col("table"), 0, "seq"), ("formula", F.col("formula"), 1, "seq")]
    each = [F.when(on, F.struct(F.lit(kind).alias("kind"), F.lit(turn).alias("turn"), F.col(at).alias("at"))) for kind, on, turn, at in found]
    each.append(F.when((F.size("kinds") == 0) & single.isNotNull(), F.struct(single.alias("kind"), F.lit(2).alias("turn"), F.col("reading_order").alias("at"))))
    every = rows.select("doc_id", "page", "seq", F.explode(F.array_compact(F.array(*each))).alias("o")).select("doc_id", "page", "seq", "o.*")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("turn", "page", "at", "seq"))
    said = [F.element_at(F.create_map(*[x for k, v in REASONS.items() for x in (F.lit(k), F.lit(v[i]))]), F.col("kind")) for i in (0, 1)]
    return every.select("doc_id", "page", "seq", said[0].alias("type"), said[1].alias("reason"), F.format_string("omit-%06d", nth).alias("id"))
