"""What a page holds, told once: figures, tables, formulas, the title, fonts and small signs, as arrays beside the page's boxes.

Boxes are gathered by page, which is bounded by what fits on one, and everything else is higher-order functions over that array: one
scan and one shuffle, however many structures a query asks for. Arrays that a query does not ask for are not computed. Ties fall back
to `seq`, the order of extraction; boxes without text belong to no structure but a table, a caption or a formula that they lie in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions import scalars as S

PAGE = ["doc_id", "page"]
BOX = ["x0", "y0", "x1", "y1"]
Lambda = Callable[[Column], Column]


def bound(value: Column, body: Lambda) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _leading(rows: Column, stop: Callable[[Column, Column], Column], low: Callable[[Column, Column], Column]) -> Column:
    """The rows before the first that stops; `low` carries a number on from row to row, null before the first."""

    def step(a: Column, r: Column) -> Column:
        goes = a["open"] & ~_flag(stop(a["low"], r))
        return F.struct(F.when(goes, low(a["low"], r)).otherwise(a["low"]).alias("low"), (a["n"] + goes.cast("int")).alias("n"), goes.alias("open"))

    begin = F.struct(F.lit(None).cast("double").alias("low"), F.lit(0).alias("n"), F.lit(True).alias("open"))
    return F.slice(rows, F.lit(1), F.aggregate(rows, begin, step)["n"])


def _overlap(a: Column, b: Column) -> Column:
    return S.overlap([a[c] for c in BOX], [b[c] for c in BOX])


def envelope(rows: Column) -> Column:
    def end(name: str, pick: Callable[[Column], Column]) -> Column:
        return S.clamped(pick(F.transform(rows, lambda r: r[name]))).alias(name)

    return F.struct(end("x0", F.array_min), end("y0", F.array_min), end("x1", F.array_max), end("y1", F.array_max))


def _tables(b: Column) -> Column:
    """From the top of a `Table n` start on, until a font of 9.5 or more follows a gap over 0.015. One box alone is none."""

    def table(s: Column) -> Column:
        rows = F.filter(b, lambda x: x["y0"] >= s["y0"])
        taken = bound(rows, lambda r: _leading(r, lambda low, x: (x["font_size"] >= 9.5) & (x["y0"] - low > 0.015), lambda _, x: x["y1"]))
        return F.struct(s["seq"].alias("start_seq"), taken.alias("rows"))

    return F.filter(F.transform(F.filter(b, lambda x: x["starts_table"]), table), lambda t: F.size(t["rows"]) >= 2)


def _figures(b: Column) -> Column:
    """A `Fig. n` start above 0.6 after at least three boxes that end 0.005 above it (page numbers aside), and what continues it
    without a gap over 0.018. `top` is the least y0 of the boxes above."""

    def figure(s: Column) -> Column:
        above = F.transform(F.filter(b, lambda x: ~x["numbers"] & (x["y1"] < s["y0"] - 0.005)), lambda x: x["y0"])
        near = F.filter(b, lambda x: (s["y0"] - 0.002 <= x["y0"]) & (x["y1"] <= s["y0"] + 0.23) & (x["font_size"] <= s["font_size"] + 0.5) & (x["x0"] >= s["x0"] - 0.02))
        taken = bound(near, lambda r: _leading(r, lambda low, x: x["y0"] - low > 0.018, lambda low, x: F.greatest(low, x["y1"])))
        return bound(above, lambda a: F.struct(s["seq"].alias("start_seq"), s["y0"].alias("s_y0"), F.array_min(a).alias("top"), F.size(a).alias("n_above"), taken.alias("rows")))

    return F.filter(F.transform(F.filter(b, lambda x: x["starts_figure"]), figure), lambda f: f["n_above"] >= 3)


def graphic(top: Column, s_y0: Column) -> Column:
    """B2: the region above a caption that starts at s_y0."""
    y0, y1 = S.clamped(top - 0.01), S.clamped(s_y0 - 0.008)
    return F.struct(F.lit(0.14).alias("x0"), y0.alias("y0"), F.lit(0.86).alias("x1"), F.when(y1 <= y0, F.least(y0 + 0.000001, F.lit(1.0))).otherwise(y1).alias("y1"))


def _box(x: Column) -> Column:
    return F.struct(*[x[c].alias(c) for c in BOX])


def _regions(figures: Column, tables: Column) -> Column:
    """Regions in which no formula is sought: graphics, caption boxes and tables."""
    captions = F.flatten(F.transform(figures, lambda f: F.transform(f["rows"], _box)))
    return F.concat(F.transform(figures, lambda f: graphic(f["top"], f["s_y0"])), captions, F.transform(tables, lambda t: envelope(t["rows"])))


def _free(b: Column, regions: Column) -> Column:
    """The boxes of which no region covers 0.2 or more."""

    def covered(x: Column) -> Column:
        area = (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])
        return F.exists(regions, lambda r: (area > 0) & (_overlap(x, r) / area >= 0.2))

    return F.filter(b, lambda x: ~_flag(covered(x)))


def _formulas(b: Column) -> Column:
    """A seed and the boxes whose centre is within 0.018 of its own, with two words at most or a font under 0.85 of its own. One box
    alone is none. From the top down, a seed that an earlier formula holds starts none."""

    def formula(s: Column) -> Column:
        centre = (s["y0"] + s["y1"]) / 2
        near = F.filter(b, lambda x: (F.abs((x["y0"] + x["y1"]) / 2 - centre) <= 0.018) & ((x["words"] <= 2) | (x["font_size"] < 0.85 * s["font_size"])))
        return F.struct(s["seq"].alias("seed"), near.alias("rows"))

    held = F.filter(F.transform(F.filter(b, lambda x: x["seeds"]), formula), lambda f: F.size(f["rows"]) >= 2)

    def take(all_: Column) -> Column:
        def step(a: Column, f: Column) -> Column:
            more = F.struct(F.concat(a["used"], F.transform(f["rows"], lambda r: r["seq"])).alias("used"), F.concat(a["taken"], F.array(f["seed"])).alias("taken"))
            return F.when(F.array_contains(a["used"], f["seed"]), a).otherwise(more)

        seqs = F.transform(all_, lambda f: f["seed"])
        none = F.struct(F.slice(seqs, 1, 0).alias("used"), F.slice(seqs, 1, 0).alias("taken"))
        return bound(F.aggregate(all_, none, step)["taken"], lambda taken: F.filter(all_, lambda f: F.array_contains(taken, f["seed"])))

    return bound(held, take)


def title_of(b: Column) -> Column:
    """The best candidate above 0.45 by (font, width, nearness to the middle, height); else the largest font, longest text."""

    def rank(x: Column) -> Column:
        good = x["titles"] & (x["y0"] < 0.45)
        width = F.when(good, x["x1"] - x["x0"]).otherwise(x["n_chars"].cast("double"))
        centre = F.when(good, -F.abs((x["x0"] + x["x1"]) / 2 - 0.5)).otherwise(0.0)
        return F.struct(good.cast("int").alias("g"), x["font_size"].alias("f"), width.alias("w"), centre.alias("c"), F.when(good, -x["y0"]).otherwise(0.0).alias("y"), (-x["seq"]).alias("s"))

    return -F.array_max(F.transform(b, rank))["s"]


def _used(b: Column, page: Column, title: Column, figures: Column, tables: Column, formulas: Column) -> Column:
    """U4: (seq, kind) of what the title, figures (captions and what their graphics touch), tables and formulas use up."""

    def said(rows: Column, kind: str) -> Column:
        return F.transform(rows, lambda x: F.struct(x["seq"].alias("seq"), F.lit(kind).alias("kind")))

    def touched(f: Column) -> Column:
        return bound(graphic(f["top"], f["s_y0"]), lambda g: F.filter(b, lambda x: (x["y1"] < f["s_y0"] - 0.005) & ~x["numbers"] & (_overlap(x, g) > 0)))

    head = F.filter(b, lambda x: (page == 1) & (x["seq"] == title))
    rows = [said(head, "title")]
    rows += [said(F.flatten(F.transform(figures, f)), "figure") for f in (lambda f: f["rows"], touched)]
    rows += [said(F.flatten(F.transform(c, lambda x: x["rows"])), kind) for c, kind in ((tables, "table"), (formulas, "formula"))]
    return F.array_distinct(F.concat(*rows))


def _median(b: Column, used: Column) -> Column:
    """A2: the exact median of fonts of at least 8, else 10; page numbers and used boxes do not count."""
    left = F.filter(b, lambda x: (x["font_size"] >= 8) & ~x["numbers"] & ~F.exists(used, lambda u: u["seq"] == x["seq"]))
    fonts = F.sort_array(F.transform(left, lambda x: x["font_size"]))
    n = F.size(left)
    return bound(fonts, lambda f: F.when(n > 0, (F.get(f, ((n - 1) / 2).cast("int")) + F.get(f, (n / 2).cast("int"))) / 2).otherwise(10.0))


def _beside(b: Column, median: Column) -> Column:
    """The seqs of small boxes beside other prose of their page."""
    prose = F.filter(b, lambda x: (x["font_size"] >= 0.85 * median) & (x["words"] >= 1))
    small = F.filter(b, lambda x: x["font_size"] < 0.8 * median)
    found = bound(prose, lambda p: F.filter(small, lambda x: F.exists(p, lambda y: (x["seq"] != y["seq"]) & (x["y0"] < y["y1"]) & (y["y0"] < x["y1"]))))
    return F.transform(found, lambda x: x["seq"])


#: What each array of a page is made from.
NEEDS = {
    "regions": ("figures", "tables"), "free": ("regions",), "formulas": ("free",), "used": ("title", "figures", "tables", "formulas"), "median": ("used",), "beside": ("median",),
}


def page_structures(boxes: DataFrame, *wanted: str) -> DataFrame:
    """(doc_id, page, boxes, and those wanted of figures, tables, title, open_formulas, regions, free, formulas, used, median, beside), one row for
    each page. `open_formulas` are sought everywhere, `formulas` among the boxes that are `free` of figures and tables."""
    flags = {
        "numbers": _flag(S.is_page_number()), "starts_table": _flag(F.col("text").rlike(r"(?U)^Table\s+\d+\b")), "starts_figure": _flag(F.col("text").rlike(r"(?U)^Fig\.\s*\d+\b") & (F.col("y0") < 0.6)),
        "seeds": _flag(S.is_math_seed()), "words": F.coalesce(S.natural_words(), F.lit(0)), "titles": _flag(S.is_title_candidate()), "n_chars": F.coalesce(F.length("text"), F.lit(0)),
    }
    first = ["y0", "x0", "seq"]
    rest = [c for c in boxes.columns if c not in [*PAGE, *first]]
    pages = boxes.withColumns(flags).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*first, *rest, *flags))).alias("boxes"))
    b, c = F.col("boxes"), {x: F.col(x) for x in ("figures", "tables", "title", "regions", "free", "formulas", "used", "median", "page")}
    made: dict[str, Callable[[], Column]] = {
        "figures": lambda: _figures(b), "tables": lambda: _tables(b), "title": lambda: title_of(b), "open_formulas": lambda: _formulas(b), "regions": lambda: _regions(c["figures"], c["tables"]),
        "free": lambda: _free(b, c["regions"]), "formulas": lambda: _formulas(c["free"]), "used": lambda: _used(b, c["page"], c["title"], c["figures"], c["tables"], c["formulas"]),
        "median": lambda: _median(b, c["used"]), "beside": lambda: _beside(b, c["median"]),
    }
    asked, needed = list(wanted), set()
    while asked:
        needed.add(name := asked.pop())
        asked += NEEDS.get(name, ())
    for name, column in made.items():
        if name in needed:
            pages = pages.withColumn(name, column())
    return pages


def tagged_boxes(boxes: DataFrame) -> DataFrame:
    """boxes with the page's `median`, `kinds` (of the structures that use the box), `beside`, and whether it starts a `table`, a `figure` or a `formula`."""
    seq = F.col("box.seq")

    def among(column: str, field: str) -> Column:
        return F.exists(column, lambda x: x[field] == seq)

    kinds = F.transform(F.filter("used", lambda u: u["seq"] == seq), lambda u: u["kind"])
    tags = [F.col("median"), kinds.alias("kinds"), F.array_contains("beside", seq).alias("beside"), among("tables", "start_seq").alias("table"), among("figures", "start_seq").alias("figure"), among("formulas", "seed").alias("formula")]
    rows = page_structures(boxes, "beside").select(*PAGE, "used", "median", "beside", "tables", "figures", "formulas", F.explode_outer("boxes").alias("box"))
    return rows.select(*[F.col(c) if c in PAGE else F.col(f"box.{c}").alias(c) for c in boxes.columns], *tags)


def each_of(structures: DataFrame, column: str, name: str) -> DataFrame:
    """(doc_id, page, name) for each element of an array of page_structures. The outer form keeps the optimizer from adding a filter on the
    array's size, which it would push below all projections with their expressions written out again and again."""
    return structures.select(*PAGE, F.explode_outer(column).alias(name)).filter(F.col(name).isNotNull())


def rows_of(boxes: DataFrame, column: str, *fields: str) -> DataFrame:
    """The boxes of each figure, table or formula of `column`, with these fields of it."""
    each = each_of(page_structures(boxes, column), column, "of").select(*PAGE, *[F.col(f"of.{f}").alias(f) for f in fields], F.explode("of.rows").alias("box"))
    return each.select(*[F.col(c) if c in PAGE else F.col(f"box.{c}").alias(c) for c in boxes.columns], *fields)
