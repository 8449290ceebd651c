"""Scalar rules, layout folds and text operators on small cases."""

import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from foliomill.functions import scalars as S
from foliomill.operators import golden, layout, prose, tools
from foliomill.operators import integrity as I

BOX = "doc_id long, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, confidence double"


def boxes(spark, rows, page=1):
    return spark.createDataFrame([(1, page, i, t, *map(float, b), float(f), 1.0) for i, (t, b, f) in enumerate(rows)], BOX)


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def order(df):
    return [r["text"] for r in layout.reading_order(df).orderBy("reading_order").collect()]


def test_reading_order_band(spark):
    rows = [("left2", (0.1, 0.5, 0.45, 0.52), 10), ("right2", (0.55, 0.5, 0.9, 0.52), 10), ("full", (0.1, 0.3, 0.9, 0.32), 10), ("right1", (0.55, 0.4, 0.9, 0.42), 10), ("left1", (0.1, 0.4, 0.45, 0.42), 10)]
    assert order(boxes(spark, rows)) == ["full", "left1", "left2", "right1", "right2"]


def test_reading_order_columns(spark):
    rows = [("right1", (0.55, 0.2, 0.9, 0.22), 10), ("right2", (0.55, 0.3, 0.9, 0.32), 10), ("left1", (0.1, 0.3, 0.44, 0.32), 10), ("left2", (0.1, 0.4, 0.44, 0.42), 10)]
    assert order(boxes(spark, rows)) == ["left1", "left2", "right1", "right2"]


def test_title_ignores_a_vertical_stamp(spark):
    rows = [("preprint:2503.17744v1 [quant-ph]", (0.04, 0.18, 0.08, 0.86), 30), ("A Horizontal Title", (0.2, 0.12, 0.8, 0.17), 17), ("Body text follows here", (0.2, 0.3, 0.8, 0.32), 10)]
    df = boxes(spark, rows)
    assert layout.titles(df).first()["title"] == "A Horizontal Title"
    assert [r["text"] for r in df.filter(S.is_stamp()).collect()] == [rows[0][0]]


def test_formula_cluster_covers_its_pieces(spark):
    rows = [("prose before this", (0.2, 0.25, 0.4, 0.27), 10), ("δφ = 2πτδν +", (0.4, 0.28, 0.7, 0.30), 10), ("∆L(τ)", (0.55, 0.27, 0.65, 0.29), 10), ("(1)", (0.8, 0.28, 0.84, 0.30), 10), ("prose after this line", (0.2, 0.31, 0.8, 0.33), 10)]
    found = layout.formula_clusters(boxes(spark, rows)).collect()
    assert len(found) == 1 and found[0]["n_boxes"] == 3 and (found[0]["x0"], found[0]["x1"]) == (0.4, 0.84)


@pytest.mark.parametrize("text, expected", [("− | −", True), ("v x y z", True), ("×", True), ("{", True), ("∼", True), ("where R is the key rate", False), ("encoding satisfies 1 cos(φ + ∆φ(t)) < Λ", False), ("224011 (2012)", False)])
def test_formula_fragments(spark, text, expected):
    assert spark.createDataFrame([(text,)], "text string").select(S.is_formula_fragment()).first()[0] is expected


LEXICON = {"milestone": 3.5, "photons": 3.2, "measurement": 4.5, "entangling": 2.0, "repeater": 2.6, "repeaterless": 1.0, "stone": 5.0, "mile": 4.8}


@pytest.mark.parametrize("left, right, expected", [
    ("atmospheric turbulence-", "induced distortion", "atmospheric turbulence-induced distortion"), ("an open-", "channel protocol", "an open-channel protocol"), ("a free-", "space channel", "a free-space channel"),
    ("a mile-", "stone result", "a milestone result"), ("the pho-", "tons arrived", "the photons arrived"), ("a measure-", "ment result", "a measurement result"), ("min-", "and max-entropies", "min- and max-entropies"), ("sending-", "or-not-sending", "sending-or-not-sending"),
])
def test_line_joining(left, right, expected):
    assert prose.join_lines(left, right, LEXICON) == expected


def test_in_run_hyphens():
    assert prose.is_soft_in_run("Entan", "gling", LEXICON) and prose.is_soft_in_run("repeater", "less", LEXICON)
    assert not prose.is_soft_in_run("free", "space", LEXICON) and not prose.is_soft_in_run("finite", "key", LEXICON)


def test_spaces_between_runs(spark):
    for a, b, expected in [("(", "x", False), ("word", "B", True), ("ab", "cd", False), ("α", "x", True), ("3", "kg", True), ("3", "k", False), ("", "x", False), ("A", "B", False)]:
        assert one(spark, S.needs_space(F.lit(a), F.lit(b))) is expected, (a, b)
    assert one(spark, S.repaired_spacing(F.lit("isBIG ∆x 10 nsand"))) == prose.repaired("isBIG ∆x 10 nsand", {}) == "is BIG ∆ x 10 ns and"


def test_reading_order_counts_all_wide_boxes(spark):
    rows = [(f"L{i}", (0.1, 0.1 * i, 0.4, 0.1 * i + 0.01), 10) for i in (1, 2)] + [(f"R{i}", (0.55, 0.1 * i, 0.9, 0.1 * i + 0.01), 10) for i in (1, 2)]
    rows += [(f"w{i}", (0.1, 0.3 + 0.05 * i, 0.9, 0.31 + 0.05 * i), 10) for i in range(6)]
    assert order(boxes(spark, rows))[:4] == ["L1", "R1", "L2", "R2"]


def test_median_is_of_the_page_without_numbers_and_used_boxes(spark):
    rows = [("a", (0.1, 0.1, 0.5, 0.12), 9), ("b", (0.1, 0.2, 0.5, 0.22), 11), ("12", (0.1, 0.9, 0.5, 0.92), 30), ("small", (0.1, 0.3, 0.5, 0.32), 7), ("used", (0.1, 0.4, 0.5, 0.42), 40)]
    one_page = boxes(spark, rows)
    used = spark.createDataFrame([(1, 4)], "doc_id long, seq int")
    assert layout.median_fonts(one_page, used).first()["median"] == 10.0
    assert layout.median_fonts(boxes(spark, [("tiny", (0.1, 0.1, 0.5, 0.12), 5)])).first()["median"] == 10.0


def test_tables_end_at_a_gap(spark):
    rows = [("Table 1 of things", (0.3, 0.2, 0.6, 0.22), 8), ("left of it", (0.1, 0.2, 0.2, 0.22), 8), ("row", (0.1, 0.23, 0.6, 0.25), 10), ("far small", (0.1, 0.4, 0.6, 0.42), 8), ("body", (0.1, 0.44, 0.6, 0.46), 10), ("more", (0.1, 0.47, 0.6, 0.49), 10)]
    assert sorted(r["text"] for r in layout.table_boxes(boxes(spark, rows)).collect()) == ["Table 1 of things", "far small", "left of it", "row"]


def test_a_seed_inside_a_formula_starts_none(spark):
    rows = [("a = 2 + 3", (0.2, 0.300, 0.4, 0.310), 10), ("b = 4 + 5", (0.5, 0.312, 0.7, 0.322), 10), ("c = 6 + 7", (0.5, 0.3235, 0.7, 0.3335), 10), ("d = 8 + 9", (0.2, 0.6, 0.4, 0.62), 10)]
    assert sorted((r["seed"], r["text"][0]) for r in layout.formula_boxes(boxes(spark, rows)).collect()) == [(0, "a"), (0, "b"), (2, "b"), (2, "c")]


def test_front_matter(spark):
    rows = [("A Title of the Work", (0.2, 0.1, 0.8, 0.13), 17), ("Ada Lovelace , Alan Turing", (0.2, 0.2, 0.8, 0.22), 12), ("1", (0.41, 0.2, 0.42, 0.21), 8), ("2,†", (0.79, 0.2, 0.81, 0.21), 8), ("Before any number", (0.2, 0.24, 0.8, 0.26), 11), ("1 Example Institute", (0.2, 0.27, 0.8, 0.29), 11), ("of London", (0.2, 0.3, 0.8, 0.32), 11), ("Abstract", (0.4, 0.4, 0.5, 0.42), 11), ("text", (0.2, 0.7, 0.8, 0.72), 9)]
    page2 = boxes(spark, [("goes on", (0.2, 0.1, 0.8, 0.12), 9), ("body", (0.2, 0.13, 0.8, 0.15), 11)], 2)
    b = boxes(spark, rows).unionByName(page2)
    front = layout.front_matter(b)
    names = layout.authors(layout.author_lines(b, front))
    assert [(r["name"], r["nth"]) for r in names.orderBy("nth").collect()] == [("Ada Lovelace", 0), ("Alan Turing", 1)]
    assert [r["marker"] for r in layout.nearest_markers(names, layout.author_markers(b, front)).orderBy("nth").collect()] == ["1", "2,†"]
    assert [(r["label"], r["text"]) for r in layout.affiliations(layout.affiliation_lines(b, front)).orderBy("affiliation").collect()] == [("", "Before any number"), ("1", "1 Example Institute of London")]
    assert layout.abstract_continuation(b, front).first()["n_lines"] == 1


def test_line_merge_keeps_islands_by_their_first_box(spark):
    rows = [("ab", (0.1, 0.2, 0.2, 0.22), 10), ("cd", (0.21, 0.2, 0.3, 0.22), 11), ("far", (0.5, 0.2, 0.6, 0.22), 10), ("low", (0.1, 0.3, 0.2, 0.32), 10)]
    got = [(r["text"], r["x1"], r["font_size"]) for r in prose.merged_fragments(boxes(spark, rows)).orderBy("nth").collect()]
    assert got == [("ab cd", 0.3, 11.0), ("far", 0.6, 10.0), ("low", 0.2, 10.0)]


def test_blocks(spark):
    rows = [("The Title of It", (0.1, 0.02, 0.8, 0.05), 20), ("Introduction", (0.1, 0.1, 0.3, 0.12), 14), ("First line of a para-", (0.1, 0.2, 0.9, 0.22), 10), ("graph goes on", (0.1, 0.23, 0.9, 0.25), 10), ("Far below", (0.1, 0.4, 0.9, 0.42), 10), ("[1] A. Author", (0.1, 0.5, 0.9, 0.52), 10), ("Journal (2012)", (0.1, 0.53, 0.9, 0.55), 10), ("12", (0.5, 0.9, 0.52, 0.92), 10)]
    got = [(r["kind"], r["text"]) for r in prose.blocks(boxes(spark, rows)).orderBy("nth").collect()]
    assert got == [("heading:1", "Introduction"), ("paragraph", "First line of a para-graph goes on"), ("paragraph", "Far below"), ("reference", "[1] A. Author Journal (2012)"), ("page-number", "12")]


def test_blocks_after_references_and_tables(spark):
    def kinds(rows):
        return [(r["kind"], r["text"]) for r in prose.blocks(boxes(spark, rows), LEXICON).orderBy("nth").collect()]

    title = ("Title of a work", (0.1, 0.02, 0.8, 0.05), 20)
    texts = ["224011 (2012)", "References", "stray", "[53] First.", "[54] On sending-", "or-not-sending continuation.", "[55] On min-", "and max-entropies", "(2013)"]
    rows = [title] + [(t, (0.1, 0.1 + 0.03 * i, 0.6, 0.12 + 0.03 * i), 10) for i, t in enumerate(texts)]
    assert kinds(rows) == [("paragraph", "224011 (2012)"), ("reference-heading", "References"), ("reference", "[53] First."), ("reference", "[54] On sending-or-not-sending continuation."), ("reference", "[55] On min- and max-entropies (2013)"), ("reference-rest", "stray")]
    rows = [title, ("One line here", (0.1, 0.2, 0.6, 0.22), 10), ("Table 1 of things", (0.1, 0.6, 0.6, 0.62), 8), ("cells", (0.1, 0.63, 0.6, 0.65), 8), ("Body after the table", (0.1, 0.68, 0.6, 0.7), 10)]
    assert kinds(rows) == [("paragraph", "One line here"), ("paragraph", "Body after the table")]


def test_candidates():
    assert prose.comparable("The cat sat", "the  CAT sat")[1] and prose.comparable("cat", "the cat sat")[1]
    assert not prose.comparable("Entirely invented words here", "nothing of the kind at all")[1]


@pytest.mark.parametrize("url, expected", [
    ("https://example.org/a.pdf", True), ("http://8.8.8.8/", True), ("http://localhost/x", False), ("http://sub.localhost", False), ("http://127.0.0.1", False), ("http://10.0.0.1", False), ("http://169.254.1.1", False),
    ("http://[::1]/", False), ("http://[fc00::1]/", False), ("http://[ff02::1]/", False), ("http://0.0.0.0/", False), ("http://192.0.2.1/", False), ("file:///etc/x", False), ("https://u:p@example.org/", False), (None, False),
])
def test_public_urls(spark, url, expected):
    assert spark.createDataFrame([(url,)], "u string").select(S.is_public_url(F.col("u"))).first()[0] is expected


def test_uuid5_and_hashes(spark):
    name = "any name"
    assert one(spark, S.uuid5(S.PACKAGE_NAMESPACE, F.lit(name))) == str(uuid.uuid5(uuid.UUID(S.PACKAGE_NAMESPACE), name))
    grid = [(i * 37) % 101 for i in range(72)]
    want = sum((grid[r * 9 + c] > grid[r * 9 + c + 1]) << (r * 8 + c) for r in range(8) for c in range(8))
    df = spark.createDataFrame([(grid,)], "g array<int>")
    assert df.select(golden.difference_hash(F.col("g"))).first()[0] == f"{want:016x}"
    assert one(spark, S.hamming(F.lit(5), F.lit(6))) == 2


def test_names_labels_dates(spark):
    given, surname = S.name_parts(F.lit("Ada  King Lovelace "))
    assert (one(spark, given), one(spark, surname)) == ("Ada  King", "Lovelace")
    assert one(spark, S.labelled(F.lit("12 Some Institute"), "affiliation")[1]) == "Some Institute"
    assert one(spark, S.stamp_date(F.lit("x:1 [q] 22 mAR 2025"))) == "2232025"
    assert one(spark, S.stamp_date(F.lit("no date"))) is None


def test_missing_references_ignore_nulls_and_skew(spark):
    rows = spark.createDataFrame([(1,), (None,), (9,), (9,)], "k long")
    assert [r["k"] for r in I.missing_references(rows, "k", spark.createDataFrame([(1,), (1,)], "k2 long"), "k2").collect()] == [9, 9]
    assert I.duplicate_keys(rows, ["k"]).collect()[0]["surplus"] == 1


def test_tool_contracts(spark):
    pages = spark.createDataFrame([("a", 1, 72.0, 72.0, 0, 300, "completed", 1), ("b", 1, -1.0, 72.0, 45, 144, "no-text", 2), ("b", 3, 72.0, 72.0, 0, 300, "completed", 0)], "doc_id string, page int, width double, height double, rotation int, dpi int, status string, n_boxes int")
    got = {(r["doc_id"], r["code"]) for r in tools.check_pages(pages).collect()}
    assert got == {("b", c) for c in ("page_size", "page_rotation", "render_dpi", "status_boxes", "page_numbers")}


def test_source_descriptors():
    good = '{"format":"f","format_version":"0.1","case_id":"a-1","url":"https://example.org/a.pdf","sha256":"' + "0" * 64 + '","size":5,"original_name":"a.pdf"}'
    assert tools.descriptor_faults(good.encode()) == []
    for change in (('"https://example.org/a.pdf"', '"file:///a.pdf"'), ("https://", "https://u:p@"), ("0" * 64, "A" * 64), ('"size":5', '"size":0'), ('"a.pdf"}', '"../a.pdf"}'), ('"size"', '"more":1,"size"')):
        assert tools.descriptor_faults(good.replace(*change).encode())
    assert tools.descriptor_faults(b"\xef\xbb\xbf" + good.encode()) and tools.descriptor_faults(good.encode() + b"\r\n")


def test_lines_are_folded_as_one_by_one(spark):
    r = random.Random(3)
    bits = ["nsmskmHzx", "ms", "kmA", "aBC", "δx", "µ", "-", "self-", "and", "or-else", "a  b", " ", "\t", " ", "end ", "Hz", "b-", "é", "nsms", "q", ""]
    rows = [(i, [" ".join(r.choices(bits, k=r.randrange(1, 5))) if r.random() < 0.7 else "".join(r.choices(bits, k=r.randrange(0, 6))) for _ in range(r.randrange(1, 9))]) for i in range(600)]
    t = F.col("texts")
    plain = F.aggregate(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), F.element_at(t, 1), S.joined_lines)
    got = spark.createDataFrame(rows, "i int, texts array<string>").select("texts", plain.alias("plain"), layout._joined(t).alias("joined")).collect()
    assert [(x["texts"], x["joined"]) for x in got] == [(x["texts"], x["plain"]) for x in got]


def test_many_lines_of_a_reference_take_no_square_of_time(spark):
    started = time.monotonic()
    n = 12_000
    lines = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("word and more of a line "), i.cast("string"))).alias("texts"))
    assert lines.select(F.length(layout._joined(F.col("texts")))).first()[0] == sum(25 + len(str(i)) for i in range(1, n + 1)) - 1
    assert time.monotonic() - started < 60


def test_front_lines_need_no_join(spark):
    rows = [("A Title of the Work", (0.2, 0.1, 0.8, 0.13), 17), ("Ada Lovelace, Alan Turing", (0.2, 0.2, 0.8, 0.22), 12), ("small, print", (0.2, 0.22, 0.8, 0.23), 10.6), ("1", (0.41, 0.2, 0.42, 0.21), 8), ("2,†", (0.79, 0.2, 0.81, 0.21), 8), ("Abstract", (0.4, 0.4, 0.5, 0.42), 11), ("Later, on", (0.2, 0.7, 0.8, 0.72), 12), ("3", (0.2, 0.8, 0.3, 0.82), 8)]
    found = layout.front_lines(boxes(spark, rows).unionByName(boxes(spark, [("Not, here", (0.2, 0.2, 0.8, 0.22), 12)], 2)))
    assert sorted((r["seq"], r["kind"], r["text"]) for r in found.collect()) == [(1, "author", "Ada Lovelace, Alan Turing"), (3, "marker", "1"), (4, "marker", "2,†")]
    assert layout.front_lines(boxes(spark, rows[:1])).count() == 0 == layout.front_lines(boxes(spark, rows, 2)).count()
    for df in (found, layout.front_matter(boxes(spark, rows))):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
