"""Line dedup by winnowing over line hashes (operator 9). DataFrame functions only.

A gram is the shortest run of lines from a line on that holds MIN_WORDS words; a window is the shortest that holds SURE_WORDS. The least
gram hash of each window becomes a fingerprint, so every repeated run of SURE_WORDS words shares at least one with its first
occurrence, and runs under MIN_WORDS never match. Fingerprints are joined by their hash: one that an earlier place holds too is a hit.
Hits are extended both ways, line by line, as long as a gram that starts or ends at the next line stands at any earlier place as well,
so a run goes whole even where its parts first occurred in different documents. The lines of these runs go; first occurrences stay.
Each gram is joined with one place, its first, so the work is linear in the lines however often one repeats.

Documents are ordered by doc_id (null last), then by a hash of the text; rows with the same id and text are one document and are
treated alike. Lines are compared without white space at their ends; empty lines go only between deleted ones.

Defined results: null text stays null; texts without repeated runs stay as they are, byte by byte; a text of which all goes
becomes empty; very long texts are taken whole; an empty table gives no rows; columns of the made names are replaced, and others
are returned as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliomill.llm.common import aside, n_words, own, settle, table, unsettle

MIN_WORDS, SURE_WORDS = 20, 40


def _reach(counts: Column, words: int) -> Column:
    """How many items of counts it takes to hold so many words: a struct of s (words) and n (items)."""
    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("n"))
    return F.aggregate(counts, start, lambda a, x: F.when(a["s"] >= words, a).otherwise(F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n"))))


def line_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """(d, t, k, pos, h, c): the lines with words of each document (d, t), numbered by k, with their hash and word count."""
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    rows = rows.select("d", "t", "pos", F.xxhash64(F.trim(F.regexp_replace("line", r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", ""))).alias("h"), n_words(F.col("line")).alias("c")).filter("c > 0")
    # partial distinct first: rows that repeat are one document
    rows = rows.distinct()
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("d", "t").orderBy("pos")) - 1)


def grams(lines: DataFrame, min_words: int = MIN_WORDS, sure_words: int = SURE_WORDS) -> DataFrame:
    """Of each line (d, t, k): the gram that starts there (g, its last line k1, positions p0 and p1), the one that ends there if no
    line's gram is the same (back_g, back_k, back_p0), and the gram that the line's window selects (print_g, print_k). A gram is
    null where the text ends before. A document's last, incomplete windows count too."""
    document = Window.partitionBy("d", "t").orderBy("k")
    ahead, behind = document.rowsBetween(0, sure_words - 1), document.rowsBetween(1 - min_words, 0)
    lists = {"hs": "h", "cs": "c", "ps": "pos"}
    rows = lines.withColumn("c", F.col("c").cast("long"))
    rows = rows.select("d", "t", "k", "c", F.col("pos").alias("p0"), *[F.collect_list(c).over(ahead).alias(x) for x, c in lists.items()], *[F.collect_list(c).over(behind).alias("b" + x) for x, c in lists.items()])
    rows = rows.withColumns({"r1": _reach(F.col("cs"), min_words), "r2": _reach(F.col("cs"), sure_words), "rb": _reach(F.reverse("bcs"), min_words)})
    back, n1, nb = F.col("rb.s") - F.col("c") >= min_words, F.col("r1.n"), F.col("rb.n")
    rows = rows.select(
        "d", "t", "k", "p0", F.element_at("ps", n1).alias("p1"), F.when(F.col("r1.s") >= min_words, F.xxhash64(F.slice("hs", 1, n1))).alias("g"), n1.alias("n1"), F.col("r2.n").alias("n2"),
        F.when(back, F.xxhash64(F.slice("bhs", -nb, nb))).alias("back_g"), (F.col("k") - nb + 1).alias("back_k"), F.element_at("bps", -nb).alias("back_p0"),
    )
    rows = rows.withColumn("near", F.collect_list(F.struct("g", "n1")).over(ahead))
    marked = F.transform(F.slice("near", 1, F.col("n2")), lambda x, i: F.struct(x["g"].alias("g"), (-i).alias("o"), (i + x["n1"]).alias("stop")))
    least = F.array_min(F.filter(marked, lambda x: x["g"].isNotNull() & (x["stop"] <= F.col("n2"))))
    rows = rows.withColumn("m", least)
    return rows.select("d", "t", "k", (F.col("k") + F.col("n1") - 1).alias("k1"), "p0", "p1", "g", "back_g", "back_k", "back_p0", (F.col("k") - F.col("m.o")).alias("print_k"), F.col("m.g").alias("print_g"))


def _later(rows: DataFrame, places: DataFrame) -> DataFrame:
    """rows (d, t, k, g and others) whose g an earlier one of the places (d, t, k, g) holds."""
    order = F.struct(F.col("d").isNull().alias("z"), "d", "t", "k")
    # a table, so that the join's two sides are plain exchanges and a frequent g can be split
    first = settle(places.groupBy("g").agg(F.min(order).alias("f"), F.count("*").alias("n")).filter("n > 1").select(F.col("g").alias("g1"), "f"))
    same = F.col("d").eqNullSafe(F.col("f.d")) & (F.col("t") == F.col("f.t")) & (F.col("k") == F.col("f.k"))
    return rows.join(first.hint("merge"), F.col("g") == F.col("g1")).filter(~same).select(*rows.columns)


def repeated_runs(lines: DataFrame, min_words: int = MIN_WORDS, sure_words: int = SURE_WORDS) -> DataFrame:
    """(d, t, p0, p1): runs of lines, by position, that stand at earlier places too."""
    every = settle(grams(lines, min_words, sure_words))
    prints = every.filter("print_g is not null").select("d", "t", F.col("print_k").alias("k"), F.col("print_g").alias("g")).distinct()
    hits = settle(_later(prints, prints).select(F.col("d").alias("d2"), F.col("t").alias("t2"), F.col("k").alias("k2")))
    own_ = F.col("d").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2"))
    columns = ["d", "t", "k", "k1", "p0", "p1", "g"]
    back = every.filter("back_g is not null").select("d", "t", F.col("back_k").alias("k"), F.col("k").alias("k1"), F.col("back_p0").alias("p0"), F.col("p0").alias("p1"), F.col("back_g").alias("g"))
    placed = every.filter("g is not null").select(*columns).unionByName(back)
    mine = placed.join(hits.select("d2", "t2").distinct(), own_, "left_semi")
    again = settle(_later(mine, placed))
    again = again.join(hits, own_ & (F.col("k") == F.col("k2")), "left").withColumn("hit", F.col("k2").isNotNull())
    # grams that overlap or touch are one run
    order = Window.partitionBy("d", "t").orderBy("k", "k1")
    before = F.max("k1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    again = again.withColumn("new", F.when(F.col("k") <= before + 1, 0).otherwise(1))
    runs = again.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("d", "t", "run").agg(F.min("p0").alias("p0"), F.max("p1").alias("p1"), F.max("hit").alias("hit"))
    out = settle(runs.filter("hit").select("d", "t", "p0", "p1"))
    for made in (every, hits):
        unsettle(made)
    return out


def dedup_lines(docs: DataFrame, text: str = "text", *, min_words: int = MIN_WORDS, sure_words: int = SURE_WORDS) -> DataFrame:
    """docs with `text` cut, and `removed`: an array of (start, length) of the lines that went, by position in the old text."""
    docs = docs.select(*[c for c in docs.columns if c == text or c != "removed"])
    lines = settle(line_table(docs, text))
    runs = repeated_runs(lines, min_words, sure_words)
    unsettle(lines)
    cuts = runs.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("p0", "p1"))).alias("cuts"))
    # overlapping cuts become one; what lies between them stays
    start = F.struct(F.lit(0).alias("next"), F.expr("array(struct(0 as start, 0 as length))").alias("cut"))

    def merge(a: Column, x: Column) -> Column:
        fresh = F.struct(x["p0"].alias("start"), (x["p1"] - x["p0"] + 1).alias("length"))
        last = F.element_at(a["cut"], -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["length"], x["p1"] + 1 - last["start"]).alias("length"))
        grown = F.when(x["p0"] < a["next"], F.concat(F.slice(a["cut"], 1, F.size(a["cut"]) - 1), F.array(longer))).otherwise(F.concat(a["cut"], F.array(fresh)))
        return F.struct(F.greatest(a["next"], x["p1"] + 1).alias("next"), grown.alias("cut"))

    cut = F.filter(F.aggregate("cuts", start, merge)["cut"], lambda c: c["length"] > 0)
    cuts, x = aside(settle(cuts.select("d", "t", cut.alias("cut"))), docs)
    hashed, cut = own(docs, "this_hash"), F.col(x["cut"])
    # a merge join at every size: cuts grow with the documents
    out = docs.withColumn(hashed, F.xxhash64(text)).join(cuts.hint("merge"), F.col("doc_id").eqNullSafe(F.col(x["d"])) & (F.col(hashed) == F.col(x["t"])), "left")
    pieces = own(docs, "pieces")
    out = out.withColumn(pieces, F.when(cut.isNotNull(), F.split(text, "\n", -1)))
    ends = F.concat(F.array(F.lit(0)), F.transform(cut, lambda c: c["start"] + c["length"]))
    starts = F.concat(F.transform(cut, lambda c: c["start"]), F.array(F.size(pieces)))
    kept = F.zip_with(ends, starts, lambda a, b: F.slice(F.col(pieces), a + 1, b - a))
    said = F.when(cut.isNull(), F.col(text)).otherwise(F.array_join(F.flatten(kept), "\n"))
    none = F.expr("cast(array() as array<struct<start:int,length:int>>)")
    return out.withColumns({text: said, "removed": F.coalesce(cut, none)}).select(*docs.columns, "removed")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0), lambda a, c: a + c["length"]).cast("long")
    return out.select("doc_id", "text", gone.alias("n_removed"), F.array_join(F.transform("removed", lambda c: F.concat_ws("+", c["start"], c["length"])), ",").alias("removed"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: later copies of repeated runs go; documents of which nothing is left go too; n_chars follows the text."""
    out = dedup_lines(docs)
    left = (F.size("removed") == 0) | F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return out.filter(left).withColumn("n_chars", F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)
