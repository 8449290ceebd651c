"""Language identification by known words first, then by progressively shorter character n-grams (operator 7).

Known words are scored by their log frequency in each learned language. An unseen word is cut into character n-grams of
the longest length of which the model knows any, and gets the mean of their log frequencies.

Defined results: null text or text without a letter (a character of a category L) gives `und` with score 0; ties go to the first
language in code-point order; without any labelled row every text is `und`; a null id counts as not held out but is not learned
from; repeated texts are drawn as one; very long texts are read whole; an empty table gives no rows; columns of the made names
are replaced, and others are returned as they are.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliomill.llm.common import id_bucket, lean, own, table, with_fields

UNKNOWN = "und"


#: Runs of letters and of numbers that are no digits; the latter, such as superscripts and fractions, are blanked before.
LETTERS = re.compile(r"[^\W\d_]+")
_NUMBERS = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()]
#: In two sets, as only one of small code points is compiled to a table.
NUMBERS = re.compile("[" + "".join(c for c in _NUMBERS if c <= "\uffff") + "]")
HIGH_NUMBERS = re.compile("[" + "".join(c for c in _NUMBERS if c > "\uffff") + "]")
#: Added to every count, so that no log frequency is infinite.
SMOOTH = 0.1
#: A text's evidence counts as that of so many words at most, which keeps scores off 1 for mixed texts.
EVIDENCE = 24
#: Rows that are scored at a time.
ROWS = 1000
#: Unseen words whose row a Python worker keeps.
REMEMBERED = 100_000


@dataclass
class LanguageModel:
    """languages in code-point order; words and each n-gram level map to rows of log frequencies by language."""

    languages: list[str]
    words: dict[str, int]
    rows: np.ndarray
    grams: list[dict[str, int]]
    gram_rows: list[np.ndarray]

    def unseen(self, word: str) -> np.ndarray:
        framed = f"<{word}>"
        for known, rows in zip(self.grams, self.gram_rows, strict=True):
            n = len(next(iter(known), "")) or 1
            hits = [known[g] for g in (framed[i : i + n] for i in range(len(framed) - n + 1)) if g in known]
            if hits:
                return rows[hits].mean(0)
        return np.zeros(len(self.languages))


def _rows(counts: dict[str, dict[str, float]], languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    keys = sorted(set().union(*[counts[x] for x in languages]))
    at = {k: i for i, k in enumerate(keys)}
    c = np.full((len(keys), len(languages)), SMOOTH)
    for j, x in enumerate(languages):
        for k, v in counts[x].items():
            c[at[k], j] += v
    return at, np.log(c / c.sum(0)) if keys else c


def words_of(text: str) -> list[str]:
    text = unicodedata.normalize("NFC", text).lower()
    if not text.isascii():
        text = NUMBERS.sub(" ", text)
        if max(text) > "\uffff":
            text = HIGH_NUMBERS.sub(" ", text)
    return LETTERS.findall(text)


def _counted(rows: DataFrame) -> DataFrame:
    """(lang, word, n) from (lang, text), a part of the counts a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in counts], pa.string()), pa.array([w for _, w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                x = lang.as_py()
                counts.update((x, w) for w in words_of(text.as_py()))
                if len(counts) > 200_000:
                    yield made()
                    counts.clear()
        yield made()

    return rows.mapInArrow(run, "lang string, word string, n long")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", *, per_language: int = 2000, min_count: int = 3, few_words: int = 200, longest: int = 4) -> LanguageModel:
    """Fit on about `per_language` different labelled texts of each language at most, chosen by a hash of the text.

    The bound also bounds what the driver gets: words that the sample holds at least `min_count` times. A language of which fewer
    than `few_words` words are that frequent has all its words.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit(7), text).alias("h")).dropna()
    share = rows.groupBy("lang").agg((per_language / F.approx_count_distinct("h")).alias("share"))
    drawn = rows.join(F.broadcast(share), "lang").filter(F.pmod("h", F.lit(1 << 52)) / float(1 << 52) < F.col("share"))
    drawn = drawn.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")
    counts = _counted(drawn).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    often = F.sum(F.when(F.col("n") >= min_count, 1).otherwise(0)).over(Window.partitionBy("lang"))
    counted = counts.withColumn("often", often).filter((F.col("n") >= min_count) | (F.col("often") < few_words)).toPandas()
    languages = sorted(counted["lang"].unique())
    words: dict[str, dict[str, float]] = {x: {} for x in languages}
    grams: list[dict[str, Counter]] = [{x: Counter() for x in languages} for _ in range(longest)]
    for x, w, n in zip(counted["lang"], counted["word"], counted["n"], strict=True):
        words[x][w] = n
        framed = f"<{w}>"
        for level, size in zip(grams, range(longest, 0, -1), strict=True):
            for i in range(len(framed) - size + 1):
                level[x][framed[i : i + size]] += n
    if not languages:
        return LanguageModel([], {}, np.zeros((0, 0)), [], [])
    at, rows_ = _rows(words, languages)
    levels = [_rows(level, languages) for level in grams]
    return LanguageModel(languages, at, rows_, [x for x, _ in levels], [x for _, x in levels])


class Scorer:
    """Scores texts; remembers rows of unseen words, a bounded number of them."""

    def __init__(self, model: LanguageModel):
        self.model, self.at = model, {}
        known = len(model.words)
        self.rows = np.empty((known + REMEMBERED, len(model.languages)))
        self.rows[:known] = model.rows
        self.reset()

    def reset(self) -> None:
        self.at, self.next = {}, len(self.model.words)

    def indices(self, words: list[str]) -> list[int]:
        at, known = self.at, self.model.words
        try:
            return [known[w] if w in known else at[w] for w in words]
        except KeyError:
            for w in {w for w in words if w not in known and w not in at}:
                if self.next == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.empty((REMEMBERED, self.rows.shape[1]))])  # one text's words are kept together
                at[w] = self.next
                self.rows[self.next] = self.model.unseen(w)
                self.next += 1
            return [known[w] if w in known else at[w] for w in words]

    def score(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        if self.next - len(self.model.words) > REMEMBERED - 20_000:
            self.reset()
        ids = self.indices(words)
        total = self.rows[ids].sum(0)
        mean = total / len(ids) * min(len(ids), EVIDENCE)
        p = np.exp(mean - mean.max())
        p /= p.sum()
        best = int(np.argmax(p))
        return self.model.languages[best], float(p[best])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with two more columns: the predicted language and its posterior share (0 to 1). Only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.select(*[c for c in docs.columns if c == text or c not in (lang_out, score_out)])
    at, names = rest.columns.index(text), [*rest.columns, lang_out, score_out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                found = [scorer.score(t.as_py()) for t in part.column(at)]
                made = [pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names)
            lean()

    return rest.mapInArrow(run, with_fields(rest.schema, {lang_out: "string", score_out: "double"}))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = id_bucket(F.col("doc_id"), 4)
    model = fit(docs.filter(held != 2))
    rows = docs.select("doc_id", F.coalesce(held == 2, F.lit(False)).alias("held_out"), "text")
    return identify(rows, model).drop("text")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of which the method knows no language (`und`) or is not sure (score under 0.5) go."""
    model = fit(docs.filter(id_bucket(F.col("doc_id"), 4) != 2))
    lang, score = own(docs, "lang_pred"), own(docs, "lang_score")
    out = identify(docs, model, lang_out=lang, score_out=score)
    return out.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= 0.5)).drop(lang, score)
