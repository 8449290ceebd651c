"""Phrases whose words stand together more often than their parts do (operator 12).

Texts are cut into pieces, and equal pieces become one with a multiplicity. A first pass counts hashes of words and of pairs of words,
weighted, in DuckDB per hash bucket; counts of hashes are never below those of what they stand for, so what stays below the
threshold can be no phrase and no part of one. The rest is marked in a bit map of fixed size. A second pass counts, again per bucket and
exactly, the words, pairs, triples and quadruples that the map lets through. Parts of a phrase are then looked up by shuffled requests:
each cut sends one for each part to where that part's count lies, and the answers are gathered by phrase.

DuckDB counts out of core: its memory is bounded by `MEMORY`, and beyond that it spills to a folder of its own task that the task deletes.
Tasks combine what they count before it is shuffled, so a frequent word sends one row from each task and a few megabytes of text.

Other columns are not read. Defined results: null text counts as empty, null lang as `und`; texts without words have no rows; repeated rows count as
often as they occur; ties go by the phrase's UTF-8 bytes; languages without candidates have no rows; no documents give no rows. Texts may be of any length.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliomill.llm.common import lean, settle, table, unsettle

LEAST, LONGEST, TOP = 30, 4, 2000
SCALE, COVERED = 2_000_000, 80
#: The bit map has 2^MAP_BITS bits, whatever the corpus: 8 MB. A fuller map lets more through to the exact count and changes no result.
MAP_BITS = 26
#: Words that a task counts together before it sends their counts.
TOGETHER = 2_000_000
#: Weighted rows that a bucket should hold; more spill.
BUCKET_ROWS = 4_000_000
MEMORY = "256MB"
#: Rows that DuckDB takes at a time, and rows of a part of a bucket.
APPEND, PART = 200_000, 65_536
_LOW, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


#: Bytes of a text as pieces need them: A-Z in lower case, piece ends as LF, tabs as blanks. UTF-8 keeps these bytes out of all other characters.
_BYTES = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 9 + b" ")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, piece) of each piece that holds a word."""
    for batch in batches:
        text = batch.column(1)
        plain = text.cast(pa.large_binary())
        _, ends, data = pa.concat_arrays([plain]).buffers()
        if data is None:
            continue
        text = pa.Array.from_buffers(pa.large_string(), len(plain), [None, ends, pa.py_buffer(data.to_pybytes().translate(_BYTES))], offset=plain.offset)
        parts = pc.split_pattern(text, "\n")
        lang = batch.column(0).take(pc.list_parent_indices(parts))
        piece = pc.utf8_trim(parts.flatten(), " ")
        if pc.any(pc.match_substring(piece, "  ")).as_py():
            piece = pc.replace_substring_regex(piece, " +", " ")
        filled = pc.greater(pc.binary_length(piece), 0)
        yield from pa.Table.from_arrays([lang.filter(filled), piece.filter(filled).cast(pa.string())], ["lang", "piece"]).to_batches(max_chunksize=50_000)
    lean()


def pieces_of(documents: DataFrame) -> DataFrame:
    """(lang, piece, m): the distinct pieces, their words parted by single blanks, and how often each occurs."""
    rows = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text IS NOT NULL")
    return rows.mapInArrow(_cut, "lang string, piece string").groupBy("lang", "piece").agg(F.count("*").alias("m"))


class Words:
    """The words of many pieces as numbers, with each word's language and how many words follow in its piece."""

    def __init__(self, lang: pa.Array, piece: pa.Array, m: np.ndarray):
        words = pc.split_pattern(piece, " ")
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(words.flatten())
        self.word, self.names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        of = pc.dictionary_encode(lang)
        self.langs = of.dictionary
        self.lang = np.repeat(of.indices.to_numpy().astype(np.int64), sizes)
        self.m = np.repeat(m, sizes)
        ends = np.repeat(np.cumsum(sizes), sizes)
        self.left = ends - np.arange(len(self.word))

    def hashes(self) -> np.ndarray:
        """64 bits for each word and its language."""
        names, langs = (hash_array(x.to_pandas().to_numpy(object), categorize=False) for x in (self.names, self.langs))
        return names[self.word] ^ (langs[self.lang] * _ODD)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _LOW
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


def word_keys(h: np.ndarray) -> np.ndarray:
    return _mixed(h)


def pair_keys(h: np.ndarray) -> np.ndarray:
    """Keys of the pairs that start at each word but the last."""
    return _mixed(h[:-1] * _LOW + _mixed(h[1:]))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The pieces of a task in portions of about TOGETHER words."""
    held, size = [], 0

    def made() -> Words:
        t = pa.Table.from_batches(held)
        return Words(t["lang"].combine_chunks(), t["piece"].combine_chunks(), t["m"].to_numpy())

    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
        if size > 6 * TOGETHER:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _weighted(keys: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(keys)
    keys, m = keys[by], m[by]
    starts = np.r_[0, np.nonzero(keys[1:] != keys[:-1])[0] + 1] if len(keys) else np.zeros(0, int)
    return keys[starts], np.add.reduceat(m, starts) if len(keys) else m


DEALT = "bucket int, part binary"


def _dealt(rows: pa.Table, hashes: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """rows as parts of buckets, each an Arrow stream of at most PART rows: Spark shuffles few rows, whatever their number."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    rows, bucket = rows.take(pa.array(by)).combine_chunks(), bucket[by]
    cuts = np.r_[0, np.nonzero(bucket[1:] != bucket[:-1])[0] + 1, len(bucket)] if len(bucket) else np.zeros(1, int)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        for at in range(lo, hi, PART):
            part = rows.slice(at, min(PART, hi - at))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_table(part)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[lo : lo + 1]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "part"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(1):
            yield from pa.ipc.open_stream(x.as_buffer())


def _counted(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.RecordBatch]:
    """The sums of `w` by `keys`, those of at least `least`, of the buckets dealt to a task, by DuckDB out of core."""
    import duckdb

    with tempfile.TemporaryDirectory() as scratch, duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": os.path.join(scratch, "spill"), "preserve_insertion_order": False}) as db:
        held, size, made = [], 0, False

        def add() -> None:
            nonlocal made
            part = pa.Table.from_batches(held)  # noqa: F841, DuckDB reads it by its name
            db.execute("INSERT INTO counts SELECT * FROM part" if made else "CREATE TABLE counts AS SELECT * FROM part")
            made = True

        for batch in _parts(batches):
            held.append(batch)
            size += batch.num_rows
            if size >= APPEND:
                add()
                held, size = [], 0
        if held:
            add()
            held = []
        if made:
            by = ", ".join(keys)
            found = db.sql(f"SELECT {by}, sum(w)::BIGINT AS f FROM counts GROUP BY {by} HAVING sum(w) >= {least}")
            yield from found.to_arrow_reader(50_000)
    lean()


def _buckets(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def frequent_hashes(pieces: DataFrame, words: int, least: int) -> np.ndarray:
    """The bit map of the hashes of words and pairs that count at least `least`."""
    buckets = _buckets(pieces.sparkSession, 2 * words)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _together(batches):
            h = part.hashes()
            inside = part.left[:-1] > 1
            keys, w = _weighted(np.concatenate([word_keys(h), pair_keys(h)[inside]]).view(np.int64), np.concatenate([part.m, part.m[:-1][inside]]))
            yield from _dealt(pa.Table.from_arrays([pa.array(keys), pa.array(w)], ["key", "w"]), keys.view(np.uint64), buckets)
        lean()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _counted(batches, ["key"], least):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - MAP_BITS)).astype(np.int64))], ["bit"])

    # words of the map of 64 bits; at most 2^(MAP_BITS - 6) of them go to the driver
    bits = pieces.mapInArrow(emit, DEALT).repartition(buckets, "bucket").mapInArrow(mark, "bit long")
    marked = bits.groupBy(F.expr("bit DIV 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS INT)))").alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[marked["at"].to_numpy()] = marked["bits"].to_numpy()
    return out


def _let_through(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    return bits[at >> 6] >> (at & 63) & 1 == 1


def _phrases(part: Words, bits: np.ndarray) -> Iterator[tuple[int, pa.Array, pa.Array, np.ndarray]]:
    """(length, lang, phrase, weight) of what the map lets through, each once. Words that are numbers here make phrases exact."""
    h = part.hashes()
    at = np.nonzero(_let_through(bits, word_keys(h)))[0]
    pair = np.zeros(len(h), bool)
    if len(h) > 1:
        pair[:-1] = _let_through(bits, pair_keys(h)) & (part.left[:-1] > 1)
    # group is the number of the phrase so far among all in this portion, then joined with the next word
    group = part.lang * len(part.names) + part.word
    for n in range(1, LONGEST + 1):
        if n > 1:
            fits = pair[at + n - 2]  # part.left says that the pair lies within the piece
            at, group = at[fits], group[fits]
            group = group * len(part.names) + part.word[at + n - 1]
        else:
            group = group[at]
        if not len(at):
            return
        values, first, group = np.unique(group, return_index=True, return_inverse=True)
        weight = np.zeros(len(values), np.int64)
        np.add.at(weight, group, part.m[at])
        start = at[first]
        phrase = pc.binary_join_element_wise(*[part.names.take(pa.array(part.word[start + i])) for i in range(n)], " ") if n > 1 else part.names.take(pa.array(part.word[start]))
        yield n, part.langs.take(pa.array(part.lang[start])), phrase, weight


def frequent_phrases(documents: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, len, phrase, f) of all phrases of one to LONGEST words that occur `least` times, (lang, n) with the number of all words)."""
    pieces = settle(pieces_of(documents))
    n_words = F.size(F.split("piece", " ", -1)).cast("long")
    sizes = settle(pieces.groupBy("lang").agg(F.sum(n_words * F.col("m")).alias("n"), F.sum(n_words).alias("distinct")))
    words = sizes.agg(F.sum("distinct")).first()[0] or 0
    bits = pieces.sparkSession.sparkContext.broadcast(frequent_hashes(pieces, words, least))

    buckets = _buckets(pieces.sparkSession, words)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _together(batches):
            for n, lang, phrase, w in _phrases(part, bits.value):
                rows = pa.Table.from_arrays([lang, pa.array(np.full(len(w), n, np.int32)), phrase, pa.array(w)], ["lang", "len", "phrase", "w"])
                yield from _dealt(rows, hash_array(phrase.to_pandas().to_numpy(object), categorize=False), buckets)
        lean()

    kept = pieces.mapInArrow(emit, DEALT).repartition(buckets, "bucket")
    out = settle(kept.mapInArrow(lambda b: _counted(b, ["lang", "len", "phrase"], least), "lang string, len int, phrase string, f long"))
    unsettle(pieces)
    return out, sizes.select("lang", "n")


def _part(words: Column, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(documents: DataFrame, *, least: int = LEAST, top: int = TOP, scale: int = SCALE, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of two to LONGEST words by scale * a / (l + r), its lowest over all cuts."""
    counts, sizes = frequent_phrases(documents, least)
    candidates = counts.filter("len > 1").select("lang", "phrase", "len", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("words"))
    # a request for each part of each cut; a part occurs where its phrase does, so all are answered
    cut = candidates.select("lang", "phrase", "len", "a", "words", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"))
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), _part(F.col("words"), 1, F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), _part(F.col("words"), F.col("k") + 1, F.col("len") - F.col("k")).alias("part"))))
    asked = cut.select("lang", "phrase", "a", "k", sides.alias("s")).select("lang", "phrase", "a", "k", "s.side", "s.part")
    answers = asked.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    pair = answers.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    wide = "decimal(38,0)"
    score = F.expr(f"CAST(CAST({scale} AS {wide}) * a DIV (CAST(l AS {wide}) + r) AS long)")
    scored = pair.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    # what a longer candidate holds, by the most frequent of those
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("len") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("len") - n + 1), lambda i: _part(F.col("words"), i, n))))
    held = candidates.filter("len > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = scored.join(held, ["lang", "phrase"], "left").filter(f"longer IS NULL OR CAST(100 AS {wide}) * longer < CAST({covered} AS {wide}) * a")
    best = Window.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "s.l", "s.r", "n", "s.score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = f"""WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
    split AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM piece),
    sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
    lengths AS (SELECT unnest(range(1, {LONGEST + 1})) AS k),
    gram AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM split, lengths WHERE len(w) >= k),
    f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY lang, k, phrase HAVING count(*) >= {LEAST}),
    cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
    cut AS (SELECT *, unnest(range(1, k)) AS c1 FROM cand),
    scored AS (SELECT c.lang, c.k, c.phrase, c.a, l.f AS l, r.f AS r, c1, ({SCALE}::HUGEINT * c.a // (l.f + r.f))::BIGINT AS score FROM cut c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c1], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c1 + 1:c.k], ' ')),
    low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c1) = 1),
    inner_of AS (SELECT lang, a, w, k, n, unnest(list_transform(range(1, k - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase FROM cand, (SELECT unnest(range(2, {LONGEST})) AS n) WHERE n < k),
    held AS (SELECT lang, phrase, max(a) AS longer FROM inner_of GROUP BY lang, phrase),
    alone AS (SELECT low.* FROM low LEFT JOIN held h ON h.lang = low.lang AND h.phrase = low.phrase WHERE h.longer IS NULL OR 100::HUGEINT * h.longer < {COVERED}::HUGEINT * low.a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alone)
    SELECT lang, rank::INT AS rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= {TOP}"""
