"""Packing by concatenating and cutting (operator 5).

Pass one tokenises each partition, writes its documents with their start within the partition, and so has the partition's
total. Prefix sums over the totals (one row for each partition) give each partition's place in one endless sequence. Pass two
cuts every document at the fixed windows of that sequence; a document that crosses a boundary yields one record on each side.

Defined results: null text counts as empty and has only the end id; only the last sequence is short, and is padded
unless it holds a power of two; rows are packed as they are stored, repeated rows as often as they occur; no rows give no pieces.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm.common import aside, lean, own, settle, table, with_fields

WINDOW = 2048
END_ID = 1
#: Words whose ids a Python worker keeps in each of two generations, from task to task.
REMEMBERED = 450_000
#: Rows and bytes of an Arrow batch that goes back to Spark.
BATCH_BYTES = 4 << 20
#: Characters that are tokenised at a time, in whole texts.
BATCH_CHARS = 4 << 20


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of whole texts, word by word.

    This tokenizer drops white space and never joins what white space parts, so a text's ids are those of its pieces between
    spaces and line ends. Of ASCII text, case does not matter, and a mark after a letter is a word of its own. Texts that may hold
    a special token's string go to the tokenizer as they are.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads for all would wait for each other
        from tokenizers import Tokenizer

        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(1 << 16, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Words of letters only are encoded many in one text, and parted where a token ends a word; others one by one."""
        letters, out = [w for w in words if w.isalpha()], {}
        for i in range(0, len(letters), 2000):
            some = letters[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u2")
            raw, ends = ids.tobytes(), [0, *(2 * np.flatnonzero(self.ends_word[ids]) + 2).tolist()]
            if len(ends) == len(some) + 1:
                out.update(zip(some, [raw[x:y] for x, y in zip(ends, ends[1:], strict=False)], strict=True))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self._encode(rest), strict=True))
        return [out[w] for w in words]

    def _learn(self, words: set[str]) -> None:
        """Have the ids of all these words in self.known."""
        if len(self.known) > self.remembered:
            self.older, self.known = self.known, {}
        known, older, marks, split = self.known, self.older, ".,;:!?", []
        parts: set[str] = set()
        for w in words.difference(known):
            if w in older:
                known[w] = older[w]
                continue
            tail = w[-1:] if len(w) > 1 and w[-1] in marks and w[-2].isalpha() else ""
            base = w[:-1] if tail else w
            if tail:
                split.append((w, base, tail))
                parts.add(tail)
            parts.add(base)
        left = parts.difference(known)
        for w in [x for x in left if x in older]:
            known[w] = older[w]
            left.discard(w)
        new = list(left)
        known.update(zip(new, self._encode_words(new), strict=True))
        for w, base, tail in split:
            known[w] = known[base] + known[tail]

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        parts = [None if "<|" in t else (t.lower() if t.isascii() else t).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        self._learn(set().union(*[p for p in parts if p is not None]))
        known = self.known
        return [self._encode([t])[0] if p is None else b"".join([known[w] for w in p]) for t, p in zip(texts, parts, strict=True)]


_of_worker: dict[tuple[str, int], WordIds] = {}


def worker_ids(path: str, remembered: int = REMEMBERED) -> WordIds:
    """One for each Python worker, which Spark uses for many tasks."""
    if (path, remembered) not in _of_worker:
        _of_worker[path, remembered] = WordIds(path, remembered)
    return _of_worker[path, remembered]


def tokenise(docs: DataFrame, text: str = "text", *, path: str | None = None, remembered: int = REMEMBERED, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """docs (without their text) with part, part_start, n_tokens and token_ids (little-endian unsigned 16 bit, the end id included)."""
    path = path or vocabulary()
    keep = [c for c in docs.columns if c != text]
    inner = [own(docs, c) for c in ("part", "part_start", "n_tokens", "token_ids")]
    schema = with_fields(docs.select(*keep).schema, dict(zip(inner, ("int", "long", "long", "binary"), strict=True)))
    end = np.array([END_ID], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, start = worker_ids(path, remembered), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, rest = batch.column(batch.schema.get_field_index(text)), batch.select(keep)
            i = 0
            while i < batch.num_rows:
                some, size = [], 0
                first = i
                while i < batch.num_rows and size < batch_chars:
                    some.append(texts[i].as_py() or "")
                    size += len(some[-1])
                    i += 1
                ids = [x + end for x in words.many(some)]
                n = np.array([len(x) // 2 for x in ids], np.int64)
                ends = start + np.cumsum(n)
                columns = [pa.array(np.full(len(ids), part, np.int32)), pa.array(ends - n), pa.array(n), pa.array(ids, pa.binary())]
                start = int(ends[-1])
                yield pa.RecordBatch.from_arrays([*rest.slice(first, i - first).columns, *columns], [*keep, *inner])
            lean()

    return docs.mapInArrow(run, schema)


def pack(docs: DataFrame, text: str = "text", *, window: int = WINDOW, path: str | None = None, remembered: int = REMEMBERED, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """Pieces: docs' columns but the text, then sequence_id, offset, start, length, doc_tokens, padding (of its sequence) and ids
    (little-endian unsigned 32 bit). Columns of these names in docs are replaced."""
    made = ["sequence_id", "offset", "start", "length", "doc_tokens", "padding", "ids"]
    docs = docs.select(*[c for c in docs.columns if c == text or c not in made])
    inner = [own(docs, c) for c in ("part", "part_start", "n_tokens", "token_ids")]
    keep = [c for c in docs.columns if c != text]
    stored = settle(tokenise(docs, text, path=path, remembered=remembered, batch_chars=batch_chars))
    part, start, n, ids = inner
    # one row for each partition of pass one
    totals = stored.groupBy(F.col(part).alias("p")).agg(F.sum(n).alias("t"))
    rows = sorted((r["p"], r["t"]) for r in totals.collect())
    total = sum(t for _, t in rows)
    bases, base = [], 0
    for p, t in rows:
        bases.append((p, base))
        base += t
    spark = docs.sparkSession
    before, x = aside(spark.createDataFrame(bases or [(0, 0)], "p int, base long"), stored)
    placed = stored.join(F.broadcast(before), F.col(part) == F.col(x["p"])).select(*keep, (F.col(x["base"]) + F.col(start)).alias(x["base"]), n, ids)
    tail = total % window
    last, short = (total // window, 0 if tail & (tail - 1) == 0 else window - tail) if tail else (-1, 0)
    schema = with_fields(docs.select(*keep).schema, dict(zip(made, [*["long"] * 6, "binary"], strict=True)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, count = batch.column(len(keep)).to_numpy(), batch.column(len(keep) + 1).to_numpy()
            pieces = (at + count - 1) // window - at // window + 1
            i = 0
            while i < batch.num_rows:
                first, size = i, 0
                while i < batch.num_rows and size < BATCH_BYTES:
                    size += int(count[i]) * 4
                    i += 1
                of = np.repeat(np.arange(first, i), pieces[first:i])
                k = np.arange(len(of)) - np.repeat(np.cumsum(pieces[first:i]) - pieces[first:i], pieces[first:i])
                sequence = at[of] // window + k
                begin = np.maximum(at[of], sequence * window)
                stop = np.minimum(at[of] + count[of], (sequence + 1) * window)
                out = []
                for r in range(first, i):
                    wide = np.frombuffer(batch.column(len(keep) + 2)[r].as_buffer(), "<u2").astype("<u4")
                    for x in np.nonzero(of == r)[0] if pieces[r] > 64 else range(*np.searchsorted(of, [r, r + 1])):
                        out.append(wide[begin[x] - at[r] : stop[x] - at[r]].tobytes())
                columns = [sequence, begin - sequence * window, begin - at[of], stop - begin, count[of], np.where(sequence == last, short, 0)]
                rest = batch.select(keep).take(pa.array(of)) if keep else None
                yield pa.RecordBatch.from_arrays([*(rest.columns if keep else []), *[pa.array(c.astype(np.int64)) for c in columns], pa.array(out, pa.binary())], [*keep, *made])

    return placed.mapInArrow(cut, schema)


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padding")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces with their ids and a checksum of them. Workers keep fewer words than op5's, beside what earlier stages left in executors."""
    return pack(docs.select("doc_id", "text"), remembered=REMEMBERED // 3, batch_chars=BATCH_CHARS // 4).withColumn("ids_crc32", F.crc32("ids"))
