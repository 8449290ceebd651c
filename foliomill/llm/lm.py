"""Language-model scoring by context-tree weighting over bytes (operator 3).

A byte is coded as eight binary decisions, the nodes of a tree of 255. Each node has a context tree of its own over the
bytes before; every context keeps Krichevsky-Trofimov counts, and the weighting mixes all of them. The tree refines its contexts step by
step: nothing, the class of the byte before (64 classes), those of two and of three (32 classes each, by the rule in byte_classes), then the
bytes themselves, the last three to DEPTH. So classes are inner nodes that rare contexts fall back on; below them every byte is told from
every other, and every context of DEPTH bytes that occurs is kept, with no bound on their number. A text is coded with an end symbol
(byte 255, which UTF-8 never has), so probabilities of texts sum to one.

Counts of (DEPTH bytes, coded byte), the grams, are dealt by their last three context bytes to buckets. A bucket's task weighs the trees below
those bytes; the driver gets their sums by classes and weighs the rest. The most frequent grams (at most GRAMS of them) are looked up
where the text is; the others, and those that training never had, go to their bucket with their row and get their value there.

The base score is a unigram word model. Its counts cover all training tokens. The most frequent words (at most HEAD of them) are
looked up where the text is; the others are joined by word.

Defined results: null text counts as empty; a null id counts as not held out but is not learned from; with nothing to learn from, every
decision has probability 1/2; repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm.common import id_bucket, lean, own, settle, table, unsettle, with_fields

END = 255
#: Most words whose counts go to every Python worker.
HEAD = 250_000
#: Most grams whose code lengths go to every Python worker.
GRAMS = 1_000_000
BITS_1, BITS_2, BITS_3 = 6, 5, 5
CONTEXTS = 1 << (BITS_1 + BITS_2 + BITS_3)
#: Bytes of context, 4 to 7. A gram is the byte before, the one before that and so on, then the coded byte, from high to low.
DEPTH = 5
#: Bytes of text scored at a time and counted at a time, and entries that a task gathers before it emits their sums.
CHUNK, COUNTED, GATHERED = 2 << 20, 8 << 20, 2 << 20
#: Where no gram is: byte 255 never follows another.
EMPTY = np.uint64(2**64 - 1)


def byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Context classes of a byte: 64 that keep case, and 32 that do not."""
    fine, coarse = np.zeros(256, np.uint32), np.zeros(256, np.uint32)
    for b in range(256):
        c = chr(b)
        if "a" <= c <= "z":
            fine[b], coarse[b] = b - 96, b - 96
        elif "A" <= c <= "Z":
            fine[b], coarse[b] = b - 64 + 26, b - 64
        elif c == " ":
            fine[b], coarse[b] = 0, 0
        elif "0" <= c <= "9":
            fine[b], coarse[b] = 53, 27
        elif c in ".!?":
            fine[b], coarse[b] = 54, 28
        elif c == "\n":
            fine[b], coarse[b] = 56, 29
        elif b < 32:
            fine[b], coarse[b] = 57, 29
        elif b < 128:
            fine[b], coarse[b] = 55, 28
        elif b < 192:
            fine[b], coarse[b] = 58 + (b >> 4 & 3), 30
        else:
            fine[b], coarse[b] = 62 + (b > 0xC3), 31
    return fine, coarse


FINE, COARSE = byte_classes()


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(gram of every byte and end symbol, index of each text's first). Before a text stand zero bytes."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    out = data.astype(np.uint64)
    for depth in range(1, DEPTH + 1):
        before = np.zeros(len(data), np.uint64)
        before[depth:] = data[: len(data) - depth]
        for k in range(depth):  # the first bytes of a text see what stands before it
            before[first[sizes > k] + k] = 0
        before <<= np.uint64(8 * (DEPTH + 1 - depth))
        out |= before
    return out, first


def _byte(gram: np.ndarray, depth: int) -> np.ndarray:
    return (gram >> np.uint64(8 * (DEPTH + 1 - depth)) & np.uint64(255)).astype(np.intp)


def classes(gram: np.ndarray) -> np.ndarray:
    """Context of classes (16 bits) of each gram."""
    return FINE[_byte(gram, 1)] << np.uint32(10) | COARSE[_byte(gram, 2)] << np.uint32(5) | COARSE[_byte(gram, 3)]


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context of classes << 8 | byte of every byte and end symbol, index of each text's first)."""
    gram, first = grams(texts)
    return classes(gram) << np.uint32(8) | (gram & np.uint64(255)).astype(np.uint32), first


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each gram, by its last three context bytes."""
    return ((gram >> np.uint64(8 * (DEPTH - 2))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)


def _sum(code: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        code = np.sort(code)
        edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        return code[edge], np.diff(np.append(edge, len(code)))
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[edge], np.add.reduceat(n, edge) if len(edge) else n[:0]


def _chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def gather(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket int, grams binary, times binary, word binary, n long) over all rows of one text column: sums of parts, of grams (uint64, int64) or of a word (the empty word is the end)."""
    schema = "bucket int, grams binary, times binary, word binary, n long"
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]

    def emit(*columns) -> pa.RecordBatch:
        size = max(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(size, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "grams", "times", "word", "n"])

    def dealt(kept: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        gram, n = _sum(np.concatenate([g for g, _ in kept]), np.concatenate([n for _, n in kept]))
        to = bucket_of(gram, buckets).astype(np.int32)
        order = np.argsort(to, kind="stable")
        found, at = np.unique(to[order], return_index=True)
        gram, n, ends = gram[order], n[order].astype(np.int64), [*at[1:], len(gram)]
        return emit(found, [gram[i:j].tobytes() for i, j in zip(at, ends, strict=True)], [n[i:j].tobytes() for i, j in zip(at, ends, strict=True)], None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        held: list[bytes] = []
        words: Counter = Counter()
        for batch in chain(batches, [None]):
            if batch is not None:
                held += [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(0)]
                if sum(map(len, held)) < COUNTED:
                    continue
            for part in _chunks(held, COUNTED):
                kept.append(_sum(grams(part)[0]))
                for t in part:
                    words.update(t.lower().split())
                words[b""] += len(part)
                if len(words) > 150_000:
                    yield emit(None, None, None, list(words), list(words.values()))
                    words = Counter()
                if sum(len(g) for g, _ in kept) > GATHERED:
                    yield dealt(kept)
                    kept = []
            held = []
        if words:
            yield emit(None, None, None, list(words), list(words.values()))
        if kept:
            yield dealt(kept)
        lean()

    return settle(texts.mapInArrow(run, schema))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x of 1/2 and more: Stirling's series at x + 8, taken back by the product between."""
    y, prod = x + 8.0, np.ones_like(x)
    for k in range(8):
        prod *= x + k
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r / 1260)) / y - np.log(prod)


def _log_gammas(x: np.ndarray, start: float, known: np.ndarray) -> np.ndarray:
    """log gamma of whole numbers x plus start, the small ones from known."""
    out = known[np.minimum(x, len(known) - 1)]
    large = x >= len(known)
    if large.any():
        out[large] = _lgamma(x[large] + start)
    return out


_HALVES, _WHOLES = _lgamma(np.arange(1 << 14) + 0.5), _lgamma(np.arange(1 << 14) + 1.0)


def _kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    out = _log_gammas(n0, 0.5, _HALVES) + _log_gammas(n1, 0.5, _HALVES) - _log_gammas(n0 + n1, 1.0, _WHOLES) - np.log(np.pi)
    out[(n0 + n1) == 0] = 0.0
    return out


def _nodes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the 255 binary nodes (node 1 is the root) from counts of 256 bytes in the last axis."""
    zero, one = np.zeros(counts.shape, np.int64), np.zeros(counts.shape, np.int64)
    for level in range(8):
        split = counts.reshape(*counts.shape[:-1], 1 << level, 2, 128 >> level).sum(-1)
        zero[..., 1 << level : 2 << level], one[..., 1 << level : 2 << level] = split[..., 0], split[..., 1]
    return zero, one


_HALF = np.log(0.5)


class Tree:
    """Weighted probabilities of the tree below one first-context class, depth 1 to 3; below is the log probability of what lies beneath depth 3, by node."""

    def __init__(self, counts: np.ndarray, below: np.ndarray | None = None):
        c3 = counts.reshape(1 << BITS_2, 1 << BITS_3, 256)
        self.n3 = _nodes(c3)
        self.n2 = tuple(x.sum(1) for x in self.n3)
        self.n1 = tuple(x.sum(0) for x in self.n2)
        pw3, self.w3 = _kt(*self.n3), np.ones(c3.shape)
        if below is not None:
            pe3 = pw3
            pw3 = np.logaddexp(_HALF + pe3, _HALF + below.reshape(c3.shape))
            self.w3 = np.exp(_HALF + pe3 - pw3)
        pe2, pe1 = _kt(*self.n2), _kt(*self.n1)
        pw2 = np.logaddexp(_HALF + pe2, _HALF + pw3.sum(1))
        self.pw1 = np.logaddexp(_HALF + pe1, _HALF + pw2.sum(0))
        self.w2, self.w1 = np.exp(_HALF + pe2 - pw2), np.exp(_HALF + pe1 - self.pw1)

    def one(self) -> tuple[np.ndarray, np.ndarray]:
        """(share, rest), each (2^BITS_2, 2^BITS_3, 256): a one has at each node the probability share + rest * that beneath depth 3."""
        p3, p2, p1 = [(n[1] + 0.5) / (n[0] + n[1] + 1.0) for n in (self.n3, self.n2, self.n1)]
        left = (1 - self.w1) * (1 - self.w2)[:, None]
        return self.w1 * p1 + (1 - self.w1) * self.w2[:, None] * p2[:, None] + left * self.w3 * p3, left * (1 - self.w3)


def class_trees(code: np.ndarray, n: np.ndarray, node: np.ndarray | None = None, below: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tree.one() with depth 0 mixed in, for each first class in turn, from counts of codes and sums of log probabilities beneath (context << 8 | node)."""
    order = np.argsort(code)
    code, n = code[order].astype(np.int64), n[order].astype(np.int64)
    size = CONTEXTS * 256 >> BITS_1
    starts = np.arange((1 << BITS_1) + 1) * size
    edges = np.searchsorted(code, starts)
    if node is not None:
        order = np.argsort(node)
        node, below = node[order].astype(np.int64), below[order]
        beneath = np.searchsorted(node, starts)

    def tree(k: int) -> Tree:
        dense = np.zeros(size, np.int64)
        dense[code[edges[k] : edges[k + 1]] - k * size] = n[edges[k] : edges[k + 1]]
        if node is None:
            return Tree(dense)
        sums = np.zeros(size)
        sums[node[beneath[k] : beneath[k + 1]] - k * size] = below[beneath[k] : beneath[k + 1]]
        return Tree(dense, sums)

    below_0, all_ = np.zeros(256), [np.zeros(256, np.int64), np.zeros(256, np.int64)]
    for k in range(1 << BITS_1):
        if edges[k] < edges[k + 1]:
            t = tree(k)
            below_0 += t.pw1
            all_ = [a + b for a, b in zip(all_, t.n1, strict=True)]
    pe0 = _kt(*all_)
    w0 = np.exp(_HALF + pe0 - np.logaddexp(_HALF + pe0, _HALF + below_0))
    p0 = (all_[1] + 0.5) / (all_[0] + all_[1] + 1.0)
    for k in range(1 << BITS_1):
        share, rest = tree(k).one()
        yield w0 * p0 + (1 - w0) * share, (1 - w0) * rest


def code_lengths(code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 probability of each byte after each context of classes (2^24 float32) by the tree of classes alone, from counts of codes."""
    size = CONTEXTS * 256 >> BITS_1
    out = np.empty(CONTEXTS * 256, np.float32)
    for k, (p, _) in enumerate(class_trees(code, n)):
        yes, no = np.log10(p), np.log10(1 - p)
        total = np.zeros(p.shape)
        for level in range(8):
            split = np.stack([no[..., 1 << level : 2 << level], yes[..., 1 << level : 2 << level]], -1)
            total += np.repeat(split.reshape(*p.shape[:-1], 2 << level), 128 >> level, axis=-1)
        out[k * size : (k + 1) * size] = total.reshape(-1)
    return out


def mixture(code: np.ndarray, n: np.ndarray, node: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each context of classes, share and rest of each row and node): rows of the contexts that occur, then one for each first two classes, for the contexts that do not."""
    seen = np.unique(code >> 8).astype(np.int64)
    row = len(seen) + (np.arange(CONTEXTS) >> BITS_3)
    row[seen] = np.arange(len(seen))
    pairs = 1 << (BITS_1 + BITS_2)
    share, rest = np.zeros((len(seen) + pairs, 256)), np.zeros((len(seen) + pairs, 256))
    per = CONTEXTS >> BITS_1
    for k, (s, r) in enumerate(class_trees(code, n, node, below)):
        s, r = s.reshape(per, 256), r.reshape(per, 256)
        here = seen[(seen >= k * per) & (seen < (k + 1) * per)]
        share[row[here]], rest[row[here]] = s[here - k * per], r[here - k * per]
        absent = np.setdiff1d(np.arange(k * per, (k + 1) * per), here)
        share[row[absent]] = s[absent - k * per] + r[absent - k * per] / 2  # any of a pair: all have no counts
    return row, share, rest


class Grams:
    """The trees below three bytes of context, from distinct sorted grams that hold all of their contexts. A gram of no counts changes none and has a value."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        #: by depth, from DEPTH to 3: (context, byte) in order, counts, and the index in the next of each
        self.keys, self.n, self.up = [gram], [n.astype(np.int64)], []
        for _ in range(DEPTH - 3):
            key = self.keys[-1]
            key = key >> np.uint64(16) << np.uint64(8) | key & np.uint64(255)
            order = np.argsort(key, kind="stable")
            key, edge = key[order], np.zeros(len(key), bool)
            edge[:1], edge[1:] = True, key[1:] != key[:-1]
            up = np.empty(len(key), np.int64)
            up[order] = np.cumsum(edge) - 1
            self.up.append(up)
            self.n.append(np.add.reduceat(self.n[-1][order], np.flatnonzero(edge)) if len(key) else self.n[-1])
            self.keys.append(key[edge])

    def level(self, level: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """Of the nodes of one level: by depth (each key's node, its weight, its probability of a one), and at depth 3 each node's first key and log probability."""
        out, first, pw = [], None, None
        for d, (key, n) in enumerate(zip(self.keys, self.n, strict=True)):
            node = key >> np.uint64(8 - level)
            edge = np.zeros(len(key), bool)
            edge[:1], edge[1:] = True, node[1:] != node[:-1]
            at, start = np.cumsum(edge) - 1, np.flatnonzero(edge)
            one = n * (key >> np.uint64(7 - level) & np.uint64(1)).astype(np.int64)
            n_all, n_one = (np.add.reduceat(x, start) if len(start) else n for x in (n, one))
            pe = _kt(n_all - n_one, n_one)
            weight = np.ones(len(pe))
            if d:
                below = np.bincount(at[self.up[d - 1][first]], pw, len(start))
                pw = np.logaddexp(_HALF + pe, _HALF + below)
                weight = np.exp(_HALF + pe - pw)
            else:
                pw = pe
            first = start
            out.append((at, weight, (n_one + 0.5) / (n_all + 1.0)))
        return out, first, pw

    def below(self) -> tuple[np.ndarray, np.ndarray]:
        """(context of classes << 8 | node, sum of the log probabilities of its contexts of three bytes)."""
        key, nodes, logs = self.keys[-1], [], []
        context = classes(key << np.uint64(8 * (DEPTH - 3))).astype(np.int64) << 8
        for level in range(8):
            _, first, pw = self.level(level)
            nodes.append(context[first] | 1 << level | (key[first] & np.uint64(255)).astype(np.int64) >> (8 - level))
            logs.append(pw)
        node, at = np.unique(np.concatenate(nodes), return_inverse=True)
        return node, np.bincount(at, np.concatenate(logs), len(node))

    def lengths(self, row: np.ndarray, share: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's byte after its context."""
        gram = self.keys[0]
        place, byte, out = row[classes(gram)], (gram & np.uint64(255)).astype(np.int64), np.zeros(len(gram))
        for level in range(8):
            found, index = self.level(level)[0], np.arange(len(gram))
            p = found[0][2][found[0][0]]
            for up, (at, weight, one) in zip(self.up, found[1:], strict=True):
                index = up[index]
                w = weight[at[index]]
                p = w * one[at[index]] + (1 - w) * p
            node = 1 << level | byte >> (8 - level)
            p = share[place, node] + rest[place, node] * p
            out += np.log10(np.where(byte >> (7 - level) & 1, p, 1 - p))
        return out


def _joined(grams_: pa.ChunkedArray, times: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(grams_.to_pylist()), np.uint64), np.frombuffer(b"".join(times.to_pylist()), np.int64)


def _scale(n: np.ndarray) -> np.ndarray:
    """Counts on a scale of eighths of a power of two."""
    return np.ceil(np.log2(n) * 8).astype(np.int32)


def grow(parts: DataFrame) -> DataFrame:
    """(kind int, at int, grams binary, times binary, n long, x double): kind 0 a bucket's summed grams, 1 codes of classes with counts, 2 nodes with sums beneath, 3 how many grams a scale has."""
    schema = "kind int, at int, grams binary, times binary, n long, x double"
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.float64()]

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        gram, n = _sum(*_joined(part["grams"], part["times"]))
        tree = Grams(gram, n)
        top = tree.keys[-1]
        code = classes(top << np.uint64(8 * (DEPTH - 3))) << np.uint32(8) | (top & np.uint64(255)).astype(np.uint32)
        code, count = _sum(code, tree.n[-1])
        node, below = tree.below()
        scale, many = np.unique(_scale(n), return_counts=True)
        rows = [(0, key[0].as_py(), gram.tobytes(), n.tobytes(), None, None)]
        out = [pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=names)]
        for kind, at, n_, x in ((1, code, count, None), (2, node, None, below), (3, scale, many, None)):
            columns = [pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.nulls(len(at), kinds[2]), pa.nulls(len(at), kinds[3])]
            columns += [pa.nulls(len(at), k) if v is None else pa.array(v, k) for v, k in ((n_, kinds[4]), (x, kinds[5]))]
            out.append(pa.Table.from_arrays(columns, schema=names))
        return pa.concat_tables(out)

    names = pa.schema(list(zip(("kind", "at", "grams", "times", "n", "x"), kinds, strict=True)))
    return settle(parts.groupBy("bucket").applyInArrow(run, schema))


def _least(scales, head: int) -> int | None:
    """The least scale of the head, so that the head never has more than `head` entries, from (scale, number)."""
    least, so_far = None, 0
    for scale, many in sorted(scales, reverse=True):
        so_far += many
        if so_far > head:
            break
        least = scale
    return least


class Lookup:
    """log10 probabilities of grams in a hash table."""

    def __init__(self, gram: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(len(gram) * 2).bit_length())
        self.keys, self.values = np.full(1 << self.bits, EMPTY), np.zeros(1 << self.bits, np.float32)
        slot, left = self._slot(gram), np.arange(len(gram))
        while len(left):
            free = self.keys[slot[left]] == EMPTY
            self.keys[slot[left[free]]] = gram[left[free]]
            left = left[self.keys[slot[left]] != gram[left]]
            slot[left] = slot[left] + 1 & len(self.keys) - 1
        self.values[slot] = value

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return (gram * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value of each gram, 0 if it is not here; indices of those that are not here)."""
        slot = self._slot(gram)
        key, value = self.keys[slot], self.values[slot]
        left = np.flatnonzero(key != gram)
        value[left] = 0
        absent = [left[key[left] == EMPTY]]
        left = left[key[left] != EMPTY]
        slot = slot[left]
        while len(left):
            slot = slot + 1 & len(self.keys) - 1
            key = self.keys[slot]
            hit, none = key == gram[left], key == EMPTY
            value[left[hit]] = self.values[slot[hit]]
            absent.append(left[none])
            left, slot = left[~(hit | none)], slot[~(hit | none)]
        return value, np.sort(np.concatenate(absent))


def score(docs: DataFrame, learn, text: str = "text", *, head: int = HEAD, gram_head: int = GRAMS) -> DataFrame:
    """docs' columns but the text, then n_tokens, n_known, train_tokens, base_score, score and n_coded (bytes with the end symbol).

    learn is a boolean column: the rows to learn from. Columns of the made names in docs are replaced.
    """
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "n_coded"]
    docs = docs.select(*[c for c in docs.columns if c == text or c not in made])
    keep, spark = [c for c in docs.columns if c != text], docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = gather(docs.filter(learn).select(text), buckets)
    words = settle(found.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    grown = grow(found.filter("bucket is not null").select("bucket", "grams", "times"))
    unsettle(found)
    sums = grown.filter("kind > 0").groupBy("kind", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toArrow()
    kind, at, n, x = [sums[c].to_numpy() for c in ("kind", "at", "n", "x")]
    rest_of = spark.sparkContext.broadcast(mixture(at[kind == 1], n[kind == 1], at[kind == 2], x[kind == 2]))
    least_gram = _least(zip(at[kind == 3].tolist(), n[kind == 3].tolist(), strict=True), gram_head)
    trees = grown.filter("kind = 0").select(F.col("at").alias("bucket"), "grams", "times")

    def known_grams(part: pa.Table) -> pa.Table:
        gram, n = _joined(part["grams"], part["times"])
        is_top = _scale(n) >= least_gram
        value = Grams(gram, n).lengths(*rest_of.value)[is_top].astype(np.float32)
        return pa.table({"grams": pa.array([gram[is_top].tobytes()], pa.binary()), "value": pa.array([value.tobytes()], pa.binary())})

    if least_gram is None:
        lookup = Lookup(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    else:
        top = trees.groupBy("bucket").applyInArrow(known_grams, "grams binary, value binary").toArrow()
        lookup = Lookup(np.frombuffer(b"".join(top["grams"].to_pylist()), np.uint64), np.frombuffer(b"".join(top["value"].to_pylist()), np.float32))
    lengths = spark.sparkContext.broadcast(lookup)
    n_all, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    scale = F.ceil(F.log2("n") * 8).cast("int")
    least = _least([(r["s"], r["count"]) for r in words.groupBy(scale.alias("s")).count().collect()], head)
    is_head = (scale >= least) if least is not None else F.lit(False)
    top = words.filter(is_head).select("word", "n").toArrow()
    shared = spark.sparkContext.broadcast((top["word"].to_pylist(), np.log10(top["n"].to_numpy() + 1.0)))
    names = {c: own(docs, f"lm_{c}") for c in ("row", "tokens", "known", "sum", "score", "coded", "tail", "times", "grams", "often", "bucket")}
    types = ("long", "long", "long", "double", "double", "long", "array<binary>", "array<int>", "array<long>", "array<int>", "array<int>")
    schema = with_fields(docs.select(*keep).schema, dict(zip(names.values(), types, strict=True)))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32())]

    def others(gram: np.ndarray, first: np.ndarray, absent: np.ndarray) -> list[pa.Array]:
        """Of each text the grams that the lookup does not have, how often, and their buckets."""
        of, gram = np.searchsorted(first, absent, "right") - 1, gram[absent]
        order = np.lexsort((gram, of))
        of, gram = of[order], gram[order]
        edge = np.ones(len(of), bool)
        edge[1:] = (of[1:] != of[:-1]) | (gram[1:] != gram[:-1])
        start = np.flatnonzero(edge)
        offsets = pa.array(np.searchsorted(of[start], np.arange(len(first) + 1)).astype(np.int32))
        often = np.diff(np.append(start, len(of))).astype(np.int32)
        return [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (gram[start].view(np.int64), often, bucket_of(gram[start], buckets).astype(np.int32))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, (word, logs), row = lengths.value, shared.value, TaskContext.get().partitionId() << 40
        known = dict(zip(word, logs.tolist(), strict=True))
        for batch in batches:
            raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column(batch.schema.get_field_index(text))]
            rest, done = batch.select(keep), 0
            for part in _chunks(raw):
                gram, first = grams(part)
                value, absent = table_.get(gram)
                scores = np.add.reduceat(value, first, dtype=np.float64)
                rows = []
                for t, s in zip(part, scores.tolist(), strict=True):
                    tokens = t.lower().split()
                    tokens.append(b"")
                    got = [known.get(w) for w in tokens]
                    if None in got:
                        tail = Counter(w for w, g in zip(tokens, got, strict=True) if g is None)
                        got = [g for g in got if g is not None]
                    else:
                        tail = {}
                    rows.append((row, len(tokens), len(got), sum(got), s, len(t) + 1, list(tail), list(tail.values())))
                    row += 1
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                columns += others(gram, first, absent)
                yield pa.RecordBatch.from_arrays([*rest.slice(done, len(part)).columns, *columns], [*keep, *names.values()])
                done += len(part)

    rows = settle(docs.mapInArrow(run, schema))
    r, tokens, known, total, said, coded, tail, times, absent_, often, bucket = names.values()

    def in_bucket(key: tuple[pa.Scalar, ...], tree: pa.Table, asked: pa.Table) -> pa.Table:
        gram, n = _joined(tree["grams"], tree["times"])
        wanted, at = np.unique(asked["gram"].to_numpy().view(np.uint64), return_inverse=True)
        every = np.concatenate([gram, np.setdiff1d(wanted, gram, assume_unique=True)])
        order = np.argsort(every, kind="stable")
        every = every[order]
        value = Grams(every, np.concatenate([n, np.zeros(len(every) - len(n), np.int64)])[order]).lengths(*rest_of.value) if len(wanted) else np.zeros(0)
        row, of = np.unique(asked["row"].to_numpy(), return_inverse=True)
        worth = value[np.searchsorted(every, wanted)][at] * asked["k"].to_numpy()
        return pa.table({"row": pa.array(row, pa.int64()), "x": pa.array(np.bincount(of, worth, len(row)), pa.float64())})

    asked = rows.filter(F.size(absent_) > 0).select(F.col(r).alias("row"), F.explode(F.arrays_zip(F.col(bucket).alias("b"), F.col(absent_).alias("g"), F.col(often).alias("k"))).alias("x"))
    asked = asked.select("row", F.col("x.b").alias("bucket"), F.col("x.g").alias("gram"), F.col("x.k").alias("k"))
    valued = trees.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(in_bucket, "row long, x double").groupBy("row").agg(F.sum("x").alias("x"))
    valued = valued.select(F.col("row").alias(own(docs, "lm_at")), F.col("x").alias(own(docs, "lm_value")))
    rare = rows.filter(F.size(tail) > 0).select(F.col(r).alias("row"), F.explode(F.arrays_zip(F.col(tail).alias("w"), F.col(times).alias("k"))).alias("x"))
    rare = rare.select("row", F.col("x.w").alias("word"), F.col("x.k").alias("k"))
    found = rare.join(words.filter(~is_head).select("word", "n"), "word").groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("rest"))
    found = found.select(F.col("row").alias(own(docs, "lm_of")), F.col("more").alias(own(docs, "lm_more")), F.col("rest").alias(own(docs, "lm_rest")))
    out = rows.join(found, F.col(r) == F.col(found.columns[0]), "left").join(valued, F.col(r) == F.col(valued.columns[0]), "left")
    base = F.col(total) + F.coalesce(F.col(found.columns[2]), F.lit(0.0)) - F.col(tokens) * F.lit(float(np.log10(n_all + v + 1.0)))
    more = (F.col(known) + F.coalesce(F.col(found.columns[1]), F.lit(0))).cast("long")
    return out.select(*keep, F.col(tokens).alias("n_tokens"), more.alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col(said) + F.coalesce(F.col(valued.columns[1]), F.lit(0.0))).alias("score"), F.col(coded).alias("n_coded"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.coalesce(id_bucket(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out"), "text")
    out = score(rows, id_bucket(F.col("doc_id"), 7) != 2)
    return out.withColumn("bits_per_byte", -F.col("score") / F.lit(float(np.log10(2))) / F.col("n_coded")).drop("n_coded")
