"""Near-duplicate documents by DartMinHash (operator 4).

A document is the weighted set of its five-word shingles, a shingle's weight being how often it occurs. Darts are thrown at each
element's region: a Poisson process along the rank axis, drawn from the element's hash, so that documents that share an element share
its darts. Each dart hits one of K coordinates; the earliest dart of a coordinate is its minimum. Only darts up to a rank of about
(K ln K + 3 K) / weight are thrown, further ones only where a coordinate is still open. Two signatures agree in a coordinate with the
probability of the weighted Jaccard similarity. BANDS keys of ROWS coordinates each deal documents into buckets; a pair at 0.8 misses
all of them with a probability of 2e-4.

Equal texts (by two 64-bit hashes) are one class. In each bucket all are compared with a hub first, pair by pair. Buckets that then
still hold several components are put together by the largest component in them, their host; the members of such a unit are dealt
into blocks of bounded size, and each two blocks form a tile in which all are compared by counting shared elements. A tile returns
only a spanning forest of the components that its links join, so rows grow with members, never with pairs. All comparisons are exact,
on 64-bit hashes of the shingles' occurrences.

Defined results: null texts and such without words link with nothing and are kept; texts of one to four words are one shingle; very
long texts are taken whole; rows with the same id and text are one document; clusters are named by their least doc_id (null ids count
as the largest); of two texts with one id the less by hash stands for it; an empty table gives no rows; other columns, whatever their
names, are not read, and the pipeline stage returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm.common import aside, components, fold, joined_components, lean, own, settle, table, unsettle

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 36, 7
K = BANDS * ROWS
#: Members and elements of a block on average; a tile holds two blocks.
BLOCK, BLOCK_ELEMENTS = 1024, 1 << 20
#: Elements that up to so many members of a tile share are counted pair by pair, others by a matrix product.
FEW = 96
CHUNK = 1 << 19

_P = np.uint64(0x9E3779B97F4A7C15)
_PRIMES = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Shingler:
    """Hashes of shingles, many texts at a time."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n + 1:
            n = max(n + 1, CHUNK + CHUNK // 4)
            with np.errstate(over="ignore"):
                self.power = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, _P))])
                self.inverse = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, np.uint64(pow(int(_P), -1, 1 << 64))))])

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, its text's index)."""
        joined = b" ".join(texts) + b" "
        data = np.frombuffer(joined, np.uint8)
        self._grow(len(data))
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.diff(np.concatenate([[1], blank.view(np.int8), [1]]))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)])])
            h = mix((total[stop] - total[start]) * self.inverse[start] + (stop - start).astype(np.uint64) * _PRIMES[0])
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        return h, np.searchsorted(np.cumsum(sizes), start, side="right")

    def elements(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(element, text index), by text: one element for each occurrence of each shingle, equal across texts for equal occurrence numbers."""
        h, of = self.words(texts)
        n = np.bincount(of, minlength=len(texts))
        first = np.cumsum(n) - n
        with np.errstate(over="ignore"):
            long = len(h) - WORDS + 1
            s, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if long > 0:
                inside = of[:long] == of[WORDS - 1 :]
                s = sum((h[j : long + j] * _PRIMES[j] for j in range(WORDS)), np.zeros(long, np.uint64))[inside]
                at = of[:long][inside]
            short = np.flatnonzero((n > 0) & (n < WORDS))
            if len(short):
                one = n[short].astype(np.uint64) * _P
                for j in range(WORDS - 1):
                    has = n[short] > j
                    one[has] += h[first[short[has]] + j] * _PRIMES[j]
                s, at = np.concatenate([s, one]), np.concatenate([at, short])
            s = mix(s)
            order = np.lexsort((s, at))
            s, at = s[order], at[order]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (at[1:] != at[:-1])
            begin = np.flatnonzero(new)
            nth = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
            return mix(s + nth.astype(np.uint64) * _P), at


def darts(element: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the element, dart, rank) of all darts under each element's limit: arrivals of a Poisson process of rate one."""
    at, rank, turn = np.arange(len(element)), np.zeros(len(element)), 0
    while len(at):
        many = 1 if len(at) > 20_000 else 32
        with np.errstate(over="ignore"):
            nth = np.arange(turn + 1, turn + many + 1, dtype=np.uint64) * _PRIMES[1]
            dart = mix(element[at][:, None] + nth)
        step = -np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        ranks = rank[:, None] + np.cumsum(step, axis=1)
        hit = ranks < limit[at][:, None]
        i, j = np.nonzero(hit)
        yield at[i], dart[i, j], ranks[i, j]
        alive = hit[:, -1]
        at, rank, turn = at[alive], ranks[alive, -1], turn + many


def signatures(element: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """(n, K): the earliest dart of each coordinate; rows of texts without elements are zero."""
    weight = np.bincount(of, minlength=n)
    out, open_ = np.zeros(n * K, np.uint64), weight > 0
    reach = K * np.log(K) + 3 * K
    while open_.any():
        mine = open_[of]
        e, d = element[mine], of[mine]
        best = np.full(n * K, np.inf)
        for i, dart, rank in darts(e, reach / weight[d]):
            with np.errstate(over="ignore"):
                slot = d[i] * K + (mix(dart * _PRIMES[2]) % np.uint64(K)).astype(np.int64)
            order = np.argsort(-rank, kind="stable")  # of equal slots the last one stays, the earliest dart
            slot, dart, rank = slot[order], dart[order], rank[order]
            low = np.full(n * K, np.inf) if len(slot) > n * K // 8 else None
            if low is None:
                keep = rank < best[slot]
                slot, dart, rank = slot[keep], dart[keep], rank[keep]
                out[slot], best[slot] = dart, rank
            else:
                won = np.zeros(n * K, np.uint64)
                low[slot], won[slot] = rank, dart
                better = low < best
                out[better], best[better] = won[better], low[better]
        open_ = open_ & np.isinf(best).reshape(n, K).any(1)
        reach *= 2
    return out.reshape(n, K)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(n, BANDS): one 64-bit key for each band."""
    with np.errstate(over="ignore"):
        rows = mix(signature.reshape(len(signature), BANDS, ROWS) + np.arange(1, ROWS + 1, dtype=np.uint64) * _P)
        total = (rows * np.arange(3, 2 * ROWS + 3, 2, dtype=np.uint64)).sum(-1, dtype=np.uint64)
        return mix(total + np.arange(1, BANDS + 1, dtype=np.uint64) * _PRIMES[3])


def _parts(texts: Iterable[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first, part, size = 0, [], 0
    for i, t in enumerate(texts):
        part.append(t)
        size += len(t)
        if size >= CHUNK or len(part) >= 2000:
            yield first, part
            first, part, size = i + 1, [], 0
    if part:
        yield first, part


def _raw(column: pa.Array) -> Iterator[bytes]:
    return ((t.as_py() or "").encode("utf-8", "surrogatepass") for t in column)


def sign(rows: DataFrame) -> DataFrame:
    """(d, h1, h2, w, keys) from (d, h1, h2, text): weight and band keys of the texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for first, part in _parts(_raw(batch.column(3))):
                element, of = shingler.elements(part)
                w = np.bincount(of, minlength=len(part))
                keys = band_keys(signatures(element, of, len(part))).astype(np.int64)
                on = np.flatnonzero(w)
                rest = batch.select([0, 1, 2]).slice(first, len(part)).take(pa.array(on))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(on) + 1) * BANDS, pa.int32()), pa.array(keys[on].reshape(-1)))
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(w[on].astype(np.int64)), lists], ["d", "h1", "h2", "w", "keys"])
            lean()

    return rows.mapInArrow(run, "d long, h1 long, h2 long, w long, keys array<long>")


def _shingled(rows: DataFrame) -> DataFrame:
    """(c, e) from (c, text): the elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for first, part in _parts(_raw(batch.column(1))):
                element, of = shingler.elements(part)
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(part)))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(element.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), lists], ["c", "e"])
            lean()

    return rows.mapInArrow(run, "c long, e array<long>")


def _linked(pairs: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of pairs (a, b) with a similarity of at least threshold."""
    left, right = elements.select(F.col("c").alias("a"), F.col("e").alias("ea")), elements.select(F.col("c").alias("b"), F.col("e").alias("eb"))
    both = F.size(F.array_intersect("ea", "eb"))
    rows = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", (both / (F.size("ea") + F.size("eb") - both)).alias("j"))
    return rows.filter(F.col("j") >= threshold).select("a", "b")


def shared(value: np.ndarray, owner: np.ndarray, component: np.ndarray, n: int) -> np.ndarray:
    """(n, n): at i < j how many values owners i and j share, as far as other owners' components differ. An owner has a value once."""
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(value)))
    of = component[owner]
    on = count > 1
    if on.any():
        low, high = np.minimum.reduceat(of, start), np.maximum.reduceat(of, start)
        on &= low != high
    start, count = start[on], count[on]
    out = np.zeros(n * n, np.int32)
    kept, size = [], 0
    for k in np.unique(count[count <= FEW]):
        begin = start[count == k]
        for i in range(0, len(begin), 1 + 200_000 // int(k * k)):
            member = owner[begin[i : i + 1 + 200_000 // int(k * k), None] + np.arange(k)]
            x, y = np.triu_indices(k, 1)
            kept.append((member[:, x] * n + member[:, y]).reshape(-1))
            size += len(kept[-1])
            if size > 2_000_000:
                out += np.bincount(np.concatenate(kept), minlength=n * n).astype(np.int32)
                kept, size = [], 0
    if kept:
        out += np.bincount(np.concatenate(kept), minlength=n * n).astype(np.int32)
    out = out.reshape(n, n)
    many = np.flatnonzero(count > FEW)
    for i in range(0, len(many), 1024):
        some = many[i : i + 1024]
        has = np.zeros((n, len(some)), np.float32)
        at = np.concatenate([np.arange(start[m], start[m] + count[m]) for m in some])
        has[owner[at], np.repeat(np.arange(len(some)), count[some])] = 1
        out += (has @ has.T).astype(np.int32)
    return out


def tile_forest(host: np.ndarray, component: np.ndarray, sizes: np.ndarray, elements: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of components that links inside each host's members join: a spanning forest."""
    n = len(host)
    units, unit = np.unique(host, return_inverse=True)
    names, of = np.unique(component, return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    if len(units) > 1:
        elements = elements ^ mix(unit.astype(np.uint64) * _P)[owner]
    both = shared(elements, owner, of, n)
    i, j = np.nonzero(both)
    on = (i < j) & (of[i] != of[j]) & (unit[i] == unit[j])
    i, j = i[on], j[on]
    b = both[i, j].astype(np.int64)
    near = b / (sizes[i] + sizes[j] - b) >= threshold
    root = fold(np.arange(len(names)), of[i[near]], of[j[near]])
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def _compared(units: DataFrame, elements: DataFrame, threshold: float, block: int, block_elements: int) -> DataFrame:
    """(a, b): components to join, from units (host, c, w, component): all members of a host are compared in tiles."""
    per = units.groupBy("host").agg(F.count("*").alias("n"), F.sum("w").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("total") / block_elements), F.lit(1)).cast("int")
    per = settle(per.withColumn("blocks", blocks))
    n, total = per.filter("blocks = 1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    packs = int(max(1, -(-n // block), -(-int(total) // block_elements)))
    rows = units.join(per.select("host", "blocks"), "host")
    mine = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    # a tile of two blocks compares within each of them too, so no block meets itself
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("mine"))
    large = rows.filter("blocks > 1").withColumn("mine", mine).withColumn("o", F.explode(others))
    large = large.select(F.col("host").alias("g"), F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"), "host", "c", "component")
    small = rows.filter("blocks = 1").select(F.pmod(F.xxhash64("host"), F.lit(packs)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "host", "c", "component")
    tiles = large.unionByName(small).join(elements.hint("merge"), "c")

    def compare(group: pa.Table) -> pa.Table:
        e = group["e"].combine_chunks()
        sizes = np.diff(e.offsets.to_numpy()).astype(np.int64)
        a, b = tile_forest(group["host"].to_numpy(), group["component"].to_numpy(), sizes, e.flatten().to_numpy().view(np.uint64), threshold)
        lean()
        return pa.table({"a": a, "b": b})

    made = settle(tiles.groupBy("g", "i", "j").applyInArrow(compare, "a long, b long"))
    unsettle(per)
    return made


def near_duplicates(docs: DataFrame, text: str = "text", *, threshold: float = THRESHOLD, block: int = BLOCK, block_elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """(doc_id, c, c2, n_rows, class_id, cluster_id, kept): one row for each distinct doc_id and text, c and c2 being the text's hashes (null for null).

    class_id is the least doc_id with the same text, cluster_id the least of the component; one row of each cluster is kept.
    """
    said = F.col(text).isNotNull()
    keyed = docs.select(F.col("doc_id").cast("long").alias("d"), F.when(said, F.xxhash64(text)).alias("h1"), F.when(said, F.xxhash64(F.lit(1), text)).alias("h2"), F.col(text).alias("text"))
    every = settle(keyed.groupBy("d", "h1", "h2").agg(F.count("*").alias("n_rows")))
    signed = settle(sign(keyed))
    classes = signed.groupBy("h1", "h2").agg(F.min("d").alias("d"), F.first("w").alias("w"), F.first("keys").alias("keys"))
    # numbers, as two hashes are no node; they hold once the table is written
    classes = settle(classes.withColumn("c", F.monotonically_increasing_id()))
    unsettle(signed)
    dealt = settle(classes.select("c", "w", F.explode("keys").alias("key")))
    hubs = dealt.groupBy("key").agg(F.min("c").alias("hub"), F.min_by("w", "c").alias("hub_w"), F.count("*").alias("n")).filter("n > 1")
    members = settle(dealt.join(hubs, "key").select("key", "c", "w", "n", "hub", "hub_w"))
    unsettle(dealt)
    some = classes.join(members.select("c").distinct(), "c", "left_semi").select("c", "h1", "h2", F.coalesce("d", F.lit(-1)).alias("dk"))
    # one row of each class, chosen before its text is read
    sources = keyed.filter(said).withColumn("dk", F.coalesce("d", F.lit(-1))).groupBy("h1", "h2", "dk").agg(F.first("text").alias("text"))
    elements = settle(_shingled(sources.join(some.hint("merge"), ["h1", "h2", "dk"]).select("c", "text")))

    near = F.least("w", "hub_w") >= F.greatest("w", "hub_w") * threshold
    pairs = settle(members.filter((F.col("c") != F.col("hub")) & near).select(F.col("hub").alias("a"), F.col("c").alias("b")).distinct())
    edges = settle(_linked(pairs, elements, threshold))
    unsettle(pairs)
    parts = components(edges)
    unsettle(edges)

    # buckets where members that were not compared with each other lie in different components
    rows = members.filter("n > 2").join(parts.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    other = F.when(F.col("c") != F.col("hub"), F.col("component"))
    open_ = rows.groupBy("key").agg(F.min(other).alias("low"), F.max(other).alias("high")).filter("low != high").select("key")
    live = settle(rows.join(open_, "key").select("key", "c", "w", "component"))
    unsettle(members)
    if not live.isEmpty():
        size = live.select("c", "component").distinct().groupBy("component").agg(F.count("*").alias("size"))
        hosts = live.join(size, "component").groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("host"))
        units = settle(live.join(hosts, "key").select("host", "c", "w", "component").distinct())
        fresh = _compared(units, elements, threshold, block, block_elements)
        if not fresh.isEmpty():
            before, parts = parts, joined_components(parts, fresh)
            unsettle(before)
        unsettle(units)
        unsettle(fresh)
    unsettle(live)
    unsettle(elements)

    of = every.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("d").alias("class_id"))
    of = of.join(classes.select("h1", "h2", "c"), ["h1", "h2"], "left").join(parts.withColumnRenamed("node", "c"), "c", "left")
    of = settle(of.select("h1", "h2", "c", "class_id", F.coalesce("component", "c").alias("component")))
    unsettle(classes)
    unsettle(parts)
    first = F.min(F.struct(F.col("class_id").isNull().alias("z"), "class_id", "h1", "h2")).alias("f")
    best = of.filter("component is not null").groupBy("component").agg(first)
    of = of.join(best, "component", "left").select("h1", "h2", "c", "class_id", "f")
    out = every.join(of, ["h1", "h2"], "left")
    alone = F.col("c").isNull()
    stays = F.col("d").eqNullSafe(F.col("f.class_id")) & (F.col("h1") == F.col("f.h1")) & (F.col("h2") == F.col("f.h2"))
    return out.select(F.col("d").alias("doc_id"), F.col("h1").alias("c"), F.col("h2").alias("c2"), "n_rows", F.when(alone, F.col("d")).otherwise(F.col("class_id")).alias("class_id"),
                      F.when(alone, F.col("d")).otherwise(F.col("f.class_id")).alias("cluster_id"), (alone | stays).alias("kept"))


def op4_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "cluster_id", "kept", "n_rows")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each cluster stays."""
    found = near_duplicates(docs.select("doc_id", "text")).filter("kept").select("doc_id", "c", "c2", "n_rows")
    found, x = aside(settle(found), docs)
    c, c2 = own(docs, "this_hash"), own(docs, "that_hash")
    said = F.col("text").isNotNull()
    rows = docs.withColumns({c: F.when(said, F.xxhash64("text")), c2: F.when(said, F.xxhash64(F.lit(1), "text"))})
    on = F.col("doc_id").eqNullSafe(F.col(x["doc_id"])) & F.col(c).eqNullSafe(F.col(x["c"])) & F.col(c2).eqNullSafe(F.col(x["c2"]))
    once = rows.join(found.filter(F.col(x["n_rows"]) == 1).hint("merge"), on, "left_semi").select(*docs.columns)
    again = rows.join(found.filter(F.col(x["n_rows"]) > 1).hint("merge"), on, "left_semi")
    again = again.groupBy("doc_id", c, c2).agg(*[F.first(y).alias(y) for y in docs.columns if y != "doc_id"]).select(*docs.columns)
    return once.unionByName(again)
