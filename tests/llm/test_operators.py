"""Each operator against brute force on a small table, and on a table of odd rows."""

import base64
import gzip
import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict
from functools import cache
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomill.llm import language, lines, lm, mixing, near_dups, packing, secret_scan, transport, urls, vectors
from foliomill.llm.common import components, joined_components, n_words
from foliomill.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"wort{i % 977} und" for i in range(60_000))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "  \n\t ", "en", "a", 5),
    (None, "the cat sat on the mat and then it slept", "en", None, 40),
    (4, "the cat sat on the mat and then it slept", "en", "b", 40),
    (4, "the cat sat on the mat and then it slept", "en", "b", 40),
    (5, LONG, "de", "a", len(LONG)),
    (6, "12345 !!! ???", None, "c", 13),
    (7, "ein\u00fc \u65e5\u672c\u8a9e \U0001f600 text", "de", "\u00e9", 12),
    (None, None, None, None, None),
]
#: Names that operators use inside or make.
CLASH = ["part", "part_start", "n_tokens", "token_ids", "ids", "ts", "spans", "removed", "score", "lang_pred", "d", "c", "t", "k", "key", "w", "copies", "size", "row_hash", "base", "predicted", "text_hash", "n_rows"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r["doc_id"]: r for r in docs.collect()}


def run(name, spark, sf):
    return QUERIES[next(x for x in QUERIES if x.startswith(name + "_"))](spark, sf).collect()


def words(text):
    return WORD.findall(text or "")


# 1 mixing


def water(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in out]
        level = left / sum(w[s] for s in free) if free else 0
        full = [s for s in free if w[s] * level > most * sizes[s] + 1e-9]
        if not full:
            return out | {s: w[s] * level for s in free}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]


def test_mix_targets_and_copies(spark, sf, rows):
    got = run("op1", spark, sf)
    sizes, largest = Counter(), defaultdict(int)
    for r in rows.values():
        n = len(words(r["text"]))
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    want, taken = water(sizes), Counter()
    assert len(got) == len(rows)
    for r in got:
        s = rows[r["doc_id"]]["source"]
        assert r["size"] == len(words(rows[r["doc_id"]]["text"]))
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, run("op1", spark, sf)))


def test_pivotal_rounding_keeps_mass_and_expectation(spark):
    units = spark.range(300).select(F.lit("s").alias("source"), F.col("id"), F.lit(0.3).alias("p"), (1.0 + F.col("id") % 7).alias("w"))
    total = sum(0.3 * (1 + i % 7) for i in range(300))
    counts = Counter()
    for seed in range(6):
        got = mixing.round_copies(units, seed=seed, fan_in=16).collect()
        assert len(got) == 300 and {r["up"] for r in got} <= {0, 1}
        assert abs(sum(r["up"] * (1 + r["id"] % 7) for r in got) - total) <= 7
        counts.update(r["id"] for r in got if r["up"])
    assert abs(sum(counts.values()) / 6 / 300 - 0.3) < 0.05


def test_mix_odd_rows(spark, odd, clashing):
    for table in (odd, clashing):
        got = mixing._each_row(mixing.mix(table)).collect()
        assert len(got) == len(ODD)
        assert all(r["size"] == 0 for r in got if r["doc_id"] == 1)
        assert mixing.mixed_documents(spark, table, "").columns == table.columns
    twice = [r["copies"] for r in got if r["doc_id"] == 4]
    assert len(twice) == 2 and abs(twice[0] - twice[1]) <= 1
    assert mixing._each_row(mixing.mix(odd.limit(0))).count() == 0
    out = mixing.mixed_documents(spark, odd, "")
    copies = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert copies[5] <= 2


# 2 URLs


def url_parts(url):
    if not url or "://" not in url:
        return "", ""
    m = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def url_rule(host, path):
    fits = [(r, v) for r, v in urls.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?q#f", "http://net/", "http://net", "http://xnet/a", "ftp://U@\u00c9x.org:80/fr/://y", "http://example.com/de/a", "http://evilexample.com/de/", "a://b?c/d", "a\n://B.net/\nz", "x://y" * 5000]


def test_urls_rules_and_parts(spark):
    table = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string, url_host string")
    model = urls.train(urls.labelled_urls())
    for r in urls.judge(table).collect():
        host, path = url_parts(r["url"])
        rule, said = url_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (said or ("block" if model.score(host, path) >= 0.5 else "allow"))
    assert urls.judge(table.limit(0)).count() == 0


@pytest.mark.parametrize("fold", range(5))
def test_url_model_on_held_out_rows(fold):
    table = urls.labelled_urls()
    assert len({u for u, _ in table}) == len(table) and not {u for u, b in table if b} & {u for u, b in table if not b}
    held = [(u, b) for u, b in table if zlib.crc32(u.encode()) % 5 == fold]
    model = urls.train([(u, b) for u, b in table if zlib.crc32(u.encode()) % 5 != fold])
    said = model.scores(*zip(*[url_parts(u) for u, _ in held], strict=True)) >= 0.5
    label = np.array([b for _, b in held])
    assert (said == label).mean() > 0.94 and said[label].mean() > 0.9 and said[~label].mean() < 0.05


def test_url_model_on_hosts_of_other_shapes():
    model = urls.train(urls.labelled_urls())
    for bad, hosts in ((True, "sexcam hot-singles online-casino-bonus cheap-loans super-slots"), (False, "track-and-field free-software www.nytimes city-museum school-library express-trains")):
        assert all((model.score(f"{h}.example.info", "/a/1") >= 0.5) == bad for h in hosts.split())
    with pytest.raises(ValueError):
        urls.train([("a://b", True)] * (urls.MOST_LABELLED + 1))


def test_url_scores_in_blocks(monkeypatch):
    model = urls.train(urls.labelled_urls())
    hosts, paths = ["a.b", "", "casino.com", "\u00e9\ud800x", "w" * 300_000, "", "x"], ["/", "", "/q" * 200_000, "", "/\U0001f600", "/only/path", ""]
    one = [model.score(h, p) for h, p in zip(hosts, paths, strict=True)]
    for size in (1, 10, 1 << 20):
        monkeypatch.setattr(urls, "CHARS", size)
        assert np.allclose(model.scores(hosts, paths), one, rtol=1e-12)
    assert len(model.scores([], [])) == 0 and one[1] == pytest.approx(1 / (1 + np.exp(-model.bias)))
    row, feature = urls.features(["abab", "abab"], ["", "/abab"])
    grams = {"^abab$"[i : i + n] for n in urls.SIZES for i in range(7 - n)}
    assert (row == 0).sum() == len(grams) and set(feature[row == 0]) <= set(feature[row == 1])


# 3 language model


def tree_probability(counts, code):
    """Context-tree weighting by recursion over exact counts: {(depth, context): [256 counts]}."""
    context, byte = code >> 8, code & 255
    keys = [context, context >> 5 << 5, context >> 10 << 10, 0]

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def at(depth, key, lo, size):
        c = counts.get((depth, key), Counter())
        half = size // 2
        return sum(v for b, v in c.items() if lo <= b < lo + half), sum(v for b, v in c.items() if lo + half <= b < lo + size)

    def below(depth, key):
        return [k for d, k in counts if d == depth + 1 and (depth == 0 or (k >> 10 == key >> 10 if depth == 1 else k >> 5 == key >> 5))]

    def pw(depth, key, lo, size):
        own = kt(*at(depth, key, lo, size))
        if depth == 3:
            return own
        return np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(pw(depth + 1, k, lo, size) for k in below(depth, key)))

    def one(depth, lo, size):
        key = keys[3 - depth]
        a, b = at(depth, key, lo, size)
        p = (b + 0.5) / (a + b + 1)
        if depth == 3:
            return p
        w = math.exp(math.log(0.5) + kt(a, b) - pw(depth, key, lo, size))
        return w * p + (1 - w) * one(depth + 1, lo, size)

    total, lo, size = 0.0, 0, 256
    while size > 1:
        p, half = one(0, lo, size), size // 2
        bit = byte >= lo + half
        total += math.log10(p if bit else 1 - p)
        lo, size = (lo + half, half) if bit else (lo, half)
    return total


def test_context_tree_weighting_is_exact():
    texts = [b"the cat sat", b"the mat", b"", b"The CAT\n12!", "\u00e9t\u00e9".encode()]
    code, first = lm.codes(texts)
    assert len(code) == sum(len(t) + 1 for t in texts) and list(first) == [0, 12, 20, 21, 33]
    counts = defaultdict(Counter)
    for c in code.tolist():
        for depth, key in ((3, c >> 8), (2, c >> 13 << 5), (1, c >> 18 << 10), (0, 0)):
            counts[depth, key][c & 255] += 1
    table = lm.code_lengths(*lm._sum(code))
    probes = [*code.tolist()[:25], (5 << 18 | 3 << 13 | 2 << 8 | 97), 7]
    for c in probes:
        assert table[c] == pytest.approx(tree_probability(counts, c), rel=1e-5)
    sums = (10.0 ** table.reshape(-1, 256)[:: 4099].astype(float)).sum(1)
    assert np.allclose(sums, 1, atol=1e-4)


@pytest.mark.parametrize("head", [lm.HEAD, 50, 0])
def test_lm_base_score(docs, rows, head):
    table = docs.select("doc_id", "text")
    got = lm.score(table, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, head=head).collect()
    train = Counter()
    for i, r in rows.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update((r["text"] or "").encode().lower().split())
            train[None] += 1
    n, v = sum(train.values()), len(train)
    for r in got:
        tokens = [*(rows[r["doc_id"]]["text"] or "").encode().lower().split(), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(train[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens), rel=1e-9)
        assert r["score"] < 0


def test_lm_odd_rows(odd, clashing):
    for table in (odd, clashing):
        got = lm.score(table, F.col("doc_id") > 0)
        assert got.count() == len(ODD)
        assert {r["n_tokens"] for r in got.filter("doc_id in (1, 2, 3)").collect()} == {1}
    assert lm.score(odd.limit(0), F.lit(True)).count() == 0
    alone = lm.score(odd, F.lit(False)).filter("doc_id = 4").first()
    assert alone["score"] == pytest.approx(41 * 8 * math.log10(0.5), rel=1e-6) and alone["train_tokens"] == 0


def byte_tree(train):
    """log10 probability of a byte after the bytes before it by trees whose contexts are classes first, then the last three bytes and more, in plain Python."""

    def path(before):
        b = [before[-k] if len(before) >= k else 0 for k in range(1, lm.DEPTH + 1)]
        shapes = [lm.FINE[b[0]], lm.COARSE[b[1]], lm.COARSE[b[2]]]
        return [*[("class", *map(int, shapes[:k])) for k in range(4)], *[tuple(b[:k]) for k in range(3, lm.DEPTH + 1)]]

    def walk(byte):
        return [(1 << level | byte >> (8 - level), byte >> (7 - level) & 1) for level in range(8)]

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) if a + b else 0.0

    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for t in train:
        for i, byte in enumerate([*t, 255]):
            for node, bit in walk(byte):
                p = path(t[:i])
                for c, deeper in zip(p, [*p[1:], None], strict=True):
                    counts[c, node][bit] += 1
                    if deeper:
                        children[c, node].add(deeper)

    @cache
    def pw(context, node):
        own = kt(*counts.get((context, node), (0, 0)))
        if len(context) == lm.DEPTH and context[0] != "class":
            return own
        return np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(pw(c, node) for c in children.get((context, node), ())))

    def log_probability(before, byte):
        total = 0.0
        for node, bit in walk(byte):
            p = None
            for c in reversed(path(before)):
                zeros, ones = counts.get((c, node), (0, 0))
                here = (ones + 0.5) / (zeros + ones + 1)
                w = 1 if p is None else math.exp(math.log(0.5) + kt(zeros, ones) - pw(c, node))
                p = here if p is None else w * here + (1 - w) * p
            total += math.log10(p if bit else 1 - p)
        return total

    return log_probability


@pytest.mark.parametrize("gram_head", [lm.GRAMS, 60, 0])
def test_lm_scores_by_whole_bytes(spark, gram_head):
    learnt = ["the cat sat on the mat", "THE cat, 1812 and 1945!", "the cat sat on the mat", "", "\u00e9t\u00e9 \u043b\u0435\u0442\u043e", "call 1812 or 1813"]
    texts = [*learnt, "the mat sat, 1945", "zebra \u4e2d\u6587", "the cat sat on the mat", "\u043b\u0435\u0442\u043e 1813"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm.score(table, F.col("doc_id") < len(learnt), gram_head=gram_head).collect()}
    said = byte_tree([t.encode() for t in learnt])
    for i, t in enumerate(texts):
        raw = t.encode()
        assert got[i] == pytest.approx(sum(said(raw[:k], b) for k, b in enumerate([*raw, 255])), rel=1e-6)


def test_lm_tells_bytes_of_a_class_apart(spark):
    learnt = ["in 1st place", "in 2nd place"] * 30
    table = spark.createDataFrame([*enumerate(learnt), (100, "in 1st place"), (101, "in 1nd place")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score(table, F.col("doc_id") < 100).filter("doc_id >= 100").collect()}
    assert got[100] > got[101] + 1


def test_lm_beats_its_classes_on_held_out_text(docs, rows):
    learnt, held = [[(r["text"] or "").encode() for i, r in rows.items() if (zlib.crc32(str(i).encode()) % 7 == 2) == h] for h in (False, True)]
    by_class = lm.code_lengths(*lm._sum(lm.codes(learnt)[0]))[lm.codes(held)[0]].sum(dtype=float)
    apart = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = lm.score(docs.select("doc_id", "text"), ~apart).filter(apart).agg(F.sum("score")).first()[0]
    assert got > 0.95 * by_class


def test_lookup_has_every_gram():
    rng = np.random.default_rng(3)
    gram = np.unique(rng.integers(0, 2**48, 5000, np.uint64))
    value = rng.random(len(gram)).astype(np.float32)
    found, absent = lm.Lookup(gram[::2], value[::2]).get(gram)
    assert (found[::2] == value[::2]).all() and (found[1::2] == 0).all()
    assert (absent == np.arange(1, len(gram), 2)).all()


# 4 near-duplicates


def shingles(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0.0


def clusters(texts):
    """Brute force: {id: least id reachable}."""
    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates_match_brute_force(spark, sf, rows):
    got = {r["doc_id"]: r for r in run("op4", spark, sf)}
    want = clusters({i: r["text"] for i, r in rows.items()})
    assert {i: r["cluster_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


@pytest.mark.parametrize("block", [near_dups.BLOCK, 7])
def test_near_duplicates_in_a_large_group(spark, block):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    texts = {}
    for i in range(60):
        t = list(base)
        for x in rng.integers(0, 120, 3):
            t[x] = f"edit{i}_{x}"
        texts[i] = " ".join(t)
    shared = " ".join(f"p{x}" for x in range(60))
    texts |= {1000 + i: " ".join(f"u{i}_{x}" for x in range(60)) + " " + shared for i in range(20)}
    table = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["cluster_id"] for r in near_dups.near_duplicates(table, block=block).collect()}
    assert got == clusters(texts)


@pytest.mark.parametrize("few", [near_dups.FEW, 3])
def test_shared_counts_equal_brute_force(monkeypatch, few):
    monkeypatch.setattr(near_dups, "FEW", few)
    rng = np.random.default_rng(8)
    sets = [set(rng.integers(0, 60, 30).tolist()) for _ in range(40)]
    component = rng.integers(0, 9, 40)
    owner = np.repeat(np.arange(40), [len(s) for s in sets])
    got = near_dups.shared(np.array([x for s in sets for x in sorted(s)], np.uint64), owner, component, 40)
    for j in range(40):
        for i in range(j):
            if component[i] != component[j]:
                assert got[i, j] == len(sets[i] & sets[j])


def test_tile_forest_keeps_hosts_apart():
    sets = [set(range(20)), set(range(19)), set(range(20)), set(range(100, 120))]
    elements = np.array([x for s in sets for x in s], np.uint64)
    a, b = near_dups.tile_forest(np.array([1, 1, 2, 2]), np.array([10, 11, 12, 13]), np.array([len(s) for s in sets]), elements, 0.8)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(11, 10)]


def test_near_duplicates_odd_rows(spark, odd, clashing):
    for table in (odd, clashing):
        got = near_dups.near_duplicates(table).collect()
        assert sum(r["n_rows"] for r in got) == len(ODD)
        assert {r["kept"] for r in got if r["doc_id"] in (1, 2, 3, 4, 5)} == {True}
        assert [r["kept"] for r in got if r["doc_id"] is None and r["c"] is not None] == [False]
        out = near_dups.one_of_each_group(spark, table, "")
        assert out.columns == table.columns and out.filter("doc_id = 4").count() == 1
    assert near_dups.near_duplicates(odd.limit(0)).count() == 0


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    a = [f"x{i}" for i in range(400)]
    b = list(a)
    for i in rng.integers(0, 400, 12):
        b[i] = f"y{i}"
    texts = [" ".join(a), " ".join(b), " ".join(a[:200] * 2), "one two"]
    e, of = near_dups.Shingler().elements([t.encode() for t in texts])
    s = near_dups.signatures(e, of, len(texts))
    for i in range(3):
        for j in range(i):
            want = similarity(shingles(texts[i]), shingles(texts[j]))
            assert abs((s[i] == s[j]).mean() - want) < 0.13
    assert (s[3] > 0).all()


# 5 packing


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check_pieces(pieces, ids):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert by_doc.keys() == ids.keys()
    for i, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[i])
            assert p["ids_crc32"] == zlib.crc32(ids[i][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids[i])
    for s, parts in by_sequence.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and (at == 2048 or s == max(by_sequence))


def test_packing_round_trip(spark, sf, rows, encode):
    check_pieces(run("op5", spark, sf), {i: encode(r["text"]) for i, r in rows.items()})


def test_word_ids_equal_the_tokenizer(encode):
    ids = packing.WordIds(packing.vocabulary())
    for text in ["", "Hello, World. It's 12.5% <|endoftext|> <|ENDOFTEXT|>", "a.b.. c?! 've", "\u00c9t\u00c9. e\u0301. \u0130I \u03a3\u03a3. x\u00a0y\u2003z\x1cq\x85w", "A\tB\r\nC\n\n", "ab. ab ab, AB. \U0001f600.", "\u65e5\u672c.", LONG[:5000]]:
        assert np.frombuffer(ids.many([text, text])[1], "<u2").tolist() == encode(text)[:-1].tolist(), text


def test_packing_odd_rows(odd, clashing, encode):
    for table in (odd, clashing):
        got = packing.pack(table.filter("doc_id is not null").dropDuplicates(["doc_id"])).withColumn("ids_crc32", F.crc32("ids")).collect()
        check_pieces(got, {r[0]: encode(r[1]) for r in ODD if r[0] is not None})
    assert packing.pack(odd.limit(0)).count() == 0
    assert sum(r["length"] for r in packing.pack(odd).collect()) == sum(len(encode(r[1])) for r in ODD)


# 6 secrets


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 16])


def said(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_secret_base_spans(spark, sf, rows):
    for r in run("op6", spark, sf):
        want = base_spans(rows[r["doc_id"]]["text"])
        assert r["base_sha256"] == hashlib.sha256(said(want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in want) for x in range(3)]
        assert set(said(want).split(",")) <= set(r["spans"].split(","))


def test_secrets_in_nested_layers():
    key = "AKIA" + "Q7" * 8
    inner = f"password = {'x9' * 8} and {key}"
    b64 = base64.b64encode(inner.encode()).decode()
    packed = base64.b64encode(gzip.compress(inner.encode())).decode()
    urled = quote(key, safe="").replace("A", "%41")
    uni = "".join(f"\\u{ord(c):04x}" for c in key)
    for wrapped in (b64, packed, urled, uni, quote(b64, safe=""), "".join(f"%{ord(c):02X}" for c in b64), base64.b64encode(quote(b64).encode()).decode(), base64.b64encode(packed.encode()).decode()):
        text = f"see \u00e9 {wrapped} end"
        _, spans = secret_scan.find(text)
        where = [(a, b) for a, k, b in spans if k == 1]
        assert where, wrapped
        assert all(6 <= a < b <= 6 + len(wrapped) for a, b in where)
    _, spans = secret_scan.find(f"x {urled} y")
    assert (2, 1, 2 + len(urled)) in spans
    for plain in ("nothing", "%41%42", "\\u0041", "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo=", None, "", "%", "%zz", "\\uD83D\\uDE00", "&#65;&#x42;"):
        base, spans = secret_scan.find(plain)
        assert not base and not spans
    bomb = base64.b64encode(gzip.compress(b" " * 1_000_000 + key.encode())).decode()
    assert any(k == 1 for _, k, _ in secret_scan.find(bomb)[1])


def test_secrets_odd_rows(odd, clashing):
    for table in (odd, clashing):
        assert secret_scan.find_secrets(table).count() == len(ODD)
    assert secret_scan.find_secrets(odd.limit(0)).count() == 0


# 7 language ID


def test_language_held_out(spark, sf, rows):
    got = run("op7", spark, sf)
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(rows) and held
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)


def test_language_backs_off_to_shorter_grams(spark):
    table = spark.createDataFrame([(f"the house and the garden number{i}", "en") for i in range(9)] + [(f"das haus und der garten nummer{i}", "de") for i in range(9)], "text string, lang string")
    scorer = language.Scorer(language.fit(table))
    assert scorer.score("the and")[0] == "en" and scorer.score("das und")[0] == "de"
    assert scorer.score("gardens houses")[0] == "en" and scorer.score("haeuser gaerten")[0] == "de"
    assert {scorer.score(x) for x in ("\u00b2", "\u00bd", "\u2167", "3 \u2460 _")} == {("und", 0.0)}
    rare = spark.createDataFrame([("alpha beta", "xx"), ("eins zwei drei", "yy")], "text string, lang string")
    assert language.Scorer(language.fit(rare)).score("beta alpha")[0] == "xx"
    assert scorer.score("12 !") == scorer.score(None) == scorer.score("") == ("und", 0.0)


def test_language_odd_rows(spark, odd, clashing):
    for table in (odd, clashing):
        got = language.identify(table, language.fit(table, min_count=1)).collect()
        assert len(got) == len(ODD)
        assert all(r["lang_pred"] == "und" for r in got if r["doc_id"] in (1, 2, 3, 6))
        assert language.keep_identified(spark, table, "").columns == table.columns
    assert {r["lang_pred"] for r in language.identify(odd, language.fit(odd.limit(0))).collect()} == {"und"}


# 8 vectors


def links(vectors_, threshold=0.9):
    ids = list(range(len(vectors_)))
    ok = [v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors_]
    near, up = [0] * len(ids), list(ids)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids[:i]:
            if ok[i] and ok[j] and len(vectors_[i]) == len(vectors_[j]) and np.dot(vectors_[i], vectors_[j]) / np.linalg.norm(vectors_[i]) / np.linalg.norm(vectors_[j]) >= threshold:
                near[i] += 1
                near[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return near, [find(i) for i in ids]


@pytest.mark.parametrize("tile", [8192, 16])
def test_vectors_match_brute_force(spark, tile):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    v = [list(map(float, np.float32(b + rng.normal(size=16) * s))) for b in base for s in (0, 0.1, 0.2, 0.3, 0.35, 0.4)]
    v += [v[0], v[0], [0.0] * 16, None, [1.0] * 15 + [float("nan")], [1.0] * 15 + [None], [1.0, 2.0], [2.0, 4.0], [], [1e30] * 16, [-x for x in v[3]]]
    table = spark.createDataFrame([(i, x, "x", i) for i, x in enumerate(v)], "vec_id long, embedding array<float>, h string, label long")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(table, tile=tile).collect()}
    exact = [None if x is None else [None if y is None else float(np.float32(y)) for y in x] for x in v]
    near, component = links(exact)
    assert [got[i]["n_links"] for i in range(len(v))] == near
    assert [got[i]["component_id"] for i in range(len(v))] == component
    assert all(got[i]["kept"] == (component[i] == i) for i in range(len(v)))
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_vectors_of_one_dense_cluster(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=32) + 0.01 * rng.normal(size=(3000, 32))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = vectors.near_duplicates(table).agg(F.min("n_links").alias("low"), F.max("n_links").alias("high"), F.max("component_id").alias("c"), F.count_if("kept").alias("kept")).first()
    assert tuple(got) == (2999, 2999, 0, 1)


def test_vectors_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.001]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0, 0.0]), (None, None)]
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == Counter([(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (None, 0, None)])


def test_vectors_at_the_ends_of_doubles(spark):
    """Squares that leave the range of doubles: such vectors link as their multiples do, and hide no other vector's links."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=16)
    rows = [v * 1e-170, v, v * 1e200, np.r_[5e-324, np.zeros(15)], -v, *rng.normal(size=(40, 16))]
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in range(3)] == [2, 2, 2] and got[4] == 0 and sum(got.values()) == 6
    assert np.isfinite(vectors.in_range(np.array([[5e-324, 0.0], [1.7e308, -1.7e308], [1.0, 2.0]]))).all()


def test_quantisation_bound_is_rigorous():
    u = np.random.default_rng(2).normal(size=(200, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    q, s, e = vectors.quantise(u)
    error = np.abs(u @ u.T - np.outer(s, s) * (q.astype(float) @ q.T))
    assert (error <= (1 + e)[:, None] * e[None, :] + e[:, None] + 1e-12).all()


def test_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(200)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    up = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    assert got == up
    half = len(pairs) // 2
    two = joined_components(components(spark.createDataFrame(pairs[:half], "a long, b long")), spark.createDataFrame(pairs[half:], "a long, b long"))
    assert {r["node"]: r["component"] for r in two.collect()} == up
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 9 lines


def line_words(text):
    return [(i, x.strip(" \t\n\r\x0b\x0c"), len(words(x))) for i, x in enumerate(text.split("\n")) if words(x)]


def stretch(rows_, a, least):
    n = 0
    for b in range(a, len(rows_)):
        n += rows_[b][2]
        if n >= least:
            return b + 1
    return None


def check_lines(texts, got):
    """Every deleted line has an earlier equal one; every run of 40 words (SURE_WORDS) that occurred before goes whole; texts without a repeated run of 20 stay."""
    before, long_before, short_before = set(), set(), set()
    for i in sorted(texts):
        text, gone = texts[i], {k for c in got[i]["removed"] for k in range(c["start"], c["start"] + c["length"])}
        kept = [x for k, x in enumerate(text.split("\n")) if k not in gone]
        assert got[i]["text"] == "\n".join(kept)
        rows_ = line_words(text)
        repeated = False
        for a, (k, line, _) in enumerate(rows_):
            assert k not in gone or line in before, (i, k)
            before.add(line)
            for least, seen in ((lines.SURE_WORDS, long_before), (lines.MIN_WORDS, short_before)):
                b = stretch(rows_, a, least)
                if b:
                    key = tuple(x[1] for x in rows_[a:b])
                    if key in seen and least == lines.SURE_WORDS:
                        assert all(x[0] in gone for x in rows_[a:b]), (i, k)
                    repeated |= key in seen
                    seen.add(key)
        assert repeated or not gone, i


def test_lines_match_brute_force(spark, sf, docs, rows):
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    check_lines({i: r["text"] for i, r in rows.items()}, got)
    assert any(r["removed"] for r in got.values())


def test_lines_planted_passages(spark):
    def sentence(tag, n):
        return " ".join(f"{tag}{x}" for x in range(n))

    passage = "\n".join(sentence(f"p{k}_", n) for k, n in enumerate((7, 9, 12, 8, 30)))
    one_line = sentence("solo", 55)
    texts = {i: "\n".join([sentence(f"a{i}_", 15), passage if i % 2 else one_line, sentence(f"b{i}_", 15), "All rights reserved."]) for i in range(1, 9)}
    texts[20] = sentence("rep", 3) + "\n" + "\n\n".join([sentence("same", 4)] * 30)
    texts[21] = "\n".join(sentence(f"c{k}_", 10) for k in range(6))
    table = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.dedup_lines(table).collect()}
    check_lines(texts, got)
    for i in range(3, 9):
        assert got[i]["text"] == "\n".join([sentence(f"a{i}_", 15), sentence(f"b{i}_", 15), "All rights reserved."])
    assert got[1]["text"] == texts[1] and got[2]["text"] == texts[2] and got[21]["text"] == texts[21]
    assert got[20]["text"] == sentence("rep", 3) + "\n" + sentence("same", 4) + "\n"


def test_lines_go_whole_where_no_single_holder_has_all(spark):
    def sentence(tag, n):
        return " ".join(f"{tag}{x}" for x in range(n))

    passage = [sentence(f"p{k}_", n) for k, n in enumerate((10, 15, 15, 10, 12, 3))]
    texts = {1: passage[:3], 2: [sentence("own", 9), *passage], 3: [sentence("x", 9), *passage, sentence("y", 9)], 4: [*passage[2:], sentence("z", 30)], 5: [sentence("v", 12), *passage]}
    texts = {i: "\n".join(t) for i, t in texts.items()}
    table = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.dedup_lines(table).collect()}
    check_lines(texts, got)
    assert [got[i]["text"] for i in (3, 4, 5)] == [sentence("x", 9) + "\n" + sentence("y", 9), sentence("z", 30), sentence("v", 12)]


def test_lines_of_one_document_that_repeat_often(spark):
    line = " ".join(f"w{x}" for x in range(25))
    table = spark.createDataFrame([(1, "\n".join([line] * 16_000)), (2, line)], "doc_id long, text string")
    begin = time.monotonic()
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(table).collect()}
    assert got == {1: line, 2: ""} or got == {1: line, 2: line}
    assert time.monotonic() - begin < 60


def test_lines_odd_rows(spark, odd, clashing):
    for table in (odd, clashing):
        got = lines.dedup_lines(table).collect()
        assert len(got) == len(ODD)
        assert [r["text"] for r in got if r["doc_id"] == 5] == [LONG] and got[0].asDict().keys() >= {"removed"}
    assert lines.dedup_lines(odd.limit(0)).count() == 0
    out = lines.without_repeated_lines(spark, clashing, "")
    assert out.columns == clashing.columns


# 10 transport streams


def payload(text):
    raw = (text or "").encode()
    return raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))


def test_transport_digests(spark, sf, rows):
    for r in run("op10", spark, sf):
        want = payload(rows[r["doc_id"]]["text"])
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["tail_crc32"] == zlib.crc32(want[-16:])
        assert (r["n_bytes"], r["payload_bytes"]) == (len((rows[r["doc_id"]]["text"] or "").encode()), len(want))
        assert r["media_sha256"] == hashlib.sha256(transport.write_stream(want)).hexdigest() and "errors=0;streams=1" in r["feature"]


@pytest.mark.parametrize("n", [0, 1, 170, 176, 192, 354, 5000, transport.ACCESS_UNIT, transport.ACCESS_UNIT * 9 + 192, 400_000])
def test_transport_round_trip(n):
    data = payload("x" * n)
    media = transport.write_stream(data)
    assert len(media) % 188 == 0 and set(media[::188]) == {0x47}
    s = transport.read_stream(media)
    units = -(-len(data) // transport.ACCESS_UNIT)
    assert s.payload == data and s.errors == 0 and s.programs == {1: {transport.DATA_PID: transport.PRIVATE_TYPE}}
    assert s.times == [k * transport.TICKS for k in range(units)] and [k for k, r in enumerate(s.random) if r] == list(range(0, units, transport.RANDOM_EVERY))
    assert s.offsets == [k * transport.ACCESS_UNIT for k in range(units)]


def test_transport_sees_damage():
    media = transport.write_stream(payload("y" * 50_000))
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    assert transport.read_stream(b"".join(packets[:10] + packets[11:])).errors > 0
    doubled = transport.read_stream(b"".join(packets[:10] + packets[9:]))
    assert doubled.errors > 0 and doubled.payload == payload("y" * 50_000)
    assert transport.read_stream(media[:-5]).errors > 0
    assert transport.section_crc(b"123456789") == 0x0376E6E7


def test_transport_odd_rows(odd, clashing):
    for table in (odd, clashing):
        assert transport.transport_streams(table).filter("ts.errors = 0").count() == len(ODD)
    assert transport.transport_streams(odd.limit(0)).count() == 0


def test_word_count(spark, odd):
    assert [r[0] for r in odd.select(n_words(F.col("text"))).collect()] == [len(words(r[1])) for r in ODD]
