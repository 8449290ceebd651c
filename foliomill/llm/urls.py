"""URL filters: logistic regression on hashed character n-grams of host and path, behind explicit rules (operator 2).

The model is trained on the driver from a small labelled URL table (a list of (url, blocked) of a size that is checked). Features are
the n-grams of "host" and of "path", each kind hashed with a mark of its own; a feature's value is 1 over the root of their number.

Defined results: a null URL or one without `://` has an empty host and path, no rule, and the model's verdict on no n-grams at all
(its bias); hosts keep ports and user parts as they stand; of rules that fit, the longest wins, ties go to the first in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm.common import own, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The contract's rules: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BITS = 16
SIZES = (3, 4, 5)
#: Multiplier of the n-grams' hash, and characters that are hashed at a time.
MIX, CHARS = np.uint64(0x9E3779B97F4A7C15), 1 << 20
#: The largest labelled table that is trained on, on the driver.
MOST_LABELLED = 20_000

#: Words of the built-in labelled table: such as stand in hosts and paths that crawls block, in those that they keep, and in both.
BAD = """casino poker slots jackpot roulette bet bets betting sportsbet lottery viagra cialis pills pill xxx porn porno sex sexcam nude adult
escort singles webcamgirls malware phish phishing spam spammer warez keygen torrent crack replica payday loan loans popup popunder tracker
adserver ads clickbait""".split()
GOOD = """news blog docs wiki library school science museum research recipes garden weather travel history music forum books city health
university journal archive code report photo sport theater river bridge times post tribune herald guide athletics software hospital
pharmacy language alphabet better essex sussex roads pillow racetrack backpack slotted adulthood museumshop cookbook kitchen parliament
court railway harbour island mountain church choir cinema painting poetry grammar physics chemistry biology algebra nursery college council""".split()
BOTH = """free online best top hot live club zone world hub site direct now pro my the cheap discount track open daily local city24 green blue
north euro global easy smart""".split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()


def labelled_urls() -> list[tuple[str, bool]]:
    """The small labelled table: each word in hosts of several shapes and in paths, beside words that stand in both classes."""
    ends, starts = ("com", "net", "org", "info", "de", "fr", "io", "co.uk", "example.com", "example.org", "example.net"), ("", "www.", "m.", "blog.", "")
    tails = ("", "/", "/index.html", "/en/{}", "/de/{}/", "/fr/{}.html", "/es/{}", "/2021/05/{}", "/item/{}", "/a/b/{}")
    out = []

    def add(host: str, i: int, bad: bool, path: str | None = None) -> None:
        tail = tails[i % len(tails)].format(i * 37 % 1000) if path is None else path
        out.append((f"http{'s' * (i % 2)}://{starts[i % len(starts)]}{host}.{ends[i * 3 % len(ends)]}{tail}", bad))

    for bad, words in ((True, BAD), (False, GOOD)):
        for i, w in enumerate(words):
            other = words[(i * 7 + 3) % len(words)]
            add(w, i, bad)
            add(f"{w}-{other}", i + 1, bad)
            add(f"{other}{w}", i + 2, bad)
            add(f"{w}-{LOWER[i * 5 % 26]}", i + 3, bad)
            for k in range(18 if bad else 6):  # as many of one class as of the other, about
                n = BOTH[(i * 5 + k * 7) % len(BOTH)]
                add((f"{n}-{w}", f"{w}{n}", f"{n}{w}", f"{w}-{n}", f"{n}-{w}-{other}", f"{w}s-{n}")[k % 6], i + k + 4, bad)
            add(BOTH[(i * 11) % len(BOTH)], i + 9, bad, f"/{w}/{i}")
    for i, n in enumerate(BOTH):  # such words say nothing by themselves
        add(n, i, False)
        add(f"{n}-{BOTH[(i + 5) % len(BOTH)]}", i + 1, False)
        add(f"{n}-and-{BOTH[(i + 9) % len(BOTH)]}", i + 2, False)
    # plain invented hosts: common letter pairs joined by a rule, none of them a word above
    for i in range(600):
        add("".join(PAIRS[(i * k + k * k + i // len(PAIRS)) % len(PAIRS)] for k in (1, 7, 11, 13)[: 2 + i % 3]), i, False)
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and starts the path; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        of, slash, start = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def features(hosts: Sequence[str], paths: Sequence[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the hashed n-grams of the hosts (marks ^ and $ at their ends) and of the paths, each feature of a row once."""
    found = [np.zeros(0, np.uint64)]
    marked = [f"^{h}$" if h or p else "" for h, p in zip(hosts, paths, strict=True)]
    for kind, texts in enumerate((marked, paths)):
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(len(texts), dtype=np.uint64), [len(t) for t in texts])
        for n in SIZES:
            m = len(codes) - n + 1
            if m <= 0:
                continue
            h = np.full(m, 8 * n + kind + 1, np.uint64)
            for k in range(n):
                h = (h ^ codes[k : k + m]) * MIX
                h ^= h >> np.uint64(29)
            whole = row[:m] == row[n - 1 :]
            found.append((row[:m] << np.uint64(bits) | h * MIX >> np.uint64(64 - bits))[whole])
    both = np.unique(np.concatenate(found))
    return (both >> np.uint64(bits)).astype(np.int64), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def scores(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """Probability of each URL that it is to be blocked. URLs are read CHARS characters at a time, whole."""
        out, first, size = [], 0, 0
        for i in range(len(hosts)):
            size += len(hosts[i]) + len(paths[i])
            if size >= CHARS or i + 1 == len(hosts):
                row, feature = features(hosts[first : i + 1], paths[first : i + 1])
                n = np.bincount(row, minlength=i + 1 - first)
                z = self.bias + np.bincount(row, self.weights[feature], i + 1 - first) / np.sqrt(np.maximum(n, 1))
                out.append(1 / (1 + np.exp(-z)))
                first, size = i + 1, 0
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, host: str, path: str) -> float:
        return float(self.scores([host], [path])[0])


def _split(url: str) -> tuple[str, str]:
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    stop = min((i for i in (rest.find(c, end) for c in "?#") if i >= 0), default=len(rest))
    return rest[:end].translate(str.maketrans(UPPER, LOWER)), rest[end:stop]


def train(labelled: Sequence[tuple[str, bool]], *, epochs: int = 60, rate: float = 1.0, decay: float = 1e-4) -> UrlModel:
    """Full-batch AdaGrad on the labelled rows in the given order: the same table gives the same model."""
    if len(labelled) > MOST_LABELLED:
        raise ValueError(f"{len(labelled)} labelled URLs; at most {MOST_LABELLED} are trained on the driver")
    parts = [_split(u) for u, _ in labelled]
    of, at = features([h for h, _ in parts], [p for _, p in parts])
    y = np.array([float(b) for _, b in labelled])
    # the rarer verdict weighs more, by the root of what would make both equal
    share = np.where(y > 0, len(y) / max(1.0, 2 * y.sum()), len(y) / max(1.0, 2 * (1 - y).sum())) ** 0.8
    w, bias, seen, seen_b = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-8), 1e-8
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(of, minlength=len(parts))))
    for _ in range(epochs if len(parts) else 0):
        z = bias + np.bincount(of, w[at], len(parts)) * scale
        g = (1 / (1 + np.exp(-z)) - y) * share
        gw = np.bincount(at, (g * scale)[of], 1 << BITS) / len(parts) + decay * w
        seen += gw * gw
        w -= rate * gw / np.sqrt(seen) * (seen > 1e-7)
        seen_b += g.mean() ** 2
        bias -= 0.1 * rate * g.mean() / np.sqrt(seen_b)
    return UrlModel(w, float(bias))


def judge(pages: DataFrame, url: str = "url", *, rules: Sequence[tuple[str, str]] = RULES, labelled: Sequence[tuple[str, bool]] | None = None, threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, block_score (the model's) and verdict; columns of these names in pages are replaced."""
    model = train(labelled_urls() if labelled is None else labelled)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def blocked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = shared.value
        for hosts, paths in batches:
            yield pd.Series(m.scores(hosts.tolist(), paths.tolist()), dtype="float64")

    h, p = split_url(F.col(url))
    a, b, c = own(pages, "url_host"), own(pages, "url_path"), own(pages, "url_said")
    out = pages.withColumns({a: h, b: p})
    rule, said = best_rule(F.col(a), F.col(b), rules)
    out = out.withColumns({c: said, "rule": rule, "block_score": blocked(F.col(a), F.col(b))})
    out = out.withColumns({"host": F.col(a), "path": F.col(b)})
    by_model = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce(F.col(c), by_model)).drop(a, b, c)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")
