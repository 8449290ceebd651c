"""Secret scans with a recursive decoding worklist (operator 6).

Each text is scanned as it stands. Then nested layers are unwrapped until nothing new appears: percent escapes and Unicode
escapes over a whole layer, base64 runs, and compressed data inside either. Every layer is scanned again, and its spans are mapped
back to the characters of the text that they come from. A layer that was seen before at the same place is not unwrapped again.

Defined results: null text counts as empty and has no spans; spans are in code points, end exclusive; a decoded span covers
the escapes or base64 groups that hold it, one inside compressed data the whole run; equal spans of a kind count once; data that
would unpack to more than MOST_UNPACKED bytes (a decompression bomb) stays packed. Every decoded layer counts as text: a byte that
is not UTF-8 is U+FFFD. Base64 is read at each of its four alignments, and across line ends as well as line by line.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import html
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm.common import own, table, with_fields

#: In this order where spans start at the same place.
KINDS = ("assign", "access", "hex")
#: The contract's patterns; letters of the first in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18

ESCAPES = {
    "url": re.compile(r"(?:%[0-9A-Fa-f]{2})+"),
    "unicode": re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+"),
}
#: 22 characters hold 16 bytes, the shortest secret. Shorter runs can hold one only if it is compressed: the least zlib stream
#: of 16 bytes has 10, and those of the other formats have 16 and more.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{14,}={0,2}")
PLAIN, LEAST_PACKED = 22, 14
#: Runs that line ends part, with blanks around them.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r\n?|\n)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
#: Where compressed data starts.
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
STRAY = re.compile("[\udc80-\udcff]")
MOST_UNPACKED = 64 << 20

Span = tuple[int, int, int]


def scan(text: str) -> list[Span]:
    """(start, kind, end) of a layer, sorted: per kind leftmost and not overlapping, those too short dropped."""
    out: list[Span] = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _unpack(data: bytes) -> bytes | None:
    """What a compressed stream holds, or None; never more than MOST_UNPACKED bytes are made."""
    try:
        if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 2 and (data[0] << 8 | data[1]) % 31 == 0:
            d = zlib.decompressobj(47)
            out = d.decompress(data, MOST_UNPACKED)
            return out if d.eof else None
        if data[:3] == b"BZh":
            d2 = bz2.BZ2Decompressor()
            out = d2.decompress(data, MOST_UNPACKED)
            return out if d2.eof else None
        if data[:6] == b"\xfd7zXZ\x00":
            d3 = lzma.LZMADecompressor()
            out = d3.decompress(data, MOST_UNPACKED)
            return out if d3.eof else None
        if data[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            d4 = zstandard.ZstdDecompressor().stream_reader(data)
            out = d4.read(MOST_UNPACKED)
            return None if d4.read(1) else out
    except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError):
        return None
    except Exception as e:  # zstandard's own error type
        if type(e).__name__ != "ZstdError":
            raise
    return None


def _decoded(data: bytes) -> tuple[str, np.ndarray]:
    """Text and the bytes of each character; a byte that is not UTF-8 is one U+FFFD."""
    text = data.decode("utf-8", "surrogateescape")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    sizes[(codes >= 0xDC80) & (codes <= 0xDCFF)] = 1
    return STRAY.sub("\ufffd", text), sizes


class _Layer:
    """Decoded text; begin[i] and end[i] give the characters of the original text that character i comes from (None: the text itself)."""

    __slots__ = ("begin", "end", "text")

    def __init__(self, text: str, begin: np.ndarray | None, end: np.ndarray | None):
        self.text, self.begin, self.end = text, begin, end

    def place(self, start: int, stop: int) -> tuple[int, int]:
        return (start, stop) if self.begin is None else (int(self.begin[start:stop].min()), int(self.end[start:stop].max()))

    def within(self, text: str, starts: np.ndarray, stops: np.ndarray) -> _Layer:
        """A layer inside this one: character i of text comes from starts[i] to stops[i] here."""
        if self.begin is None:
            return _Layer(text, starts, stops)
        return _Layer(text, self.begin[starts], self.end[np.maximum(stops, 1) - 1])

    def spread(self, text: str, start: int, stop: int) -> _Layer:
        """A layer inside this one of which every character comes from all of start to stop here."""
        begin, end = self.place(start, stop)
        return _Layer(text, np.broadcast_to(np.int64(begin), len(text)), np.broadcast_to(np.int64(end), len(text)))


def _packed(layer: _Layer, data: bytes, start: int, stop: int) -> Iterator[_Layer]:
    """Compressed data wherever it starts, again and again; what it holds lies at the whole run."""
    seen, work = {data}, [data]
    while work:
        data = work.pop()
        for m in MAGIC.finditer(data):
            inner = _unpack(data[m.start() :])
            if inner is None or inner in seen:
                continue
            seen.add(inner)
            work.append(inner)
            text = STRAY.sub("\ufffd", inner.decode("utf-8", "surrogateescape"))
            # all of it lies at the whole run, so that one number serves every character
            yield layer.spread(text, start, stop)


def _one_escape(name: str, run: str) -> list[tuple[int, int, str]]:
    """(start, stop, text) of a run of escapes, relative to the run."""
    if name == "url":
        data, out, i = binascii.unhexlify(run.replace("%", "")), [], 0
        while i < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append((i * 3, (i + n) * 3, data[i : i + n].decode("utf-8")))
                    break
                except UnicodeDecodeError:
                    continue
            else:
                n = 1
                out.append((i * 3, (i + 1) * 3, run[i * 3 : i * 3 + 3]))
            i += n
        return out
    out = []
    for m in re.finditer(r"\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})|\\[uUx]([0-9A-Fa-f]+?)(?=\\|&|$)|&#[^;]+;", run):
        if m[1]:
            char = chr(0x10000 + (int(m[1], 16) - 0xD800 << 10) + int(m[2], 16) - 0xDC00)
        elif m[3]:
            code = int(m[3], 16)
            char = chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]
        else:
            char = html.unescape(m[0])
        out.append((m.start(), m.end(), char))
    return out


def _unescape(layer: _Layer, name: str) -> Iterator[_Layer]:
    """The whole layer with its escapes replaced, and what compressed runs of escapes hold."""
    pieces, starts, stops, at, changed = [], [], [], 0, False
    for m in ESCAPES[name].finditer(layer.text):
        raw = binascii.unhexlify(m[0].replace("%", "")) if name == "url" else None
        parts = _one_escape(name, m[0])
        if raw is None and all(len(t) == 1 and ord(t) < 256 for _, _, t in parts):
            raw = bytes(ord(t) for _, _, t in parts)
        if raw is not None and len(raw) > 8:
            yield from _packed(layer, raw, m.start(), m.end())
        pieces.append(layer.text[at : m.start()])
        starts.append(np.arange(at, m.start()))
        stops.append(np.arange(at, m.start()) + 1)
        for s, e, t in parts:
            changed |= t != m[0][s:e]
            pieces.append(t)
            if len(t) == e - s:
                starts.append(np.arange(m.start() + s, m.start() + e))
                stops.append(starts[-1] + 1)
            else:
                starts.append(np.full(len(t), m.start() + s))
                stops.append(np.full(len(t), m.start() + e))
        at = m.end()
    if changed:
        pieces.append(layer.text[at:])
        starts.append(np.arange(at, len(layer.text)))
        stops.append(np.arange(at, len(layer.text)) + 1)
        yield layer.within("".join(pieces), np.concatenate(starts), np.concatenate(stops))


def _may_be_packed(run: str) -> bool:
    """Whether compressed data may start at some alignment of a base64 run."""
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    return any(MAGIC.search(base64.b64decode(run[skip : skip + (len(run) - skip) // 4 * 4])) for skip in range(4))


def _base64(layer: _Layer) -> Iterator[_Layer]:
    runs = []
    for m in BASE64.finditer(layer.text):
        if m.end() - m.start() >= PLAIN or _may_be_packed(m[0]):
            runs.append((m[0], np.arange(m.start(), m.end())))
    for m in WRAPPED.finditer(layer.text) if "\n" in layer.text or "\r" in layer.text else ():
        run = "".join(m[0].split())
        size = len(run.rstrip("="))
        if size >= PLAIN or size >= LEAST_PACKED and _may_be_packed(run):
            runs.append((run, np.array([i for i, c in enumerate(m[0], m.start()) if not c.isspace()])))
    for marked, at in runs:
        run = marked.rstrip("=").replace("-", "+").replace("_", "/")
        for skip in range(4):  # any number of characters of the alphabet may stand before the data
            body = run[skip:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            data = base64.b64decode(body + "=" * (-len(body) % 4))
            text, sizes = _decoded(data)
            # byte i comes from the group of four that holds it
            last = np.cumsum(sizes)
            stops = at[np.minimum(skip + (last + 2) // 3 * 4, len(at)) - 1] + 1
            yield layer.within(text, at[skip + (last - sizes) // 3 * 4], stops)
            yield from _packed(layer, data, int(at[0]), int(at[-1]) + 1)


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each sorted by start, kind, end."""
    text = text or ""
    base = scan(text)
    spans = set(base)
    work, seen = [_Layer(text, None, None)], {(text, 0, len(text))}
    while work:
        layer = work.pop()
        t = layer.text
        made: list[_Layer] = []
        if "%" in t:
            made += _unescape(layer, "url")
        if "\\" in t or "&#" in t:
            made += _unescape(layer, "unicode")
        made += _base64(layer)
        for x in made:
            if not x.text:
                continue
            key = (x.text, *x.place(0, len(x.text)))
            if key in seen:
                continue
            seen.add(key)
            for start, kind, stop in scan(x.text):
                a, b = x.place(start, stop)
                spans.add((a, kind, b))
            work.append(x)
    return base, sorted(spans)


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns but the text, then `base_spans` and `spans`: arrays of (kind, start, end). Columns of these names are replaced."""
    docs = docs.select(*[c for c in docs.columns if c == text or c not in ("base_spans", "spans")])
    keep = [c for c in docs.columns if c != text]
    names = [own(docs, "base_spans"), own(docs, "spans")]
    schema = with_fields(docs.select(*keep).schema, dict.fromkeys(names, "array<struct<kind:string,start:long,end:long>>"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            both = [find(x.as_py()) for x in texts]
            made = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in pair[i]] for pair in both], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, *made], [*keep, *names])

    return docs.mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def of(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[of(k) for k in KINDS], F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
