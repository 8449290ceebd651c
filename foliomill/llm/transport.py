"""Media columns: MPEG transport streams (operator 10).

A payload is cut into access units, each a PES packet with a presentation time stamp, and stored as 188-byte transport packets
with program tables; the reader parses the tables, checks continuity counters, reassembles the elementary packets and lists
their time stamps and random-access points.

Defined results: null is stored as an empty text; a text is UTF-8, padded with spaces to a positive multiple of 192; equal texts give
equal bytes; a stream that lost or doubled packets is read as far as it goes, with the number of continuity errors.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm.common import own, table, with_fields

#: Fixed values of the format (ISO/IEC 13818-1).
PACKET, SYNC, PAT_PID, PRIVATE_STREAM, PRIVATE_TYPE = 188, 0x47, 0x0000, 0xBD, 0x06
CRC_POLYNOMIAL, NULL_PID, PMT_TABLE = 0x04C11DB7, 0x1FFF, 2
#: Ours: one program with one stream.
PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
UNIT = 192
ACCESS_UNIT = UNIT * 64
TICKS = 3600  # of 90 kHz between access units
RANDOM_EVERY = 8
BATCH_BYTES = 4 << 20


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ CRC_POLYNOMIAL if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", section_crc(head + body))


def _table_packet(pid: int, section: bytes) -> bytes:
    """Without its continuity counter, which the writer sets in byte 3."""
    return (struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)))
_PMT = _table_packet(PMT_PID, _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_TYPE, 0xE000 | DATA_PID, 0xF000)))


def _stamp(pts: int) -> bytes:
    return struct.pack(">BHH", 0x21 | pts >> 29 & 0x0E, pts >> 14 & 0xFFFE | 1, pts << 1 & 0xFFFE | 1)


def write_stream(payload: bytes) -> bytes:
    out, counter, tables = [], 0, 0
    heads = [struct.pack(">BHB", SYNC, DATA_PID, 0x10 | c) for c in range(16)]
    for k, at in enumerate(range(0, len(payload), ACCESS_UNIT)):
        data, random = payload[at : at + ACCESS_UNIT], k % RANDOM_EVERY == 0
        pts = k * TICKS & (1 << 33) - 1
        if random:
            out += [_PAT[:3], bytes([0x10 | tables & 15]), _PAT[4:], _PMT[:3], bytes([0x10 | tables & 15]), _PMT[4:]]
            tables += 1
        pes = b"\x00\x00\x01" + struct.pack(">BHBBB", PRIVATE_STREAM, len(data) + 8, 0x84, 0x80, 5) + _stamp(pts) + data
        flags = 0x40 if random else 0
        pcr = struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00)
        field_ = bytes([7, flags | 0x10]) + pcr
        room = PACKET - 4 - len(field_)
        first = pes[:room]
        if len(first) < room:
            field_ = bytes([7 + room - len(first), flags | 0x10]) + pcr + b"\xff" * (room - len(first))
        out += [struct.pack(">BHB", SYNC, 0x4000 | DATA_PID, 0x30 | counter), field_, first]
        counter = counter + 1 & 15
        body = PACKET - 4
        whole = room + (len(pes) - room) // body * body if len(pes) > room else room
        for i in range(room, whole, body):
            out.append(heads[counter])
            out.append(pes[i : i + body])
            counter = counter + 1 & 15
        rest = pes[whole:]
        if rest:
            fill = body - len(rest)
            stuffing = b"\x00" if fill == 1 else bytes([fill - 1, 0]) + b"\xff" * (fill - 2)
            out += [struct.pack(">BHB", SYNC, DATA_PID, 0x30 | counter), stuffing, rest]
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """What a stream holds. A unit is one elementary packet; pids, times, offsets and random have one entry for each, in the order in which they end."""

    payload: bytes = b""
    programs: dict[int, dict[int, int]] = field(default_factory=dict)
    pids: list[int] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    random: list[bool] = field(default_factory=list)
    packets: int = 0
    errors: int = 0


class Sections:
    """Table sections of one kind of packet, put together over as many packets as they take."""

    def __init__(self):
        self.held: dict[int, bytes] = {}
        self.errors = 0

    def _cut(self, data: bytes) -> tuple[list[bytes], bytes]:
        """Whole sections at the start of data, and what is left of one that goes on. Bytes FF after a section are stuffing."""
        whole = []
        while data and data[0] != 0xFF:
            size = 3 + ((data[1] & 0x0F) << 8 | data[2]) if len(data) >= 3 else len(data) + 1
            if len(data) < size:
                return whole, data
            whole.append(data[:size])
            data = data[size:]
        return whole, b""

    def feed(self, pid: int, data: bytes, starts: bool) -> list[bytes]:
        """The sections that end in this packet and whose checksums hold."""
        before = self.held.pop(pid, b"")
        if starts:
            pointer = data[0] if data else 0
            done, cut_off = self._cut(before + data[1 : 1 + pointer]) if before else ([], b"")
            more, left = self._cut(data[1 + pointer :])
            done += more
            self.errors += bool(cut_off)
        elif before:
            done, left = self._cut(before + data)
        else:  # the start was lost
            done, left = [], b""
            self.errors += 1
        if left:
            self.held[pid] = left
        good = [x for x in done if len(x) >= 12 and section_crc(x) == 0]
        self.errors += len(done) - len(good)
        return good


def read_stream(media: bytes) -> Stream:
    """Program tables, continuity check, elementary packets, time stamps with their payload offsets and random-access marks.

    Sections may take several packets and have adaptation fields before them; tables that are not in force yet are left out. A counter
    may jump where the discontinuity mark is set. An elementary packet of length 0 goes on until the next one of its stream starts.
    """
    s = Stream(packets=len(media) // PACKET, errors=int(len(media) % PACKET > 0))
    tables: dict[int, int] = {}
    wanted: set[int] = set()
    last: dict[int, int] = {}
    parts: dict[int, list[bytes]] = {}
    marks: dict[int, bool] = {}
    sections = Sections()
    out: list[bytes] = []
    size = 0

    def close(pid: int) -> None:
        nonlocal size
        pes = b"".join(parts.pop(pid))
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            s.errors += 1
            return
        length, flags, more = pes[4] << 8 | pes[5], pes[7], pes[8]
        data = pes[9 + more : 6 + length] if length else pes[9 + more :]
        s.errors += len(pes) < (6 + length if length else 9 + more)
        pts = (pes[9] & 0x0E) << 29 | pes[10] << 22 | (pes[11] & 0xFE) << 14 | pes[12] << 7 | pes[13] >> 1 if flags & 0x80 and len(pes) >= 14 else -1
        s.pids.append(pid)
        s.times.append(pts)
        s.offsets.append(size)
        s.random.append(marks[pid])
        out.append(data)
        size += len(data)

    for at in range(0, s.packets * PACKET, PACKET):
        if media[at] != SYNC:
            s.errors += 1
            continue
        b1, b3 = media[at + 1], media[at + 3]
        pid, starts = (b1 & 0x1F) << 8 | media[at + 2], bool(b1 & 0x40)
        if pid == NULL_PID:
            continue
        flags = media[at + 5] if b3 & 0x20 and media[at + 4] else 0
        if flags & 0x80:
            last.pop(pid, None)
        if not b3 & 0x10:  # an adaptation field alone
            continue
        if pid in last and last[pid] + 1 & 15 != b3 & 15:
            s.errors += 1
            if last[pid] == b3 & 15:  # a doubled packet
                continue
        last[pid] = b3 & 15
        data = media[at + 4 + (1 + media[at + 4] if b3 & 0x20 else 0) : at + PACKET]
        if pid in wanted:
            if starts:
                if pid in parts:
                    close(pid)
                marks[pid], parts[pid] = bool(flags & 0x40), []
            elif pid not in parts:
                s.errors += 1
                continue
            parts[pid].append(data)
        elif pid == PAT_PID or pid in tables:
            for section in sections.feed(pid, data, starts):
                if not section[5] & 1:
                    continue
                body = section[8:-4]
                if pid == PAT_PID:
                    tables |= {p & 0x1FFF: n for n, p in struct.iter_unpack(">HH", body[: len(body) // 4 * 4]) if n}
                elif section[0] == PMT_TABLE and len(body) >= 4:
                    i, streams = 4 + ((body[2] & 0x0F) << 8 | body[3]), {}
                    while i + 5 <= len(body):
                        streams[(body[i + 1] & 0x1F) << 8 | body[i + 2]] = body[i]
                        i += 5 + ((body[i + 3] & 0x0F) << 8 | body[i + 4])
                    s.programs[section[3] << 8 | section[4]] = streams
                    wanted |= streams.keys()
    for pid in list(parts):
        close(pid)
    s.errors += sections.errors + len(sections.held)
    s.payload = b"".join(out)
    return s


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" "), len(raw)


KINDS = {"n_bytes": "long", "media": "binary", "payload": "binary", "packets": "long", "errors": "long", "streams": "long", "times": "array<long>", "random_offsets": "array<long>"}


def transport_streams(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns but the text, then a struct `ts`: n_bytes, media, payload (read back from media), packets, errors, streams, times and
    random_offsets (payload offsets of random-access points). A column `ts` in docs is replaced."""
    docs = docs.select(*[c for c in docs.columns if c == text or c != "ts"])
    keep = [c for c in docs.columns if c != text]
    names = {c: own(docs, f"ts_{c}") for c in KINDS}
    schema = with_fields(docs.select(*keep).schema, {names[c]: kind for c, kind in KINDS.items()})
    types = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rest, i = batch.column(batch.schema.get_field_index(text)), batch.select(keep), 0
            while i < batch.num_rows:
                first, size, rows = i, 0, []
                while i < batch.num_rows and size < BATCH_BYTES:
                    payload, n = payload_of(texts[i].as_py())
                    media = write_stream(payload)
                    s = read_stream(media)
                    rows.append((n, media, s.payload, s.packets, s.errors, sum(map(len, s.programs.values())), s.times, [o for o, r in zip(s.offsets, s.random, strict=True) if r]))
                    size += 2 * len(media)
                    i += 1
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*rest.slice(first, i - first).columns, *made], [*keep, *names.values()])

    made = docs.mapInArrow(run, schema)
    return made.select(*keep, F.struct(*[F.col(names[c]).alias(c) for c in KINDS]).alias("ts"))


def op10_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = transport_streams(table(spark, sf_dir, "documents").select("doc_id", "text"))
    p = F.col("ts.payload")
    said = F.format_string(
        "packets=%d;errors=%d;streams=%d;units=%d;random=%d;last_pts=%d",
        *[F.col(f"ts.{c}") for c in ("packets", "errors", "streams")], F.size("ts.times"), F.size("ts.random_offsets"), F.element_at("ts.times", -1),
    )
    return ts.select(
        "doc_id", F.col("ts.n_bytes").alias("n_bytes"), F.length(p).cast("long").alias("payload_bytes"), F.sha2(p, 256).alias("payload_sha256"),
        F.crc32(F.substring(p, -16, 16)).alias("tail_crc32"), F.length("ts.media").cast("long").alias("media_bytes"), F.sha2("ts.media", 256).alias("media_sha256"), said.alias("feature"),
        F.col("ts.times").alias("times"), F.col("ts.random_offsets").alias("random_offsets"),
    )
