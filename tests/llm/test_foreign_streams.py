"""The stream reader on streams that its own writer does not make, put together here byte by byte."""

import pytest

from foliomill.llm import transport


def crc(data):
    """The checksum bit by bit."""
    c = 0xFFFFFFFF
    for b in data:
        for k in range(7, -1, -1):
            top = c >> 31 ^ b >> k & 1
            c = (c << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if top else 0)
    return c


def section(table, number, body, current=1):
    whole = bytes([table, 0xB0 | len(body) + 9 >> 8, len(body) + 9 & 255, number >> 8, number & 255, 0xC0 | current, 0, 0]) + body
    return whole + crc(whole).to_bytes(4, "big")


class Mux:
    def __init__(self):
        self.counters, self.out = {}, []

    def packet(self, pid, data, starts=False, flags=None, jump=0):
        """One packet; what does not fit is returned."""
        n = self.counters[pid] = self.counters.get(pid, -1) + 1 + jump & 15
        room = 184 - (2 if flags is not None else 0)
        now, rest = data[:room], data[room:]
        field = b"" if flags is None else bytes([1 + room - len(now), flags]) + b"\xff" * (room - len(now))
        if flags is None and len(now) < 184:  # stuffing in an adaptation field of its own
            fill = 184 - len(now)
            field = b"\x00" if fill == 1 else bytes([fill - 1, 0]) + b"\xff" * (fill - 2)
        self.out.append(bytes([0x47, (0x40 if starts else 0) | pid >> 8, pid & 255, (0x30 if field else 0x10) | n]) + field + now)
        assert len(self.out[-1]) == 188
        return rest

    def send(self, pid, data, flags=None):
        data = self.packet(pid, data, True, flags)
        while data:
            data = self.packet(pid, data)

    def tables(self, pids, pad=0):
        body = b"\xe1\x00\xf0\x00" + b"".join(bytes([6, 0xE0 | p >> 8, p & 255, 0xF0 | pad >> 8, pad & 255]) + b"d" * pad for p in pids)
        self.send(0, b"\x00" + section(0, 1, b"\x00\x01\xf0\x20"))
        self.send(0x1020, b"\x00" + section(2, 1, body), flags=0)

    def media(self):
        return b"".join(self.out)


def pes(data, pts=None, unbounded=False):
    stamp = b"" if pts is None else bytes([0x21 | pts >> 29 & 14, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1])
    length = 0 if unbounded else 3 + len(stamp) + len(data)
    return b"\x00\x00\x01\xe0" + length.to_bytes(2, "big") + bytes([0x80, 0x80 if stamp else 0, len(stamp)]) + stamp + data


@pytest.mark.parametrize("n", [1, 170, 576, 5000])
def test_packets_of_no_stated_length(n):
    m = Mux()
    m.tables([0x100])
    first, second = bytes(i % 251 for i in range(n)), b"z" * n
    m.send(0x100, pes(first, 90_000, unbounded=True), flags=0x40)
    m.send(0x100, pes(second, (1 << 33) - 1, unbounded=True))
    s = transport.read_stream(m.media())
    assert (s.payload, s.errors, s.times, s.offsets, s.random) == (first + second, 0, [90_000, (1 << 33) - 1], [0, n], [True, False])


def test_sections_over_several_packets():
    m, pids = Mux(), list(range(0x100, 0x100 + 60))
    m.tables(pids, pad=9)
    m.send(pids[-1], pes(b"last stream"))
    s = transport.read_stream(m.media())
    assert s.programs == {1: dict.fromkeys(pids, 6)} and s.payload == b"last stream" and s.errors == 0 and s.times == [-1]


def test_streams_in_turn():
    m = Mux()
    m.tables([0x100, 0x101])
    a, b = pes(b"a" * 300, 1), pes(b"b" * 300, 2)
    a = m.packet(0x100, a, True)
    b = m.packet(0x101, b, True)
    m.packet(0x100, a)
    m.packet(0x1FFF, b"\xff" * 184, jump=5)
    m.packet(0x101, b)
    s = transport.read_stream(m.media())
    assert s.payload == b"a" * 300 + b"b" * 300 and s.pids == [0x100, 0x101] and s.errors == 0


def test_marked_and_unmarked_jumps():
    for flags, errors in ((0x80, 0), (0x00, 1)):
        m = Mux()
        m.tables([0x100])
        m.send(0x100, pes(b"one"))
        m.packet(0x100, pes(b"two"), True, flags, jump=3)
        s = transport.read_stream(m.media())
        assert s.payload == b"onetwo" and s.errors == errors


def test_tables_not_in_force_and_broken():
    m = Mux()
    m.send(0, b"\x00" + section(0, 1, b"\x00\x01\xf0\x30", current=0))
    m.tables([0x100])
    m.send(0x100, pes(b"data"))
    assert transport.read_stream(m.media()).programs == {1: {0x100: 6}} and transport.read_stream(m.media()).errors == 0
    broken = bytearray(m.media())
    broken[2 * 188 - 6] ^= 1  # in the second table
    assert transport.read_stream(bytes(broken)).errors > 0
    m = Mux()
    m.tables(range(0x100, 0x100 + 60))
    del m.out[2:]  # the rest of a section is missing
    assert transport.read_stream(m.media()).errors == 1
