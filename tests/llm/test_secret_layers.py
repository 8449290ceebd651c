"""Secrets in every decoded layer."""

import base64
import bz2
import gzip
import lzma
import zlib

import pytest

from foliomill.llm import secret_scan

KEY = "AKIA" + "Q7" * 8


def found_at(text):
    return [(a, b) for a, k, b in secret_scan.find(text)[1] if k == 1]


@pytest.mark.parametrize("odd", [b"\xff", b"\x00", b"\x0c", b"\x1b", "\u00a0".encode(), "\u200b".encode(), b"\xe2\x80"])
def test_secrets_beside_odd_bytes(odd):
    inner = b"some text " + odd + KEY.encode() + odd + b" and more"
    for data in (inner, gzip.compress(inner), base64.b64encode(inner)):
        run = base64.b64encode(data).decode()
        assert found_at(f"see \u00e9 {run} end")
        assert all(6 <= a < b <= 6 + len(run) for a, b in found_at(f"see \u00e9 {run} end"))


@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress, bz2.compress, lzma.compress])
@pytest.mark.parametrize("before", ["", "a", "ab", "abc", "files/", "data_", "some/long/path-to_"])
def test_secrets_in_base64_after_a_prefix(before, pack):
    run = base64.b64encode(pack(f"key {KEY} end".encode())).decode()
    assert found_at(f"{before}{run} x")
    if pack is bytes:
        a, b = found_at(f"{before}{run} x")[0]
        assert base64.b64decode(f"{before}{run}"[a:b]).find(KEY.encode()) >= 0


@pytest.mark.parametrize("width", [16, 21, 64, 76])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  "])
def test_secrets_in_wrapped_base64(width, end):
    inner = "".join(f"line {i * 7919} of it\n" for i in range(9)) + KEY
    for data in (inner.encode(), gzip.compress(inner.encode())):
        run = base64.b64encode(data).decode()
        wrapped = end.join(run[i : i + width] for i in range(0, len(run), width))
        text = f"mail:\n\n{wrapped}\nbye"
        assert found_at(text)
        assert all(7 <= a < b <= 7 + len(wrapped) for a, b in found_at(text))


@pytest.mark.parametrize("before", ["", "x", "xy", "xyz"])
def test_short_runs_of_compressed_secrets(before):
    for inner in (b"a" * 16, b"f0" * 12, b"0" * 40):
        run = base64.b64encode(zlib.compress(inner, 9)).decode().rstrip("=")
        assert len(run) < 22
        spans = secret_scan.find(f"see {before}{run} end")[1]
        assert [(a, b) for a, k, b in spans if k == 2] == [(4, 4 + len(before) + len(run))]
        wrapped = f"{run[:8]}\n{run[8:]}"
        assert any(k == 2 for _, k, _ in secret_scan.find(f"- {wrapped} -")[1])
    assert secret_scan.find("incomprehensibilities")[1] == []
