"""Pixels, crops and hashes of images; projections, their comparison, the golden command."""

import json
import random
import struct
import zlib

import numpy as np
import pytest

from foliomill import __main__ as command
from foliomill.functions import images as I
from foliomill.operators import golden as G
from tests import packages


def filtered(lines: list[bytes], kinds: list[int], step: int) -> bytes:
    """Scan lines with their filters, byte by byte."""
    out, above = b"", bytes(len(lines[0]))
    for line, kind in zip(lines, kinds, strict=True):
        row = [kind]
        for i, x in enumerate(line):
            a, b, c = line[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = a + b - c
            paeth = min((abs(p - v), n, v) for n, v in enumerate((a, b, c)))[2]
            row.append((x - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out, above = out + bytes(row), line
    return out


def image(width, height, depth, colour, lines, kinds, palette=b""):
    step = max(1, depth * I.CHANNELS[colour] // 8)
    parts = [(b"IHDR", struct.pack(">2I5B", width, height, depth, colour, 0, 0, 0))] + ([(b"PLTE", palette)] if palette else [])
    return packages.chunked(*parts, (b"IDAT", zlib.compress(filtered(lines, kinds, step))), (b"IEND", b""))


@pytest.mark.parametrize("colour, depth", [(0, 8), (2, 8), (4, 8), (6, 8), (2, 16), (0, 16), (3, 8)])
def test_pixels_of_all_filters(colour, depth):
    r = random.Random(colour * 31 + depth)
    n, width, height = I.CHANNELS[colour], 7, 11
    palette = bytes(r.randrange(256) for _ in range(3 * 256)) if colour == 3 else b""
    samples = np.array([[[r.randrange(256) for _ in range(n * depth // 8)] for _ in range(width)] for _ in range(height)], np.uint8)
    data = image(width, height, depth, colour, [bytes(x.ravel()) for x in samples], [r.randrange(5) for _ in range(height)], palette)
    high = samples.reshape(height, width, n, depth // 8)[:, :, :, 0]
    want = np.array([[[*palette[3 * p[0] : 3 * p[0] + 3]] if colour == 3 else p[:3] if n >= 3 else [p[0]] * 3 for p in line] for line in high.tolist()])
    got = I.decoded(data).rgb
    assert got.shape == (height, width, 3) and (got == want).all()
    assert (I.decoded(I.encoded(got)).rgb == got).all()


def test_pixels_of_few_bits_and_damage():
    assert I.decoded(image(5, 1, 1, 0, [b"\xa8"], [0])).rgb[0, :, 0].tolist() == [255, 0, 255, 0, 255]
    assert I.decoded(image(3, 1, 4, 0, [b"\x0f\x80"], [0])).rgb[0, :, 0].tolist() == [0, 255, 136]
    good = packages.png(3, 2)
    for bad in (b"", b"x" * 40, good[:-14], good[:40] + b"?" + good[41:], image(2, 1, 8, 0, [b"\0\0\0"], [0]), image(1, 1, 8, 3, [b"\5"], [0], b"\0\0\0"), image(1, 1, 8, 2, [b"\0\0\0"], [0]).replace(b"IDAT", b"IDAX")):
        with pytest.raises(ValueError):
            I.decoded(bad)


def test_crops_keep_pixels_and_profile():
    r = np.random.default_rng(3)
    rgb = r.integers(0, 256, (40, 60, 3), np.uint8)
    data = I.encoded(rgb, {b"iCCP": b"p\0\0abc", b"pHYs": b"\0" * 9})
    for box in [(0.1, 0.2, 0.5, 0.9), (0, 0, 1, 1), (0.99, 0.99, 1.1, 1.05), (-0.1, 0, 0.2, 0.1)]:
        x0, y0, x1, y1 = round(box[0] * 60), round(box[1] * 40), round(box[2] * 60), round(box[3] * 40)
        want = [[rgb[y, x].tolist() if 0 <= y < 40 and 0 <= x < 60 else [0, 0, 0] for x in range(x0, x1)] for y in range(y0, y1)]
        part = I.decoded(I.crop(data, box))
        assert part.rgb.tolist() == want and part.kept[b"iCCP"] == b"p\0\0abc" and struct.unpack(">2IB", part.kept[b"pHYs"]) == (11811, 11811, 1)
    with pytest.raises(ValueError):
        I.crop(data, (0.5, 0.5, 0.5, 0.9))


def slow_hash(rgb: np.ndarray) -> str:
    def lobes(t: float) -> float:
        return float(np.sinc(t) * np.sinc(t / 3)) if abs(t) < 3 else 0.0

    def line(values: list[int], wanted: int) -> list[int]:
        scale, out = len(values) / wanted, []
        wide = max(scale, 1.0)
        for i in range(wanted):
            centre = (i + 0.5) * scale
            first, last = max(int(centre - 3 * wide + 0.5), 0), min(int(centre + 3 * wide + 0.5), len(values))
            w = [lobes((x - centre + 0.5) / wide) for x in range(first, last)]
            whole = [int(v / sum(w) * 2**22 + (0.5 if v >= 0 else -0.5)) for v in w]
            out.append(min(255, max(0, (sum(a * b for a, b in zip(whole, values[first:last], strict=True)) + 2**21) >> 22)))
        return out

    plain = [[(19595 * r + 38470 * g + 7471 * b + 0x8000) >> 16 for r, g, b in row] for row in rgb.tolist()]
    rows = [line(row, 9) for row in plain]
    cells = list(zip(*[line([row[x] for row in rows], 8) for x in range(9)], strict=True))
    return f"{sum((cells[y][x] > cells[y][x + 1]) << (y * 8 + x) for y in range(8) for x in range(8)):016x}"


@pytest.mark.parametrize("width, height", [(61, 47), (9, 8), (5, 3), (100, 7)])
def test_hash_against_plain_resampling(width, height):
    rgb = np.random.default_rng(width).integers(0, 256, (height, width, 3), np.uint8)
    assert I.perceptual_hash(rgb) == slow_hash(rgb)
    assert I.perceptual_hash(np.full((20, 30, 3), 255, np.uint8)) == "0" * 16


def kept(**changed) -> dict:
    image = {"path": "a.png", "width": 9, "height": 8, "rgb_sha256": "aa", "dhash": "f" * 16}
    base = {"format": "f", "format_version": "1", "notice": "n", "source": {"id": "src-001", "x": [1, 2.5]}, "package_id": "u", "document_sha256": "d", "pages_sha256": "p", "elements_sha256": "e", "omissions_sha256": "o", "page_count": 1, "element_count": 2, "omission_count": 0}
    return base | {"page_images": [image, image | {"path": "b.png"}], "engine_fingerprint": {"native": ["1"], "recognised": []}, "validation": {"valid": False, "checks": {"a": "passed"}}, "content_quality": {"status": "partial"}} | changed


OTHER = {"native": ["2"], "recognised": []}


def seen(second: dict, **changed) -> dict:
    a = kept()["page_images"]
    return kept(page_images=[a[0], a[1] | second], **changed)


@pytest.mark.parametrize("actual, expected", [
    (kept(), []), (kept(notice="other"), []), (kept(source={"x": [1, 2.5], "id": "src-001"}), []), (kept(source={"id": "src-001", "x": [2.5, 1]}), ["source"]), (kept(page_count=2, validation={"valid": True, "checks": {}}), ["page_count", "validation"]),
    (kept(page_images=kept()["page_images"][:1]), ["page_images.count"]), (seen({"rgb_sha256": "bb"}), ["page_images[2].rgb_sha256"]), (seen({"rgb_sha256": "bb"}, engine_fingerprint=OTHER), []), (seen({"dhash": "f" * 14 + "c0"}, engine_fingerprint=OTHER), []),
    (seen({"dhash": "0f" + "f" * 13 + "8"}, engine_fingerprint=OTHER), ["page_images[2].dhash"]), (seen({"width": 1, "path": "c.png"}), ["page_images[2].path", "page_images[2].width"]), (kept(package_id=None), ["package_id"]), (kept(page_images=None), ["page_images.count"]),
])
def test_differences(spark, actual, expected):
    a, b = (G.read_projections(spark.createDataFrame([("k", json.dumps(x))], "package string, json string")) for x in (kept(), actual))
    assert sorted(r["difference"] for r in G.differences(a, b).collect()) == sorted(expected)


def test_packages_on_one_side_and_paths(spark):
    one, none = (G.read_projections(spark.createDataFrame(rows, "package string, json string")) for rows in ([("k", json.dumps(kept()))], []))
    assert [tuple(r) for r in G.differences(one, none).collect()] == [("k", "package")] == [tuple(r) for r in G.differences(none, one).collect()]
    assert G.differences(none, none).count() == 0
    assert G.paths({"a": [1, {"b": 2}], "c": 1}, {"a": [1, {"b": 3}], "d": 1}, "v") == ["v.a[2].b", "v.c", "v.d"] and G.paths([1], [1, 2], "v") == ["v"] and G.paths(1, True, "v") == ["v"] and G.paths({}, {}) == []


def test_projection_of_a_package_and_command(spark, tmp_path, capsys):
    root = packages.build(tmp_path / "p")
    report = {"valid": False, "checks": {"a": "passed"}, "errors": [{"code": "z"}, {"code": "b"}], "warnings": []}
    of = {"format": "f", "format_version": "0.1", "case_id": "tides", "url": "https://example.org/tides.pdf", "sha256": packages.SOURCE_SHA, "size": 4096, "original_name": "tides.pdf"}
    manifest = packages.manifest()
    manifest["sources"][0]["x-origin"] = {"kind": "remote-url", "url": of["url"], "sha256": of["sha256"]}
    (root / "manifest.json").write_text(json.dumps(manifest))
    (root / "validation/report.json").write_text(json.dumps(report))
    golden = tmp_path / "tides"
    assert command.main(["golden", str(root), str(golden)]) == 2  # nothing to compare with
    golden.mkdir()
    (golden / "source.json").write_text(json.dumps(of))
    (golden / "notes.txt").write_text("stays")
    for given in (["--update"], ["--update", "--case-id", "tides", "--confirm-update", "tide"], ["--update", "--case-id", "waves", "--confirm-update", "waves"]):
        assert command.main(["golden", str(root), str(golden), *given]) == 2 and not (golden / "projection.json").exists()
    assert command.main(["golden", str(root), str(golden), "--update", "--case-id", "tides", "--confirm-update", "tides"]) == 0
    said = json.loads((golden / "projection.json").read_text())
    elements = [G.element_view(json.loads(x)) for x in (root / "provenance/elements.jsonl").read_text().splitlines()]
    assert said["elements_sha256"] == G.hashlib.sha256(json.dumps(elements, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert said["omissions_sha256"] == G.hashlib.sha256(b"[]").hexdigest() and (said["page_count"], said["element_count"], said["omission_count"]) == (2, len(packages.PARTS), 0)
    assert said["source"] == manifest["sources"][0] and said["validation"]["error_codes"] == ["b", "z"] and said["engine_fingerprint"] == {"native": ["3"], "recognised": ["3"]}
    assert [i["path"] for i in said["page_images"]] == [packages.image(1), packages.image(2)] and said["page_images"][0]["rgb_sha256"] == G.hashlib.sha256(b"\xff" * 270000).hexdigest()
    assert (golden / "notes.txt").read_text() == "stays" and (golden / "expected/content/document.xml").read_bytes() == (root / "content/document.xml").read_bytes() and json.loads((golden / "quality.json").read_text()) == said["content_quality"]
    (root / "content/document.xml").write_text(packages.document().replace("Harbours", "Harbors"))
    capsys.readouterr()
    assert command.main(["golden", str(root), str(golden)]) == 1
    assert {x for x in capsys.readouterr().err.splitlines() if x.startswith("differs: ")} >= {"differs: document_sha256"}


def test_what_packages_lack(spark, tmp_path):
    roots = [packages.build(tmp_path / k) for k in "abc"]
    (roots[1] / packages.image(2)).unlink()
    (roots[1] / "validation/report.json").write_text("{}")
    (roots[2] / "provenance/omissions.jsonl").unlink()
    (roots[2] / "provenance/elements.jsonl").write_text('{"element_id": 1}\n')
    lines = {k: [(str(r), k, n, x) for r in roots if (r / p).exists() for n, x in enumerate((r / p).read_text().splitlines())] for k, p in G.RECORDS.items()}
    records = spark.createDataFrame([x for rows in lines.values() for x in rows], "package string, kind string, nth int, json string")
    pictures = [(r, k, n, json.loads(x)["image"]) for r, k, n, x in lines["pages"]]
    images = spark.createDataFrame([(r, n, p, bytearray((tmp_path / r / p).read_bytes()) if (tmp_path / r / p).exists() else None) for r, _, n, p in pictures], "package string, nth int, path string, content binary")

    def told(name: str, column: str):
        return spark.createDataFrame([(str(r), (r / name).read_text()) for r in roots], f"package string, {column} string")

    versions = spark.createDataFrame([], "package string, native array<string>, recognised array<string>")
    got = G.projection(told("manifest.json", "json"), told("content/document.xml", "document_sha256"), records, G.image_facts(images), versions, told("validation/report.json", "json"), told("manifest.json", "json"))
    faults = {r["package"]: r["faults"] for r in got.collect()}
    assert faults == {str(roots[0]): ["unreadable: validation"], str(roots[1]): ["unreadable: validation", f"image {packages.image(2)}: missing"], str(roots[2]): ["unreadable: validation", "unreadable records: elements"]}  # a placeholder report has no lists of findings
    empty = [x.limit(0) for x in (told("manifest.json", "json"), told("manifest.json", "document_sha256"), records, G.image_facts(images), versions, told("manifest.json", "json"), told("manifest.json", "json"))]
    assert G.projection(*empty).count() == 0
