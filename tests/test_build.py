"""Packages from blocks, sinks, and the streaming query."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from foliomill.operators import build
from foliomill.operators import layout as L
from foliomill.sources.packages import parse_xml
from foliomill.streaming.blocks import event_findings

BLOCKS = [("title", "A <Title>"), ("author", "Ada Lovelace"), ("author", "Alan Turing"), ("affiliation", "1 Some Institute"), ("abstract", "Short."), ("heading", "Start"), ("paragraph", "One & two."), ("heading", "A1. Sub"), ("paragraph", "Three."), ("figure", "A figure"), ("heading", "End"), ("reference", "[1] A. Author (2012)"), ("reference", "[2] B")]


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [(1, i, k, 1 + i // 8, t, 0.1, 0.05 * i, 0.9, 0.05 * i + 0.02) for i, (k, t) in enumerate(BLOCKS, 1)]
    return build.with_ids(spark.createDataFrame(rows, "doc_id long, nth int, kind string, page int, text string, x0 double, y0 double, x1 double, y1 double"))


def test_document_and_records(spark, blocks):
    ids = {r["nth"]: r["element_id"] for r in blocks.collect()}
    assert ids[1] == "title-000002" and ids[6] == "sec-000001" and ids[7] == "p-000002" and ids[13] == "ref-000002"
    row = build.documents(blocks).first()
    nodes, error, _ = parse_xml(row["xml"].encode())
    assert error is None
    found = {n["id"]: n for n in nodes if n["id"]}
    assert [x["element_id"] for x in row["nodes"]] == [n["id"] for n in nodes if n["id"] and n["tag"] != "article"]
    assert "".join(found["title-000002"]["full"]) == "A <Title>" and nodes[found["sec-000002"]["parent"]]["id"] == "sec-000001" and nodes[found["sec-000003"]["parent"]]["tag"] == "body"
    boxes = blocks.select("doc_id", "nth", "page", F.col("nth").alias("seq"), "text", "x0", "y0", "x1", "y1", F.lit(1.0).alias("confidence"))
    records = build.element_records(build.documents(blocks), boxes, boxes.filter("nth > 1"), {"native-pdf": ("n", "1"), "ocr": ("o", "2")})
    got = {r["element_id"]: r for r in records.collect()}
    assert [c["method"] for c in got["p-000002"]["sources"][0]["candidates"]] == ["native-pdf", "ocr"] and len(got["title-000002"]["sources"][0]["candidates"]) == 1
    assert got["fig-000001"]["sources"][0]["candidates"] == [] and got["p-000002"]["decision"]["method"] == "reconciled"
    lines = build.json_lines(records, "reading_order").first()["text"].splitlines()
    assert [json.loads(x)["reading_order"] for x in lines] == sorted(json.loads(x)["reading_order"] for x in lines)


def test_manifest_pages_checksums(spark):
    source = spark.createDataFrame([(1, "a.pdf", "0" * 64, 5, 2, "en")], "doc_id long, original_name string, sha256 string, size long, page_count int, language string")
    m = json.loads(build.manifest(source, "x:", "f", "s", "2026-01-01T00:00:00Z", ("g", "1")).first()["json"])
    assert m["sources"][0]["embedded_path"] is None and m["package_id"].startswith("urn:uuid:")
    pages = spark.createDataFrame([(1, 1, 100.0, 200.0, 90, 10, 20, "completed")], "doc_id long, page int, width_pt double, height_pt double, rotation int, width_px int, height_px int, status string")
    r = build.page_records(pages).first()
    assert (r["width_pt"], r["height_pt"], r["image"]) == (200.0, 100.0, "assets/evidence/pages/src-001/page-000001.png")
    files = spark.createDataFrame([("p", "b", bytearray(b"1")), ("p", "a", bytearray(b"2")), ("p", "checksums.sha256", bytearray(b""))], "package string, path string, content binary")
    assert build.checksums(files).first()["text"] == f"{hashlib.sha256(b'2').hexdigest()}  a\n{hashlib.sha256(b'1').hexdigest()}  b\n"


def test_publish_is_atomic(tmp_path):
    out = tmp_path / "out"
    build.publish(out, lambda d: (d / "x").write_text("1"))
    with pytest.raises(FileExistsError):
        build.publish(out, lambda d: None)

    def fail(_):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        build.publish(out, fail, replace=True)
    assert (out / "x").read_text() == "1" and [p.name for p in tmp_path.iterdir()] == ["out"]
    build.publish(out, lambda d: (d / "y").write_text("2"), replace=True)
    assert [p.name for p in out.iterdir()] == ["y"]
    build.seal(out)
    assert (out / "checksums.sha256").read_text().endswith("  y\n")
    (tmp_path / "link").symlink_to(out)
    with pytest.raises(ValueError):
        build.safe_output(tmp_path / "link" / "z", tmp_path / "in")
    with pytest.raises(ValueError):
        build.safe_output(out / "z", out)


def test_streaming_findings(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet")
    source.limit(300).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = event_findings(stream).writeStream.outputMode("complete").format("memory").queryName("event_findings").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT sum(n) AS n, sum(n_bad) AS b FROM event_findings").first()
    assert got["n"] == 300 and 0 <= got["b"] <= 300


def test_queries_and_oracles_agree_in_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert L.PAGE == ["doc_id", "page"]
