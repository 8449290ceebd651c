"""The quality report: metrics, candidates, resources, status, command."""

import json

import pytest
from pyspark.sql import functions as F

from foliomill import __main__ as command
from foliomill.operators import quality as Q
from foliomill.operators import validation
from foliomill.operators.layout import REASONS
from foliomill.sources.packages import parsed
from tests import packages

XML = """<article id="doc-000001"><front><article-meta><title-group><article-title id="title-000002">On Rivers and Deltas</article-title></title-group>
<contrib-group><contrib id="author-000001" contrib-type="author"><name id="name-000001"><surname>Okafor</surname><given-names>Ngozi</given-names></name><xref ref-type="aff" rid="aff-000001">1</xref></contrib><contrib id="author-000002" contrib-type="editor"/></contrib-group>
<aff id="aff-000001"><label>1</label> Delta Institute</aff><author-notes><fn id="fn-000001" fn-type="equal"><p>same share</p></fn><fn fn-type="other"><p>no</p></fn></author-notes><pub-date id="date-000001"/><abstract id="abstract-000001"><p id="p-000001">12</p></abstract></article-meta></front>
<body><sec id="sec-000001"><title id="title-000003">Silt</title><p id="p-000002">Silt moves
  downstream.</p><p id="p-000003"> 17 </p><p id="p-000004">a = b</p><p id="p-000005">(2)</p><p id="p-000006"/><fig id="fig-000001"><caption id="caption-000001"><p>Map of silt</p></caption></fig>
<sec id="sec-000002"><title id="title-000004">Café</title><disp-formula id="eq-000001"/><p id="p-000007">éééé</p></sec></sec></body>
<back><ref-list><ref id="ref-000001"><label>1</label><mixed-citation>One.</mixed-citation></ref><ref id="ref-000002"><label>x</label></ref><ref id="ref-000003"><label>2</label></ref></ref-list></back></article>"""
RECORDS = "package string, element_id string, sources array<struct<candidates:array<struct<method:string,text:string>>>>, revisions array<struct<after:string>>, resources array<struct<path:string>>"


def nodes(spark, *documents):
    return parsed(spark.createDataFrame([(f"k{i}", bytearray(x.encode())) for i, x in enumerate(documents)], "package string, content binary"))


def record(element_id, *texts, revisions=None, package="k0"):
    """texts: for each source a list of (method, text)."""
    return (package, element_id, [{"candidates": [{"method": m, "text": t} for m, t in source]} for source in texts], revisions, None)


def test_metrics_of_nodes(spark):
    got = Q.node_metrics(nodes(spark, XML, "<article><body>", "<article/>")).collect()
    rows = {r["package"]: r.asDict() for r in got}
    assert rows.keys() == {"k0", "k2"}
    want = {
        "article_titles": 1, "authors": 1, "author_affiliation_xrefs": 1, "equal_contribution_notes": 1, "affiliations": 1, "abstracts": 1, "publication_dates": 1, "body_sections": 2, "body_paragraphs": 7, "references": 3, "figures": 1, "tables": 0,
        "formulas": 1, "page_number_paragraphs": 1, "short_fragment_paragraphs": 4, "formula_only_paragraphs": 3, "labels": [1, 2], "short_fragment_examples": ["17", "(2)", "", "éééé"],
    }
    assert {k: rows["k0"][k] for k in want} == want | {"formula_only_paragraphs": rows["k0"]["formula_only_paragraphs"]}
    assert rows["k0"]["formula_only_paragraphs"] == 3  # 17, a = b, (2)
    assert rows["k2"]["body_paragraphs"] == 0 and rows["k2"]["labels"] == []


@pytest.mark.parametrize("final, candidates, after, expected", [
    ("The river bends twice", ["a wholly other sentence"], [], False), ("The river bends twice", ["THE RIVER BENDS TWICE and goes on"], [], True), ("bends", [], [], False), ("", [], [], True),
    ("one two three four", ["four three two one"], [], True), ("one two", ["two one " + "more " * 9], [], False), ("the rlver bends twlce", ["the river bends twice"], [], True), ("A-B c", ["zzz"], [None, "a b C"], True), ("A-B c", ["zzz"], ["a b d"], False),
])
def test_texts_against_candidates(final, candidates, after, expected):
    assert Q.agrees(final, candidates, after) is expected


def test_candidates_of_a_method_go_together_over_sources(spark):
    rows = [record("p-000002", [("native-pdf", "Silt moves"), ("ocr", "noise")], [("native-pdf", "downstream."), (None, "x"), ("ocr", "")]), record("title-000002", [("ocr", "Nothing alike here")]), record("name-000001", [("native-pdf", "Ngozi Okafor")]), record("fig-000001", [("ocr", "no match")]), record("p-000003", [("ocr", "q")], revisions=[{"after": "1 7"}]), ("k0", "title-000003", None, None, None)]
    elements = spark.createDataFrame(rows, RECORDS)
    assert elements.select(Q.candidate_texts(F.col("sources"))).first()[0] == ["Silt moves downstream.", "noise", "x"]
    found = {(r["code"], r["element_id"]) for r in Q.consistency(nodes(spark, XML), elements).collect()}
    assert {e for c, e in found if c == "candidate_text_mismatch"} == {"title-000002", "title-000003"}
    assert {"sec-000001", "ref-000001", "date-000001", "fn-000001"} <= {e for c, e in found if c == "provenance_missing"} and ("provenance_missing", "p-000002") not in found


def test_report_and_status(spark):
    fine = '<article><front><article-meta><title-group><article-title id="title-000002">T of things</article-title></title-group><abstract id="abstract-000001"/></article-meta></front><body><sec id="sec-000001"><p id="p-000001">Some words here</p></sec></body><back><ref-list><ref id="ref-000001"><label>1</label></ref></ref-list></back></article>'
    known = [record(i, [("ocr", t)]) for i, t in (("title-000002", "T of things"), ("abstract-000001", ""), ("sec-000001", "Some words here"), ("p-000001", "Some words here"), ("ref-000001", "1"))]
    elements = spark.createDataFrame(known, RECORDS)
    omissions = spark.createDataFrame([("k0", *REASONS["table"]), ("k0", *REASONS["formula"]), ("k0", *REASONS["page-number"]), ("k1", *REASONS["stamp"])], "package string, type string, reason string")
    pages = spark.createDataFrame([("k0", 1), ("k0", 2)], "package string, page int")
    first, second = Q.quality_report(nodes(spark, fine, XML), elements, omissions, pages).orderBy("package").collect()
    assert first["status"] == "partial" and [first[f"criterion_{c}"] for c in Q.CRITERIA] == ["passed"] * 3 + ["partial"] * 5 and first["findings"] == []
    assert (first["pages"], first["addressable_elements"], first["omissions"], first["page_number_omissions"], first["tables_omitted_with_evidence"], first["display_math_regions_omitted_with_evidence"]) == (2, 5, 3, 1, 1, 1)
    assert second["status"] == "failed" and second["criterion_semantic_structure"] == second["criterion_xml_provenance_consistency"] == "failed" and second["criterion_references"] == "partial" and second["pages"] == 0
    failures = spark.createDataFrame([("k0", "page_coverage_not_audited")], "package string, code string")
    assert Q.quality_report(nodes(spark, fine), elements, omissions, pages, failures=failures).first()["status"] == "partial"
    failures = spark.createDataFrame([("k0", "checksum_mismatch")], "package string, code string")
    assert Q.quality_report(nodes(spark, fine), elements, omissions, pages, failures=failures).first()["criterion_package_integrity"] == "failed"


def test_resources_that_are_no_sound_png(spark):
    content = {"good.png": packages.png(2, 2), "cut.png": packages.png(2, 2)[:-20], "text.png": b"not an image", "photo.png": b"\xff\xd8\xff\xe0abc"}
    files = spark.createDataFrame([("k", p, "file", bytearray(c)) for p, c in content.items()], "package string, path string, kind string, content binary")
    rows = [("k", p, None, None, [{"path": p}]) for p in [*content, "gone.png"]] + [("k", "nameless", None, None, [{"path": None}]), ("k", "none", None, None, None)]
    found = Q.resource_findings(spark.createDataFrame(rows, RECORDS), files, validation.png_facts(files))
    assert {(r["element_id"], r["code"]) for r in found.collect()} == {("cut.png", "resource_unreadable"), ("text.png", "resource_unreadable"), ("gone.png", "resource_unreadable"), ("photo.png", "resource_not_png"), ("nameless", "resource_path_invalid")}


def test_command(spark, tmp_path, capsys):
    root = packages.build(tmp_path / "p")
    assert command.main(["quality", str(root), "--json"]) in (0, 1)
    said = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert said["article_titles"] == said["abstracts"] == said["body_sections"] == said["references"] == 1 and said["criterion_references"] == "failed"  # it has no label
    assert command.main(["quality", str(tmp_path / "none")]) == 2
    (root / "content/document.xml").write_text("<article>")
    assert command.main(["quality", str(root)]) == 2
    assert command.main(["query", "no_such_query", "x", "y"]) == 2


def test_consistency_joins_once(spark):
    elements = spark.createDataFrame([record("title-000002", [("ocr", "Nothing alike here")])], RECORDS)
    plan = Q.consistency(nodes(spark, XML), elements)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1 and plan.count("MapInArrow") == 1


def test_only_wanted_texts_are_read(spark):
    found = spark.createDataFrame([("k0", bytearray(XML.encode()))], "package string, content binary")
    whole, some = (parsed(found, texts=t).orderBy("seq").collect() for t in (None, {"own_text": {"label"}, "flat": {"p"}}))
    assert [(r["tag"], r["id"], r["attrs"], r["trail"]) for r in whole] == [(r["tag"], r["id"], r["attrs"], r["trail"]) for r in some]
    assert [(r["own_text"], r["flat"], r["full_text"], r["spaced"]) for r in some] == [(r["own_text"] if r["tag"] == "label" else None, r["flat"] if r["tag"] == "p" else None, None, None) for r in whole]
