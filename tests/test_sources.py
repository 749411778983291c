"""Readers and writers on files made here."""

import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from linkloom.operators import reporting as R
from linkloom.sources import files, sinks
from tests.conftest import rows

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOC = f'<w:document {W}><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:rPr><w:b/><w:color w:val="0000FF"/></w:rPr><w:t>One </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>'
XML = '<ectd:ectd xmlns:ectd="e" xmlns:xlink="http://www.w3.org/1999/xlink" sequence-number="us0007"><fda-regional/><leaf ID="a" xlink:href="m1/x.pdf" operation="Replace" checksum="C"><title> T </title></leaf><leaf/><leaf href="m2/y.pdf" operation="odd"/></ectd:ectd>'


def test_docx_and_listing(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", DOC)
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_text("x")
    got = files.read_docx(spark, str(tmp_path)).orderBy("path", "para", "run").collect()
    assert [(r.para, r.run, r.text, r.bold, r.color, r.style, r.in_table) for r in got if r.error is None] == [(0, 0, "One ", True, "0000FF", "Heading1", False), (0, 1, "two", False, None, "Heading1", False), (1, 0, "cell", False, None, None, True)]
    assert [r.error for r in got if r.error] == ["BadZipFile"]
    assert files.list_documents(spark, str(tmp_path)).count() == 2


def test_backbones(spark, tmp_path):
    (tmp_path / "index.xml").write_text(XML)
    (tmp_path / "bad.xml").write_text("<ectd>")
    df = files.read_backbones(spark, str(tmp_path))
    got = sorted((r.leaf_id, r.relative_path, r.operation, r.checksum, r.title, r.schema_version, r.region, r.sequence_number) for r in df.where("error is null").collect())
    assert got == [("a", "m1/x.pdf", "replace", "C", "T", "v3.2", "us", "0007"), ("leaf-anon-2", "m2/y.pdf", "new", None, None, "v3.2", "us", "0007")]
    assert df.where("error is not null").count() == 1
    twice = df.where("error is null").withColumn("src_ord", F.lit(0)).unionByName(df.where("error is null").withColumn("src_ord", F.lit(1)).withColumn("title", F.lit("later")))
    assert sorted(str(r.title) for r in files.merge_regional(twice).collect()) == ["None", "T"]


def test_json_lines(spark, tmp_path):
    (tmp_path / "gold.jsonl").write_text('{"text": "Table 1", "entities": [[0, 7, "TABLE_REF"]]}\n')
    assert files.read_gold(spark, str(tmp_path / "gold.jsonl")).first().entities[0].label == "TABLE_REF"
    ev = spark.createDataFrame([(datetime(2024, 1, 2, 3, 4, 5), "me", "run", "d", 1, {"k": "v"})], "timestamp timestamp, actor string, action string, document string, links_added int, details map<string,string>")
    sinks.write_audit(ev, str(tmp_path / "audit"))
    (tmp_path / "audit" / "z.json").write_text("not json\n\n")
    assert [r.timestamp for r in files.read_audit(spark, str(tmp_path / "audit")).collect()] == ["2024-01-02T03:04:05Z"]
    assert files.read_rules(str(tmp_path / "none.yaml")) == []


def test_report_is_read_as_written(spark, tmp_path):
    schema = "link_id int, source_doc string, link_text string, link_location_descriptor string, target_doc string, target_anchor string, status string, confidence double, error_msg string, detected_by string"
    links = spark.createDataFrame([(1, "b", 'a "quoted", text', "p", None, None, "unverified", 0.5, None, None), (2, "a", "t", "p", "d", "x", "broken", None, "two words", "r")], schema)
    assert sinks.write_links_csv(links, str(tmp_path / "r")) and not sinks.write_links_csv(links.limit(0), str(tmp_path / "none"))
    back = files.read_report(spark, str(tmp_path / "r"))
    assert back.columns == R.REPORT_COLUMNS and not (tmp_path / "none").exists()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, R.csv_rows(links).drop("link_id").collect()))
    assert [(r.kind, r.confidence) for r in R.report_from_rows(back).orderBy("kind").collect()] == [("broken_link", 0.9), ("unverified_link", 0.5)]


def test_registries(spark, tmp_path):
    assert files.read_deprecated_ids(spark, str(tmp_path / "none.yaml")).count() == 0
    (tmp_path / "ids.yaml").write_text("deprecated:\n  - id: SP-2019-001\n    reason: gone\n  - reason: no id\n")
    try:
        import yaml  # noqa: F401
    except ImportError:
        for read in (files.read_rules, lambda p: files.read_deprecated_ids(spark, p)):
            with pytest.raises(ImportError):
                read(str(tmp_path / "ids.yaml"))
    else:
        assert rows(files.read_deprecated_ids(spark, str(tmp_path / "ids.yaml")).select("id", "reason")) == [("SP-2019-001", "gone")]


def test_sinks(spark, tmp_path):
    links = spark.createDataFrame([(1, "b", "t", "p", None, None, "ok", 0.5, None, None), (2, "a", "t", "p", "d", "x", "broken", None, "e", "r")], "link_id int, source_doc string, link_text string, link_location_descriptor string, target_doc string, target_anchor string, status string, confidence double, error_msg string, detected_by string")
    sinks.write_links_csv(links.coalesce(1), str(tmp_path / "csv"))
    assert [r.status for r in spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()] == ["broken", "ok"]
    plan = spark.createDataFrame([("d", 0, 1), ("d", 1, 0), ("d", 0, 5)], "document string, run int, span_start int")
    assert [(r.run, r.span_start) for r in sinks.edit_plan(plan).orderBy("step").collect()] == [(1, 0), (0, 5), (0, 1)]
    h = "document string, href string"
    assert rows(sinks.missing_insertions(spark.createDataFrame([("d", "x"), ("d", "x"), ("d", "y")], h), spark.createDataFrame([("d", "y")], h))) == [("d", "x")]
    s = "k int, v string, first string"
    assert rows(sinks.upsert(spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], s), spark.createDataFrame([(2, "c", "z"), (3, "d", "w")], s), ["k"], ["first"])) == [(1, "a", "x"), (2, "c", "y"), (3, "d", "w")]
