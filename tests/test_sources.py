"""Readers, storage and streams."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from stemmata.operators import coords, windows
from stemmata.sources import markup, store
from stemmata.streaming import scan as streaming


def test_standard_markers(spark):
    text = "\\id GEN x\n\\h Genesis\n\\c 1\n\\p\n\\v 1 In \\w the|x=\"1\"\\w* beginning\\f + \\ft note\\f*\n\\v 2a And\n\\c 2\n\\v 1 Thus"
    rows = markup.standard_markers(spark.createDataFrame([("f", text)], "path string, content string")).orderBy("seq").collect()
    assert [(r.book, r.chapter, r.verse, r.subverse, r.text) for r in rows] == [("GEN", 1, 1, "", "In the beginning"), ("GEN", 1, 2, "a", "And"), ("GEN", 2, 1, "", "Thus")]


def test_xml_readers(spark):
    tei = '<TEI><div type="book" n="GEN"><div type="chapter" n="1"><head>no</head><ab type="verse" n="t">Title</ab><ab type="verse" n="2b">Text<note>x</note> here</ab></div></div></TEI>'
    rows = markup.read_tei(spark.createDataFrame([("f", tei)], "path string, content string")).orderBy("seq").collect()
    assert [(r.chapter, r.verse, r.subverse, r.text) for r in rows] == [(1, 0, "", "Title"), (1, 2, "b", "Text here")]
    marks = '<t><milestone unit="book" n="B"/><milestone unit="chapter" n="3"/><milestone unit="verse" n="1"/>one<p>two<milestone unit="verse" n="2"/>three</p></t>'
    assert [v[2:] for v in markup.tei_milestones(ET.fromstring(marks))] == [(1, "", "onetwo"), (2, "", "three")]
    osis = '<o><verse osisID="Gen.1.1"><w>be/re</w><w>shit</w></verse></o>'
    assert list(markup.osis_verses(ET.fromstring(osis))) == [("Gen", 1, 1, "", "bere shit")]


def test_html_passages():
    page = '<p><span class="text Gen-1-1"><sup class="versenum">1</sup>In the</span> x <span class="text Gen-1-1">beginning</span><span class="text Gen-1-2">And</span></p>'
    assert markup.html_passages(page) == [("Gen", 1, 1, "", "In thebeginning"), ("Gen", 1, 2, "", "And")]


def test_transliterate_refuses_unknown_letters(spark):
    rows = spark.createDataFrame([("ab",)], "t string")
    assert rows.select(markup.transliterate(F.col("t"), "ab", "xy").alias("t")).first().t == "xy"
    with pytest.raises(Exception, match="without an equivalent"):
        spark.createDataFrame([("aq",)], "t string").select(markup.transliterate(F.col("t"), "ab", "xy")).collect()


def test_replace_by_corpus_and_upsert(spark, tmp_path):
    path = str(tmp_path / "v")
    store.write_corpus(spark.createDataFrame([(1, "a"), (2, "b")], "verse int, corpus string"), path)
    store.write_corpus(spark.createDataFrame([(3, "a")], "verse int, corpus string"), path)
    assert sorted((r.verse, r.corpus) for r in spark.read.parquet(path).collect()) == [(2, "b"), (3, "a")]
    held = spark.createDataFrame([(1, "x", "u"), (2, "y", "w")], "id int, text string, url string")
    new = spark.createDataFrame([(1, "z", None)], "id int, text string, url string")
    assert sorted(tuple(r) for r in store.upserted(held, new, ["id"], ["url"]).collect()) == [(1, "z", "u"), (2, "y", "w")]


def test_steps_skip_what_depends_on_failures(spark):
    steps = {"a": ([], lambda s: s.range(1)), "b": (["a"], lambda s: s.range(0)), "c": (["b"], lambda s: s.range(1)), "d": (["a"], lambda s: s.range(2))}
    assert store.run_steps(spark, steps) == {"a": "ok", "b": "failed", "c": "skipped", "d": "ok"}


def test_mapping_entries(spark):
    pairs = spark.createDataFrame([("GEN 1:2-3", "GEN 2:1-2")], "left string, right string")
    assert sorted(tuple(r) for r in coords.aligned(pairs).collect()) == [("GEN", 1, 2, "GEN", 2, 1), ("GEN", 1, 3, "GEN", 2, 2)]
    with pytest.raises(Exception, match="unequal"):
        coords.aligned(spark.createDataFrame([("GEN 1:2-3", "GEN 2:1")], "left string, right string")).collect()


def test_shards_reassemble(spark):
    found = spark.createDataFrame([(1, 0, 0, 480, 500, 7), (1, 1, 450, 30, 50, 7), (1, 1, 450, 35, 45, 7), (2, 0, 0, 1, 5, 7)], "doc long, part int, offset int, first int, after int, label int")
    done = spark.createDataFrame([(1, 0, 2), (1, 1, 2), (2, 0, 2)], "doc long, part int, parts int")
    assert [tuple(r) for r in windows.reassembled(found, done, "doc").select("doc", "first", "after").collect()] == [(1, 480, 500)]


def test_as_of(spark):
    words = spark.createDataFrame([("b", n) for n in range(1, 7)], "book string, id int")
    starts = spark.createDataFrame([("b", 2), ("b", 5)], "book string, at int")
    got = {r.id: r.start for r in windows.as_of(words, starts, ["book"], "id", "at").collect()}
    assert got == {1: None, 2: 2, 3: 2, 4: 2, 5: 5, 6: 5}


def test_scan_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "so he said one two three four five six seven")], "doc_id long, text string").write.parquet(source)
    items = spark.createDataFrame([(9, "one two three four five six")], "item_id long, text string")
    docs = spark.readStream.schema("doc_id long, text string").parquet(source)
    writer = streaming.scan_stream(docs, items, str(tmp_path / "out"), str(tmp_path / "cp"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert [(r.doc_id, r.item_id, r.run) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 9, 6)]
