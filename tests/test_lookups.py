"""Lookups and choices on hand-made tables."""

import pytest
from pyspark.errors import PySparkException

from stemmata.operators import coords, lookups

VERSES = "corpus string, book string, chapter long, verse long, text string"


@pytest.fixture
def verses(spark):
    return spark.createDataFrame([("x", "A", c, v, f"{c}:{v}") for c, n in ((1, 4), (2, 3), (4, 2)) for v in range(1, n + 1)], VERSES)


def test_strict_fetch_raises_and_availability_does_not(spark, verses):
    asked = spark.createDataFrame([(2, "A", 2, 3), (1, "A", 1, 1), (3, "A", 3, 1)], "pos long, book string, chapter long, verse long")
    assert [r.text for r in lookups.available(verses, asked).orderBy("pos").collect()] == ["1:1", "2:3"]
    assert lookups.strict(verses, asked.filter("pos < 3")).count() == 2
    with pytest.raises(PySparkException, match="no verse A 3 1"):
        lookups.strict(verses, asked).collect()


def test_ranges_across_chapters_are_cut(spark, verses):
    asked = spark.createDataFrame([(1, "A", 1, 3, 4, 1), (2, "A", 2, 2, 1, 1)], "id long, book string, chapter long, verse long, end_chapter long, end_verse long")
    assert [r.text for r in lookups.across(verses, asked).orderBy("k").collect()] == ["1:3", "1:4", "2:1", "2:2", "2:3", "4:1"]
    assert [r.text for r in lookups.across(verses, asked, 2).orderBy("k").collect()] == ["1:3", "1:4"]


def test_no_known_witness_is_no_anachronism(spark):
    rows = spark.createDataFrame([(1, 100, 200), (1, 100, None), (2, 100, 50), (2, 100, 300), (3, 100, None)], "k long, work_year int, witness_year int")
    assert {r.k: r.anachronistic for r in lookups.anachronistic(rows, ["k"]).collect()} == {1: True, 2: False, 3: False}


def test_projection_ends_with_its_block(spark):
    bounds = spark.createDataFrame([("A", 1, 0), ("A", 2, 7), ("A", 3, 20)], "book string, verse long, at long")
    blocks = spark.createDataFrame([("A", 5, 9, 4), ("A", 12, 18, 3)], "book string, a long, b long, size long")
    assert {r.verse: r.projected for r in lookups.projected(bounds, blocks, ["book"]).collect()} == {1: None, 2: 11, 3: 21}


def test_stale_corrections_are_told(spark):
    kind = "book string, chapter long, verse long, p_book string, p_chapter long, p_verse long"
    mapped = spark.createDataFrame([("A", 1, 1, "A", 1, 2), ("A", 1, 2, "A", 1, 3)], kind)
    rows = [("drop", "A", 1, 1, None, None, None, "w"), ("drop", "A", 9, 9, None, None, None, "gone"), ("fix", "A", 1, 2, "A", 1, 3, "done"), ("add", "A", 1, 3, "A", 1, 4, "new"), ("add", "A", 1, 2, "A", 1, 9, "held")]
    now, stale = coords.corrected(mapped, spark.createDataFrame(rows, f"action string, {kind}, why string"))
    assert sorted((r.verse, r.p_verse) for r in now.collect()) == [(2, 3), (3, 4)]
    assert sorted(r.why for r in stale.collect()) == ["done", "gone", "held"]


def test_same_sample_for_the_same_seed(spark):
    from pyspark.sql import functions as F

    rows = spark.range(100)
    first = [(r.id, r["rank"]) for r in lookups.seeded_sample(rows, F.col("id"), "s", 5).collect()]
    again = [(r.id, r["rank"]) for r in lookups.seeded_sample(rows.repartition(7), F.col("id"), "s", 5).collect()]
    assert sorted(first) == sorted(again) and [k for _, k in sorted(first, key=lambda x: x[1])] == [1, 2, 3, 4, 5]
    assert sorted(first) != sorted((r.id, r["rank"]) for r in lookups.seeded_sample(rows, F.col("id"), "t", 5).collect())
