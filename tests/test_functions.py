"""References, phrases, stems, tags and options."""

import pytest

from stemmata.functions import phrases, references, stem
from stemmata.library import Library, Options
from stemmata.operators import render

BOOKS = references.Books({"Luke": ["LUK"], "1 Timothy": ["1TI"], "1 Tim": ["1TI"], "Psalms": ["PSA"], "Ps": ["PSA"], "Jude": ["JUD"], "Esdras": ["1ES", "2ES"], "Esther": ["EST"]}, frozenset(["JUD"]), {("PSA", 23): 6})


@pytest.mark.parametrize(("text", "ranges", "status"), [
    ("Luke 2:42", [("LUK", "2", 42, "", "2", 42, "")], "ok"),
    ("Luke 2:42-3:1b", [("LUK", "2", 42, "", "3", 1, "b")], "ok"),
    ("Luke 1:21, 23-24; 3:2", [("LUK", "1", 21, "", "1", 21, ""), ("LUK", "1", 23, "", "1", 24, ""), ("LUK", "3", 2, "", "3", 2, "")], "ok"),
    ("I Timothy iii. 16", [("1TI", "3", 16, "", "3", 16, "")], "ok"),
    ("Ps. 3.1", [("PSA", "3", 1, "", "3", 1, "")], "ok"),
    ("Jude 5-7", [("JUD", "1", 5, "", "1", 7, "")], "ok"),
    ("Psalms 23", [("PSA", "23", 1, "", "23", 6, "")], "ok"),
    ("Esther C:12-30", [("EST", "C", 12, "", "C", 30, "")], "ok"),
    ("1 Tim. 3:16a; 4:1", [("1TI", "3", 16, "a", "3", 16, "a"), ("1TI", "4", 1, "", "4", 1, "")], "ok"), ("Luke 2:42 x", [], "unread"), ("Luke 2:", [], "unread"),
    ("Luke 3", [], "needs a verse"), ("Esdras 1:1", [], "ambiguous"), ("Nobody 1:1", [], "unknown"), ("Luke 3:9-2", [], "out of order"), ("", [], "unread"),
])
def test_references(text, ranges, status):
    assert references.parse(text, BOOKS, whole_chapters=True) == (ranges, status)


def test_reference_column(spark):
    rows = spark.createDataFrame([("Luke 2:42",), (None,)], "r string").select(references.parse_udf(BOOKS)("r").alias("x")).collect()
    assert [(r.x.status, len(r.x.ranges)) for r in rows] == [("ok", 1), ("unread", 0)]


def test_phrases():
    assert phrases.found("as it is written it is so".split(), [["it", "is"], ["as", "it", "is", "written"]]) == [("as it is written", 0, 4), ("it is", 4, 6)]
    assert phrases.covered(["a", "b"], [["a"]]) == 0.5 and phrases.covered([], [["a"]]) == 0.0


@pytest.mark.parametrize(("word", "made"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("rational", "ration"), ("vietnamization", "vietnam"), ("hopefulness", "hope"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("generalizations", "gener"), ("at", "at")])
def test_stems(word, made):
    assert stem.stem(word) == made


def test_tags():
    text = 'See {{Luke 2:42 | en=ASV}} and [passage="Ps 3:1" bold.en="lord .. foes"]\n```passage\npassage: Jude 5\nbad: x\n```\n'
    found = render.citations(text)
    assert [(f["reference"], f["inline"], f["error"]) for f in found] == [("Luke 2:42", True, None), ("Ps 3:1", False, None), ("Jude 5", False, "unknown option bad")]
    assert found[0]["options"] == {"en": "ASV"}


def test_tags_within_tags_and_options_between_bars():
    text = "{{Sir 24:1-9 | en=DRA | original=hebrew lxx}} {{a\nb}} {{ | en=x}}\n```passage\nref: {{Luke 1:1}}\n```\n[passage='Ps 3:1' en=ASV] [passage=\"Ps 4\" {{Ps 5}}"
    found = render.citations(text)
    assert [(f["reference"], f["options"], f["error"]) for f in found] == [
        ("Sir 24:1-9", {"en": "DRA", "original": "hebrew lxx"}, None), ("", {"en": "x"}, "no reference"), ("{{Luke 1:1}}", {}, None), ("Ps 3:1", {"en": "ASV"}, None), ("Ps 5", {}, None)]
    assert all(text[f["start"] : f["end"]][0] in "{[`" for f in found)


def test_marked_spans():
    assert render.mark_spans("When he was Twélve  years old", [("twelve .. old", "bold")]) == "When he was **Twélve  years old**"
    with pytest.raises(ValueError, match="not found"):
        render.mark_spans("abc", [("xyz", "bold")])
    with pytest.raises(ValueError, match="overlap"):
        render.mark_spans("a b c", [("a .. b", "bold"), ("b .. c", "italic")])


def test_render(spark):
    docs = spark.createDataFrame([(1, "A {{Luke 2:42}} z {{Ps 9:9}}!"), (2, "none")], "doc_id long, text string")
    passages = spark.createDataFrame([("Luke 2:42", "And when", "ASV")], "reference string, body string, label string")
    got = {r.doc_id: r for r in render.render(docs, render.tags(docs), passages).collect()}
    assert got[1].rendered == "A “And when” (Luke 2:42) z *Ps 9:9 — not found*!" and got[1].missing == 1
    assert (got[2].rendered, got[2].missing) == ("none", 0)


def test_options(spark):
    assert Options.of({"limit": "3"}).limit == 3
    for bad in ({"speed": 1}, {"limit": "x"}, {"common": 2.0}, {"min_grade": "best"}):
        with pytest.raises(ValueError):
            Options.of(bad)
    items = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, "nine ten eleven twelve thirteen fourteen fifteen"), *((k, f"w{k} x{k} y{k} z{k} v{k}") for k in range(3, 40))], "item_id long, text string")
    docs = spark.createDataFrame([(7, "and so one two three four five six seven eight he said"), (8, "nothing of that kind is here at all today")], "doc_id long, text string")
    found = Library(spark, items).scan(docs, min_grade="direct").collect()
    assert [(r.doc_id, r.item_id, r.first, r["after"], r.identified) for r in found] == [(7, 1, 2, 10, True)]
