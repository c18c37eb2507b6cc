"""The pipeline, stage by stage on what the one before it kept, against brute force."""

import os
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, brute_hits, brute_kept, edited, prose

import corpus_pipeline
from stemmata.llm import components, quality, tokens
from stemmata.llm.shared import cut, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    bench = [(1, prose(500, 30)), (2, prose(501, 14))]
    shared = prose(502, 60)
    texts = {k: prose(k, 90) for k in range(300)}
    texts |= {k: " ".join(f"{w}@@@" for w in prose(k, 90).split()) for k in range(300, 380)}
    texts |= {400 + k: edited(prose(k, 90), k, 0.01) for k in range(10)} | {420: prose(3, 90), 421: None, 422: ""}
    texts |= {430 + k: prose(600 + k, 40) + " " + shared + " " + prose(700 + k, 40) for k in range(6)}
    texts |= {440: prose(800, 50) + " " + prose(500, 30)[40:] + " " + prose(801, 50)}
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 300), 0) for k in range(380)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, bench


def test_stages(spark, folder, tmp_path):
    path, texts, bench = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), [dict(texts)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.dtypes == spark.read.parquet(f"{path}/documents.parquet").dtypes
            kept.append({r.doc_id: r.text for r in docs.collect()})
            assert len(kept[-1]) == docs.count()
    _, good, single, short, clean = kept

    assert sum(i in good for i in range(300, 380)) <= 4 and all(i in good for i in [*range(300), *range(400, 410), *range(430, 436), 440])
    groups = brute_components(list(good.items()), 5, 8, 10)
    assert set(single) == {i for i, (_, root) in groups.items() if root == i} and all(single[i] == good[i] for i in single)
    assert 420 not in single and 400 not in single

    order = sorted(single)
    for i, (n, gone, _, _) in zip(order, brute_kept([(single[i] or "").encode() for i in order], 200), strict=True):
        left = len((short[i] or "").encode())
        assert n - gone - 6 <= left <= n - gone  # a character that a cut splits goes too
    assert sum(len(short[i]) < len(single[i]) for i in range(430, 436)) == 6
    assert set(clean) == {i for i in short if not brute_hits(short[i], bench)[1]} and 440 not in clean

    words = tokens.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    got = {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in docs.collect()}
    for i, t in clean.items():
        ids = words.whole.encode(t or "", add_special_tokens=False).ids + [0]
        assert got[i, 0] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert {i for i, _ in got} == set(clean)
    assert corpus_pipeline.run(spark, path).count() == len(got)


@pytest.mark.parametrize("kept", [True, False])
def test_stages_of_awkward_tables(spark, tmp_path, kept):
    names = ["key", "tag", "gram", "_starts", "score", "label", "n", "rep", "a", "page_id", "text_a", "part", "done"]
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id", "en", "s", 5), (3, "once " * 3, "en", None, None), (3, "once " * 3, "en", None, None), (4, prose(1, 5000), "en", "s", None), (5, prose(1, 5000), None, "s", None)]
    docs = spark.createDataFrame([r + ("x",) * len(names) for r in rows], SCHEMA + "".join(f", `{c}` string" for c in names)).filter(F.lit(kept))
    path = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/{k}")
        last, docs = docs, spark.read.parquet(f"{path}/{k}")
        if k < 4:
            assert docs.columns == last.columns
    placed = sorted(((r.doc_id, r.piece) for r in docs.collect()), key=str)
    assert {i for i, _ in placed} == ({1, 2, 3, 4, None} if kept else set())
    assert sum(i == 3 for i, _ in placed) == int(kept)


def test_quality_stage_learns_from_all_labels(spark, folder, monkeypatch):
    """With blocks far smaller than the labels, the stage's model has read every labelled text that is not held out."""
    path, texts, _ = folder
    monkeypatch.setattr(quality, "BLOCK", 64)
    dealt, took = [], quality._labelled
    monkeypatch.setattr(quality, "_labelled", lambda *a: dealt.append(took(*a)) or dealt[-1])
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()}
    held = dealt[0][0].filter("own").collect()
    assert dealt[0][1] > 1 and sorted(bytes(r.text).decode() for r in held) == sorted(t for k, t in texts.items() if k < 380 and zlib.crc32(str(k).encode()) % 4 != 2)
    assert sum(k in kept for k in range(300, 380)) <= 8 and sum(k in kept for k in range(300)) >= 290


def test_kept_tables_leave_no_shuffles(spark):
    """What fed a kept table goes with the action that made it, not when the driver happens to collect its garbage."""
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before = files()
    rows = spark.range(1000).select((F.col("id") % 7).alias("a"), (F.col("id") % 7 + F.col("id") % 3).alias("b"))
    kept = [cut(rows.groupBy("a").agg(F.count("*").alias("n"))), written(rows.groupBy("b").agg(F.count("*").alias("n")))[0]]
    mark = components._mark(rows)
    deadline = time.time() + 10
    while (left := files() - before) and time.time() < deadline:
        time.sleep(0.1)
    assert not left
    assert [t.count() for t in kept] == [7, 9] and mark[0] == 1000


def test_few_edges_are_contracted_without_rounds(spark, monkeypatch):
    """The same components either way, and no shuffle but those of the distinct edges where the edges are few."""
    draw = np.random.default_rng(4)
    rows = [(int(a), int(b)) for a, b in draw.integers(0, 900, (700, 2))] + [(5000 + k, 5001 + k) for k in range(40)] + [(7, 7), (None, 1)]
    edges = spark.createDataFrame(rows, "a long, b long")
    few = sorted(components.components(edges).collect())
    monkeypatch.setattr(components, "LOCAL_EDGES", 0)
    assert few == sorted(components.components(edges).collect()) and len(few) > 700
    assert components.components(edges.limit(0)).count() == 0
    monkeypatch.setattr(components, "LOCAL_EDGES", 10_000)
    marks = []
    monkeypatch.setattr(components, "_mark", lambda held, real=components._mark: marks.append(1) or real(held))
    assert components.components(edges).count() == len(few) and len(marks) == 1
