"""Queries do the whole job: every row of a table, checked on small tables written here."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from stemmata.functions import kernels
from stemmata.operators import models

FILLER = " ".join(f"filler{k}" for k in range(100))
ITEM = "seven grey herons waited beside the frozen mill until evening"


@pytest.fixture
def tables(spark, tmp_path):
    """Writes a table of the test's own and gives the folder."""

    def write(**made):
        for name, (rows, schema) in made.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
BENCHMARK = "item_id long, text string"


def documents(*texts, lang="en"):
    return [(k, t, lang, f"src{k % 2}", len(t or "")) for k, t in enumerate(texts)], DOCUMENTS


def test_search_asks_long_documents(spark, tables):
    others = [(k, f"unlike{k} words{k} of{k} its{k} own{k}") for k in range(1, 20)]
    sf = tables(documents=documents(f"{FILLER} {ITEM}", ITEM), benchmark=([(0, ITEM), *others], BENCHMARK))
    got = {(r.doc_id, r.item_id, r.rank) for r in entry.queries()["search_full"](spark, sf).collect()}
    assert got == {(0, 0, 1), (1, 0, 1)}


def test_words_that_a_passage_lacks_move_no_block():
    draw = random.Random(3)
    for _ in range(300):
        a, b = [draw.choice("abcdefgh") for _ in range(draw.randint(1, 60))], [draw.choice("abcd") for _ in range(draw.randint(1, 12))]
        n = kernels.matched_words(a, b)
        assert (2.0 * n / (len(a) + len(b)), n / len(a)) == (kernels.ratio(a, b), kernels.coverage(a, b))


def test_rendering_keeps_and_reads_whole_texts(spark, tables):
    long = f"{FILLER} {{{{item 1}}}} {FILLER} {{{{nothing}}}} a {{ b"
    sf = tables(documents=documents(long, None), benchmark=([(0, ITEM), (1, "body one")], BENCHMARK))
    got = {r.doc_id: (r.rendered, r.missing) for r in entry.queries()["rendered_documents"](spark, sf).collect()}
    assert got == {
        0: (f"{FILLER} “body one” (item 1) {FILLER} *nothing — not found* a {{ b “{ITEM}” (item 0) end", 1),
        1: (" “body one” (item 1) end", 0),
    }


def test_cosine_asks_every_fiftieth_id(spark, tables):
    draw = random.Random(5)
    held = {k: [float(draw.randint(-3, 3)) for _ in range(4)] for k in range(30, 260)} | {300: [0.0] * 4, 301: None, 302: [1.0]}
    sf = tables(embeddings=([(k, v, 0) for k, v in held.items()], "vec_id long, embedding array<float>, label int"))
    cosine = lambda a, b: math.floor(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)) * 1e4 + 0.5) / 1e4
    usable = {k: v for k, v in held.items() if v and len(v) == 4 and any(v)}
    want = set()
    for q in usable:
        if q % 50 == 0:
            near = sorted((-cosine(usable[q], v), k) for k, v in usable.items() if k != q)[:5]
            want |= {(q, k, -c) for c, k in near}
    assert len(want) == 5 * sum(q % 50 == 0 for q in usable) > 15
    assert {(r.query_id, r.vec_id, r.cosine) for r in entry.queries()["cosine_topk"](spark, sf).collect()} == want


def test_every_chapter_is_expanded(spark, tables):
    last = {k: 1 + k % 4 for k in range(1, 60) if k % 5}
    rows = [(k, v) for k, n in last.items() for v in range(1, n + 1)]
    sf = tables(lineitem=(rows, "l_orderkey long, l_linenumber int"))
    want = set()
    for k in last:
        for c in (c for c in last if c % 7 == k % 7 and k <= c <= k + 7):
            low, high = 2 if c == k else 1, min(3, last[c]) if c == k + 7 else last[c]
            want |= {(k, c, v) for v in range(low, high + 1)}
    got = [(r.id, r.chapter, r.verse) for r in entry.queries()["expand_ranges"](spark, sf).collect()]
    assert set(got) == want and len(got) == len(want)


def mixed(n, vocabulary, words=30):
    """Documents of several languages over few words."""
    draw = random.Random(n)
    texts = [[draw.choice(vocabulary) for _ in range(words)] for _ in range(n)]
    return texts, ([(k, " ".join(t), ("fr", "de", "en", "xx")[k % 4], f"src{k % 3}", 1) for k, t in enumerate(texts)], DOCUMENTS)


def test_ngrams_are_of_all_documents(spark, tables):
    texts, made = mixed(24, ["alba", "brio", "calx", "dune"])
    sf = tables(documents=made)
    counts = Counter()
    for k, t in enumerate(texts):
        for n in range(1, 6):
            for i in range(len(t) - n + 1):
                for author in (f"src{k % 3}", ""):
                    counts[author, n, " ".join(t[i : i + n])] += 1
    sums = Counter()
    for (author, n, _), c in counts.items():
        sums[author, n] += c
    kept = {g: c for g, c in counts.items() if g[1] < 3 or c >= 2}
    run = lambda name: entry.queries()[name](spark, sf).collect()
    assert {(r.author, r.ord, r.gram): r["count"] for r in run("ngram_counts")} == kept
    assert {(r.author, r.ord): r.tokens for r in run("ngram_totals")} == sums
    assert {(r.ord, r.gram): r.rate for r in run("ngram_rates")} == {(n, g): math.floor(round(c * 1e6 / sums["", n], 4)) for (a, n, g), c in kept.items() if a == ""}
    peaks = {}
    for k, t in enumerate(texts):
        own = [kept["", n, g] * 1e6 / sums["", n] for n in (4, 5) for i in range(len(t) - n + 1) if ("", n, g := " ".join(t[i : i + n])) in kept]
        peaks |= {k: pytest.approx(max(own), abs=0.01)} if own else {}
    assert len(peaks) == 24 and {r.doc_id: r.peak for r in run("peak_rate")} == peaks


def test_ppmi_is_of_all_documents_and_words(spark, tables):
    texts, made = mixed(40, [f"w{a}{b}" for a in "abcdefg" for b in "klmnop"])
    sf = tables(documents=made)
    held = {w for w, c in Counter(w for t in texts for w in t).items() if c >= 10}
    n, margin = Counter(), Counter()
    for t in texts:
        for i, a in enumerate(t):
            for b in t[i + 1 : i + 6]:
                if a in held and b in held:
                    n[a, b] += 1
                    n[b, a] += 1
    for (a, _), c in n.items():
        margin[a] += c
    total = sum(margin.values())
    want = {(a, b): w for (a, b), c in n.items() if (w := round(math.log2(c * total / (margin[a] * margin[b])), 4)) > 0}
    got = {(r.a, r.b): (r.n, r.weight) for r in entry.queries()["ppmi_pairs"](spark, sf).collect()}
    assert got == {g: (n[g], pytest.approx(w, abs=1e-4)) for g, w in want.items()}
    vectors = defaultdict(dict)
    for (a, b), (_, w) in got.items():
        vectors[a][b] = w
    norm = {a: math.sqrt(sum(w * w for w in v.values())) for a, v in vectors.items()}
    cosines = {(x, y): pytest.approx(sum(vectors[x][d] * vectors[y][d] for d in both) / (norm[x] * norm[y]), abs=1e-4) for x in vectors for y in vectors if x < y and (both := set(vectors[x]) & set(vectors[y]))}
    assert len(vectors) > 30 and len(cosines) > 435
    assert {(r.x, r.y): r.cosine for r in entry.queries()["ppmi_cosine"](spark, sf).collect()} == cosines


def test_allusions_weigh_all_words(spark, tables):
    draw = random.Random(9)
    words = [f"w{k}" for k in range(40)]
    said = {c: [[draw.choice(words) for _ in range(6)] + ["all"] for _ in range(2)] for c in range(60)}
    rows = [(c, t, "user", " ".join(x)) for c, turns in said.items() for t, x in enumerate(turns)]
    sf = tables(conversations=(rows, "conv_id long, turn long, role string, text string"))
    n = Counter(w for turns in said.values() for w in set(turns[1]))
    bits = {w: round(max(0.0, math.log2(60 / (c + 1))), 6) for w, c in n.items()}
    want = {}
    for c, (own, _) in said.items():
        sums = {t: sum(bits[w] for w in shared) for t, (_, other) in said.items() if (shared := set(own) & set(other))}
        near = [t for t, s in sums.items() if max(sums.values()) - s <= 2.0]
        t = min(near, key=lambda t: (t % 4 != 0, -round(sums[t], 4), t))
        want[c] = (t, pytest.approx(sums[t], abs=1e-4), int(t % 4 == 0))
    assert {r.conv_id: (r.target, r.bits, r.quoted) for r in entry.queries()["allusions"](spark, sf).collect()} == want
    from stemmata.operators import knowledge
    from pyspark.sql import functions as F

    long = spark.createDataFrame([(c, t, w) for c, turns in said.items() for t, x in enumerate(turns) for w in x], "conv_id long, turn int, token string")
    gestures, candidates = long.filter("turn = 0").select("conv_id", "token"), long.filter("turn = 1").select(F.col("conv_id").alias("target"), "token", (F.col("conv_id") % 4 == 0).cast("int").alias("quoted"))
    weights = spark.createDataFrame(list(bits.items()), "token string, bits double")
    got = knowledge.allusions_in_blocks(gestures, candidates, weights, "conv_id", block=7)
    assert {r.conv_id: (r.target, r.bits, r.quoted) for r in got.collect()} == want


def test_peaks_of_the_own_model_shuffle_one_window_a_position(spark):
    from stemmata.operators import models

    texts = [(1, "s", "a b c d e a b c d".split()), (2, "s", "x a b c d e".split()), (3, "t", "a b c".split()), (4, "t", "p q r s".split())]
    rows = spark.createDataFrame(texts, "doc_id long, source string, t array<string>")
    sums = models.totals(rows, "source")
    rated = models.rates(models.pruned(models.pooled_ngrams(rows, 4, 5)), sums)
    peaks = lambda made: {r.doc_id: r.peak for r in made.collect()}
    got = models.own_peaks(rows, "doc_id", sums)
    assert peaks(got) == peaks(models.peak_rates(rows, "doc_id", rated)) and set(peaks(got)) == {1, 2}


def test_ppmi_counts_numbers_or_words(spark, monkeypatch):
    """Numbered words give the rows that words give; their pairs are shuffled as one long."""
    draw = random.Random(8)
    texts = [([draw.choice(["ä", "b", "é", "zz", "\U0001d49c", "\ufb00", "c"]) for _ in range(draw.randint(0, 30))],) for _ in range(60)] + [(None,), (["b"],)]
    rows = spark.createDataFrame(texts, "t array<string>")
    numbered = models.ppmi(rows, dims=3)
    assert "pair" in numbered._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(numbered.collect())
    monkeypatch.setattr(models, "VOCABULARY", 2)
    assert got == sorted(models.ppmi(rows, dims=3).collect()) and got
    monkeypatch.setattr(models, "VOCABULARY", 1000)
    assert models.ppmi(rows, least=10_000).count() == 0


def test_ngrams_are_shuffled_as_packed_windows(spark, monkeypatch):
    """Windows in many small blocks give the counts of all grams, with and without the rare ones; no gram is shuffled as a string."""
    draw = random.Random(12)
    texts = [(draw.choice(["s", "t", "", None]), [draw.choice(["ä", "b", "|", "\U0001d49c", "c", "same"]) for _ in range(draw.choice([0, 1, 2, 3, 4, 5, 9, 40]))]) for _ in range(80)] + [(None, None), ("s", ["same"] * 60)]
    rows = spark.createDataFrame(texts, "source string, t array<string>")
    monkeypatch.setattr(models, "_BLOCK", 50)
    monkeypatch.setattr(models, "_BUCKET", 100)
    monkeypatch.setattr(models, "_SHARED", 3)
    for orders in (1, 2, 3, 5):
        each = Counter((a, n, " ".join(t[i : i + n])) for a, t in texts for n in range(1, orders + 1) for i in range(len(t or []) - n + 1))
        pooled = Counter()
        for (_, n, g), c in each.items():
            pooled["", n, g] += c
        for least in (1, 2):
            made = models.ngrams(rows, "source", orders, least=least)
            want = [(*g, c) for held in (each, pooled) for g, c in held.items() if g[1] < 3 or c >= least]
            assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, want))
    assert "windows" in made._jdf.queryExecution().optimizedPlan().toString()


def test_scan_scores_only_candidates_that_can_stand(monkeypatch):
    """Candidates with too few common words are not aligned, and what is left has the scores of the kernels."""
    import pandas as pd

    from stemmata.operators import scan

    draw = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    bits = {w: draw.choice([-0.5, 1.0, 4.0, 6.0]) for w in words}
    made = [(k, 1, 7, [draw.choice(words) for _ in range(draw.randint(3, 24))], [draw.choice(words) for _ in range(draw.randint(1, 14))]) for k in range(1500)]
    made = [(k, i, b, text, text[1:9] if k % 5 == 0 else item) for k, i, b, text, item in made]
    rows = pd.DataFrame(made, columns=["doc_id", "item_id", "base", "words", "item"])
    want = {}
    for k, _, base, text, item in made:
        first, after = kernels.matched_span(text, item) or (0, 0)
        own = text[first:after]
        if len(own) >= 5 and sum(w in item for w in own) >= 3:
            longest = max(b[2] for b in kernels.matching_blocks(own, item))
            near, covered = kernels.ratio(own, item), kernels.coverage(own, item)
            length, worth, _, _ = kernels.chain([frozenset([w]) for w in own], [frozenset([w]) for w in item], bits)
            needed = max(2, min(6, len(own) // 2))
            grade = "direct" if (near >= 0.55 or covered >= 0.90) and longest >= needed else "partial" if 3 <= longest < needed else "indirect"
            if grade != "indirect" or (length >= 4 and worth >= 15):
                want[k] = (base + first, base + after, near, covered, longest, length, worth, grade)
    asked, align = [], kernels.matched_span
    monkeypatch.setattr(kernels, "matched_span", lambda a, b: (asked.append(sum(w in b for w in a)), align(a, b))[1])
    got = {r.doc_id: tuple(r)[3:] for r in pd.concat(scan._scored(bits, 2)([rows])).itertuples() if r.grade != "indirect" or (r.chain >= 4 and r.bits >= 15)}
    assert got == want and {g[-1] for g in want.values()} == {"direct", "partial", "indirect"}
    assert min(asked) >= 3


def test_peaks_are_shuffled_as_packed_windows(spark, monkeypatch):
    """Windows in many small blocks give the peaks of all grams, with keys of any kind; no gram is shuffled as a string."""
    from stemmata.operators import models

    draw = random.Random(15)
    texts = [(draw.choice([f"k{k}", f"k{k - 1}", None]), "s", [draw.choice(["ä", "b", "|", "\U0001d49c", "c", "same", f"own{k}", f"own{k}x"]) for _ in range(draw.choice([0, 1, 3, 4, 5, 9, 40, 60]))]) for k in range(120)]
    texts += [("none", None, None), ("all", "t", ["same"] * 50), ("four", "t", "one two three four".split()), ("five", "t", "one two three four five".split())]
    rows = spark.createDataFrame(texts, "name string, source string, t array<string>")
    monkeypatch.setattr(models, "_BLOCK", 150)
    monkeypatch.setattr(models, "_BUCKET", 100)
    monkeypatch.setattr(models, "_SHARED", 3)
    for low, high in ((4, 5), (3, 6), (2, 2)):
        grams = Counter((n, *t[i : i + n]) for _, _, t in texts for n in range(low, high + 1) for i in range(len(t or []) - n + 1))
        sums = Counter()
        for g, c in grams.items():
            sums[g[0]] += c
        want = {}
        for k, _, t in texts:
            for n in range(low, high + 1):
                for i in range(len(t or []) - n + 1):
                    if (c := grams[(n, *t[i : i + n])]) >= (2 if n >= 3 else 1):
                        want[k] = max(want.get(k, 0), round(c * 1e6 / sums[n], 4))
        made = models.own_peaks(rows, "name", low=low, high=high)
        assert {r.name: r.peak for r in made.collect()} == pytest.approx(want) and None in want
        assert made.collect() and {r.name: r.peak for r in models.own_peaks(rows, "name", models.totals(rows, "source", 6), low, high).collect()} == pytest.approx(want)
    assert "windows" in made._jdf.queryExecution().optimizedPlan().toString()
    assert models.own_peaks(rows.filter("t is null"), "name").count() == 0


def test_scan_sweeps_within_tasks_or_by_joins(spark, monkeypatch):
    """Candidates found in tasks give the findings of the joins, and only findings are shuffled; more items than an index holds are joined."""
    from stemmata.operators import nominate, scan

    draw = random.Random(21)
    words = [f"w{k}" for k in range(90)] + ["x", "é", "\U0001d49c\U0001d49c"]
    items = [(k, [draw.choice(words[: 30 + k]) for _ in range(draw.randint(1, 25))]) for k in range(60)] + [(70, []), (71, None)]
    said = []
    for k in range(150):
        text = [draw.choice([*words, f"own{draw.randint(0, 50)}"]) for _ in range(draw.choice([0, 3, 12, 13, 30, 200]))]
        for _ in range(k % 4):
            quoted = [w for w in draw.choice(items[:60])[1] if draw.random() < 0.9]
            at = draw.randint(0, len(text))
            text[at:at] = quoted
        said.append((k, text))
    docs, held = spark.createDataFrame([*said, (500, None), (None, said[1][1])], "doc_id long, t array<string>"), spark.createDataFrame(items, "item_id long, t array<string>")
    monkeypatch.setattr(nominate, "_WORDS", 700)
    monkeypatch.setattr(nominate, "_SPAN", 60)
    for min_run, common in ((3, 0.3), (2, 0.2), (5, 0.1)):
        made = scan.scan(docs, held, min_run, common)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") == 1
        with monkeypatch.context() as patched:
            patched.setattr(nominate, "ITEMS", 59)
            joined = scan.scan(docs, held, min_run, common)
            assert "Join" in joined._jdf.queryExecution().executedPlan().toString()
            want = sorted(map(repr, joined.collect()))
        assert sorted(map(repr, made.collect())) == want and len(want) > 50
    assert scan.scan(docs, held.filter("item_id > 69")).count() == 0


def test_cosines_are_multiplied_in_blocks(spark, monkeypatch):
    """Blocks of vectors that meet in tasks give the cosines of all pairs; products are not shuffled."""
    from stemmata.operators import models

    draw = random.Random(30)
    vectors = {f"w{k}é" if k % 3 else f"\U0001d49c{k}": {f"d{draw.randint(0, 60)}": draw.choice([-1.5, 0.5, 2.0, 3.25]) for _ in range(draw.randint(1, 6))} for k in range(90)}
    for low in (-2, 0):
        held = {x: {d: w for d, w in v.items() if w > low} for x, v in vectors.items()}
        rows = spark.createDataFrame([(x, d, w) for x, v in held.items() for d, w in v.items()] + [(None, "d1", 1.0)], "a string, b string, weight double")
        norm = {x: math.sqrt(sum(w * w for w in v.values())) for x, v in held.items()}
        want = {(x, y): pytest.approx(sum(held[x][d] * held[y][d] for d in both) / (norm[x] * norm[y]), abs=1e-4) for x in held for y in held if x < y and (both := held[x].keys() & held[y].keys())}
        monkeypatch.setattr(models, "_CELLS", 100)
        made = models.shared_cosines(rows)
        got = made.collect()
        assert {(r.x, r.y): r.cosine for r in got} == want and len(got) == len(want) > 300
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Aggregate" not in plan
