"""The training-data operators against brute force, round trips and awkward rows."""

import hashlib
import itertools
import random
import re
import tracemalloc
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stemmata.llm import chat_format, decontaminate, license_scan, minhash, packing, quality, shared, suffix, suffix_dedup, tokens, topk, url_filter, warc
from stemmata.llm.components import components
from stemmata.llm.queries import URL_RULES
from stemmata.llm.shared import ALNUM

#: Clashing names that operators use inside, on purpose.
DOCS = "doc_id long, text string, key string, pair string, score string, n string"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def made(spark, rows):
    return spark.createDataFrame([(i, t, "k", "p", "s", "n") for i, t in rows], DOCS)


def prose(seed, n):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "ré", "SO") for b in ("tan", "vel", "wix", "yör", "zap")]
    return " ".join(draw.choice(words) for _ in range(n))


def shouted(text):
    """A-Z for a-z, other letters as they are."""
    return re.sub("[a-z]", lambda m: m[0].upper(), text)


AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "nobody's text"), (5, prose(5, 3000)), (6, "Two WORDS"), (7, "\u00a0 é \x00 ß")]


# url filters

@pytest.mark.parametrize(("url", "rule", "verdict"), [
    ("http://a.com/en/1", "com/en/", "block"), ("http://x.example.com/en/77?q", "example.com/en/7", "allow"), ("HTTP://B.NET/de/8#x", "net/de/", "allow"),
    ("http://c.example.net/de/80", "example.net/de/8", "block"), ("http://notorg/es/", None, "allow"), ("http://o.org/es/1", "org/es/", "block"), ("no address", None, "allow"), (None, None, "allow"),
])
def test_url_rules(spark, url, rule, verdict):
    pages = spark.createDataFrame([(1, url, "clash")], "page_id long, url string, host string").select("page_id", "url")
    got = url_filter.filter_urls(pages, URL_RULES).first()
    assert (got.rule, got.verdict) == (rule, verdict)


def test_url_host_and_path(spark):
    rows = spark.createDataFrame([("ftp://USER.Ä.com:80/P/?x",), ("a://b#c/d",), ("://",)], "url string")
    host, path = url_filter.host_and_path(F.col("url"))
    assert [tuple(r) for r in rows.select(host, path).collect()] == [("user.Ä.com:80", "/P/"), ("b", ""), ("", "")]


def test_url_templates_reject_bad_branches_only(spark):
    rows = [(f"http://h.test/spam/{i}", 1) for i in range(40)] + [(f"http://h.test/good/{i}", 0) for i in range(40)] + [("http://h.test/spam/999", None), ("http://h.test/good/999", None)]
    pages = spark.createDataFrame([(i, u, b, "x") for i, (u, b) in enumerate(rows)], "page_id long, url string, bad int, purity string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, [], label=F.col("bad")).collect()}
    assert got[80] == "block" and got[81] == "allow"
    assert all(r.verdict == "allow" for r in url_filter.filter_urls(pages, []).collect())
    assert url_filter.filter_urls(pages.limit(0), URL_RULES).count() == 0


def brute_templates(urls, wide=32, least_share=0.2, z=1.96, reject=0.9):
    """Verdict of each (host, segments, label), by a plain tree."""
    raw = [(h, tuple("*" if re.search(url_filter._IDENTIFIER, s) else s for s in segs), b) for h, segs, b in urls]
    made = [()] * len(raw)
    for level in range(max((len(s) for _, s, _ in raw), default=0)):
        children = {}
        for (h, segs, _), t in zip(raw, made, strict=True):
            if level < len(segs):
                node = children.setdefault((h, t), {})
                node[segs[level]] = node.get(segs[level], 0) + 1
        wild = {k for k, node in children.items() if len(node) > wide and max(node.values()) < least_share * sum(node.values())}
        made = [t if level >= len(segs) else (*t, "*" if (h, t) in wild else segs[level]) for (h, segs, _), t in zip(raw, made, strict=True)]
    place = {(h, t): t for (h, _, _), t in zip(raw, made, strict=True)}
    tally = {}
    for (h, _, b), t in zip(raw, made, strict=True):
        own = tally.setdefault((h, t), [0, 0])
        if b is not None:
            own[0], own[1] = own[0] + 1, own[1] + b

    def apart(n, bad, all_n, all_bad):
        if not n or n == all_n:
            return False
        p = all_bad / all_n
        return abs(bad / n - (all_bad - bad) / (all_n - n)) > z * (p * (1 - p) * (1 / n + 1 / (all_n - n))) ** 0.5 + 1e-12

    for level in reversed(range(max(map(len, made), default=0))):
        beside = {}
        for (h, t), m in place.items():
            if level < len(m):
                own = beside.setdefault((h, m[:level], m[level + 1 :]), {}).setdefault(m[level], [0, 0])
                own[0], own[1] = own[0] + tally[h, t][0], own[1] + tally[h, t][1]
        marks = {}
        for node, branches in beside.items():
            n, bad = (sum(x[k] for x in branches.values()) for k in (0, 1))
            sides = {}
            for seg, (m, b) in branches.items():
                sides.setdefault("/=" if not apart(m, b, n, bad) else "/+" if b * n > bad * m else "/-", []).append(seg)
            for side, segs in sides.items():
                n, bad = (sum(branches[s][k] for s in segs) for k in (0, 1))
                marks |= {(node, s): s if side != "/=" and apart(*branches[s], n, bad) else side for s in segs}
        for (h, t), m in place.items():
            if level < len(m):
                place[h, t] = (*m[:level], marks[(h, m[:level], m[level + 1 :]), m[level]], *m[level + 1 :])
    pooled = {}
    for (h, t), m in place.items():
        own = pooled.setdefault((h, m), [0, 0])
        own[0], own[1] = own[0] + tally[h, t][0], own[1] + tally[h, t][1]
    bad = {k for k, (n, b) in pooled.items() if (b + 1) / (n + 2) >= reject}
    return ["block" if (h, place[h, t]) in bad else "allow" for (h, _, _), t in zip(raw, made, strict=True)]


@pytest.mark.parametrize("seed", range(3))
def test_url_templates_against_a_plain_tree(spark, seed):
    draw = random.Random(seed)
    rates = {}
    rows = []
    for k in range(900):
        host = draw.choice(["a.test", "b.test", ""])
        segs = [draw.choice(["shop", "news", "x"]), *(draw.choice(["p", "q", "r", f"item{draw.randint(0, 90)}", str(draw.randint(1, 999))]) for _ in range(draw.randint(0, 7)))]
        rate = rates.setdefault((host, segs[0], len(segs) > 2 and segs[1]), draw.choice([0, 0.05, 0.97, 1]))
        rows.append((host, segs, draw.choice([None, int(draw.random() < rate)])))
    pages = spark.createDataFrame([(k, f"http://{h}/{'/'.join(s)}", "no" if b is None else str(b), "x", "y") for k, (h, s, b) in enumerate(rows)], "page_id long, url string, bad string, host string, raw string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, [], label=F.col("bad")).collect()}
    want = brute_templates(rows)
    assert [got[k] for k in range(len(rows))] == want
    assert {"block", "allow"} == set(want)


def test_url_deep_paths_and_odd_rows(spark):
    deep = "/".join("abcdefg")
    rows = [(None, f"http://h.test/{deep}/bad/{k}", 1) for k in range(40)] + [(7, f"http://h.test/{deep}/good/{k}", 0) for k in range(40)] + [(8, None, None), (8, "", None), (9, "x" * 100_000, None)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, bad int, verdict string")
    got = url_filter.filter_urls(pages, [], label=F.col("bad")).collect()
    assert len(got) == len(rows)
    assert {(r.page_id, r.verdict) for r in got} == {(None, "block"), (7, "allow"), (8, "allow"), (9, "allow")}


def test_url_rules_against_sql(spark, tmp_path):
    import duckdb

    from stemmata.llm import queries

    path = "/root/testdata/sf0.001"
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in queries.op1_url_filters(spark, path).collect())
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in URL_RULES)
    want = duckdb.sql(f"""
        with p as (select page_id, coalesce(case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end, '') as rest from '{path}/pages.parquet'),
        u as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
        r(verdict, rule, h, pre) as (values {rules})
        select u.page_id, host, path, arg_max(rule, length(rule)), arg_max(verdict, length(rule))
        from u left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, pre) group by all order by 1, 2, 3""").fetchall()
    assert got == sorted(want)


def verdicts(spark, rows):
    """The urls that are blocked, of (url, bad) rows and no rules."""
    pages = spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(rows)], "page_id long, url string, bad int")
    return {rows[r.page_id][0] for r in url_filter.filter_urls(pages, [], label=F.col("bad")).collect() if r.verdict == "block"}


def test_url_purity_counts_labelled_urls_only(spark):
    # 40 of 100 urls are labelled, all bad; another branch is as pure with fewer labels, a third has none
    sparse = [(f"http://h.test/spam/{k}", 1 if k < 40 else None) for k in range(100)]
    thin = [(f"http://h.test/thin/{k}", 1 if k < 5 else None) for k in range(50)]
    none = [(f"http://h.test/none/{k}", None) for k in range(20)]
    assert verdicts(spark, sparse + thin + none) == {u for u, _ in sparse + thin + none}
    good = [(f"http://h.test/good/{k}", 0) for k in range(200)]
    assert verdicts(spark, sparse + good) == {u for u, _ in sparse}
    assert verdicts(spark, none + [("http://h.test/one/1", 1)]) == set()


def test_url_branches_merge_below_the_first_level(spark):
    rows = [(f"http://h.test/shop/c{c}/{k}", 1 if k < 5 else None) for c in range(20) for k in range(8)]
    assert verdicts(spark, rows) == {u for u, _ in rows}
    # among good siblings too, and those stay
    good = [(f"http://h.test/shop/g{c}/{k}", 0) for c in range(10) for k in range(5)]
    assert verdicts(spark, rows + good) == {u for u, _ in rows}
    # equal shapes meet at a level above
    nested = [(f"http://h.test/{a}/c{c}/{k}", 1) for a in ("shop", "sale") for c in range(2) for k in range(3)]
    assert verdicts(spark, nested) == {u for u, _ in nested}


def test_url_segments_are_kept_in_deep_paths(spark):
    bad = [(f"http://h.test/a/b/c/d/e/f/spam/{k}", 1) for k in range(40)]
    good = [(f"http://h.test/a/b/c/d/e/f/good/{k}", 0) for k in range(40)]
    assert verdicts(spark, bad + good) == {u for u, _ in bad}


# exact top-k

def brute_top(rows, is_query, k):
    """Rows are (id, vector); ranks of each query row."""
    out = []
    for i, (q, x) in enumerate(rows):
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), v) for j, (v, y) in enumerate(rows) if j != i)[:k]
            out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scored)]
    return sorted(out)


def test_topk_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ANNULUS", 8)
    monkeypatch.setattr(topk, "PART_ROWS", 100)
    draw = np.random.default_rng(3)
    rows = [(i, [int(x) for x in v]) for i, v in enumerate([*draw.integers(-6, 7, (300, 8)), *[[1] * 8] * 40])]
    rows += [(503, [1] * 7), (504, [9]), (520, [2, 3]), (20, rows[20][1]), (1, [5] * 8), (1, [7] * 8), (40, [3] * 12)]
    lost = [(500, None), (501, []), (502, [1, None] * 4), (None, [1] * 8)]
    frame = spark.createDataFrame([(i, v, 1.0) for i, v in rows + lost], "vec_id long, z array<long>, distance double")
    got = sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 20 == 0, k=7, pivots=9, slice_rows=4).collect())
    assert got == brute_top(rows, lambda q: q % 20 == 0, 7)


def test_topk_scores_are_exact(spark):
    big = [(0, [2_999_999_999, 3]), (1, [3_000_000_000, -1]), (2, [3_000_000_001, 2]), (3, [1 << 40, 1 << 21]), (4, [(1 << 40) + 1, 5])]
    frame = spark.createDataFrame(big, "vec_id long, z array<long>")
    got = sorted(tuple(r) for r in topk.top_k(frame.filter("vec_id < 3"), F.col("vec_id") == 0, k=3).collect())
    assert got == brute_top(big[:3], lambda q: q == 0, 3)
    assert topk.exact(np.array([[1 << 40, 3]]), np.array([[1 << 20, 1 << 55]]), 2.0**63).tolist() == [[(1 << 60) + 3 * (1 << 55)]]
    with pytest.raises(OverflowError):
        topk.exact(np.array([[1 << 40]]), np.array([[1 << 40]]), 2.0**80)


def test_topk_of_more_rows_than_a_batch():
    draw = np.random.default_rng(5)
    z = draw.integers(-3, 4, (10_000, 4))
    best = topk.Best(np.array([-1]), [[1, 2, 3, 1]], 30)
    best.offer(np.array([0]), np.arange(10_000), np.arange(10_000)[::-1].copy(), z, 36.0)
    want = sorted(zip((-(z @ [1, 2, 3, 1])).tolist(), range(9_999, -1, -1), strict=True))[:30]
    assert list(zip((-best.scores[0]).tolist(), best.ids[0].tolist(), strict=True)) == want


def test_topk_skips_far_annuli():
    import pyarrow as pa

    draw = np.random.default_rng(1)
    centres = draw.normal(size=(40, 16)) * 1000
    z = np.rint(centres[draw.integers(0, 40, 8000)] + draw.normal(size=(8000, 16)) * 5).astype(np.int64)
    norms = (z.astype(float) ** 2).sum(axis=1)
    top = float(norms.max()) * (1 + 1e-9)
    pivots = z[:64]
    distance = topk._distances(z.astype(float) @ pivots.T, norms, norms[:64], top)
    at = distance.argmin(axis=1)
    order = np.lexsort((distance[np.arange(8000), at], at))
    block = pa.table({"row": order, "vec_id": order, "z": pa.array(z[order].tolist(), pa.list_(pa.int64())), "pivot": at[order].astype(np.int32), "distance": distance[order, at[order]]})
    queries = (np.arange(0, 8000, 50), np.arange(0, 8000, 50), z[::50].tolist())
    best, to_pivot = topk.seeded(queries, (np.arange(64), pivots.tolist(), pivots.tolist()), 5, top)
    topk.search(best, to_pivot, top, block)
    assert best.scored < 0.5 * 160 * 8000
    for q, (scores, ids) in enumerate(zip(best.scores.tolist(), best.ids.tolist(), strict=True)):
        want = sorted((-int(s), i) for i, s in enumerate(z @ z[50 * q]) if i != 50 * q)[:5]
        assert [(-s, i) for s, i in zip(scores, ids, strict=True)] == want


def test_topk_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, z array<long>")
    assert topk.top_k(empty, F.lit(True)).count() == 0
    assert [r.vec_id for r in topk.top_k(spark.createDataFrame([(0, [1]), (1, [2])], "vec_id long, z array<long>"), F.col("vec_id") == 0).collect()] == [1]


# near duplicates

def edited(text, seed, share):
    draw = random.Random(seed)
    return " ".join(f"edit{seed}x{k}" if draw.random() < share else w for k, w in enumerate(text.split()))


def brute_components(rows, n, num, den):
    sets = {}
    for i, t in rows:
        words = (t or "").encode().translate(minhash.SPACED).split()
        sets[i] = {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
    return {i: (len(sets[i]), root[i]) for i in sets}


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = [(100 + k, prose(k, 80)) for k in range(20)]
    rows += [(200 + k, edited(prose(1, 80), k, 0.03)) for k in range(30)] + [(300 + k, edited(prose(2, 200), k, 0.02 * (k % 5))) for k in range(30)]
    rows += [(400, prose(1, 80)), (401, prose(1, 80)), (1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "one two"), (6, prose(7, 4000))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(made(spark, rows), n=3, num=85, den=100, least=30).collect()}
    assert got == brute_components(rows, 3, 85, 100)


def test_near_duplicates_awkward(spark):
    found = minhash.near_duplicates(made(spark, AWKWARD)).collect()
    assert len(found) == len(AWKWARD)
    assert all(r.kept for r in found)
    assert minhash.near_duplicates(made(spark, [])).count() == 0
    docs = made(spark, [*AWKWARD, (8, prose(5, 3000))])
    stayed = minhash.one_per_group(docs)
    assert stayed.columns == docs.columns
    assert sorted((r.doc_id for r in stayed.collect()), key=str) == sorted([1, 2, 3, 4, None, 5, 6, 7], key=str)


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (5, 5)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 230)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert (got[3], got[10], got[139], got[230], 5 in got) == (1, 8, 100, 200, False)


# packing

@pytest.fixture(scope="module")
def words():
    return tokens.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), 200)


@pytest.mark.parametrize("text", ["It's 12½ o'clock!!", "ÜBER straße\u00a0naïve\u3000x", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "ΣΑΣ İi \u0301e", "中文 mixed_words--and***", "\x1c\x1d a\x85b\u2028c", ""])
def test_word_tokens_are_the_tokenizers(words, text):
    whole = words.whole.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(words.ids(text.encode()), "<u4").tolist() == whole


def test_packing_round_trip(spark, words):
    rows = [*AWKWARD, *((10 + k, prose(k, 40 * (k % 90 + 1))) for k in range(200))]
    docs = made(spark, rows)
    path = public_tokenizers.path("word_bpe_49k.json")
    placed = packing.pack(packing.pieces(docs, path, capacity=256), capacity=256, group=50).collect()
    bins = {}
    for r in placed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in placed)
    assert len(bins) <= 1.03 * -(-total // 256) + 1
    for doc_id, text in rows:
        if doc_id in (4, None):
            continue
        ids = words.whole.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in placed if r.doc_id == doc_id)
        cut = [ids[a : a + 256] for a in range(0, len(ids), 256)]
        assert own == [(k, 256 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]
    assert sum(r.doc_id == 4 for r in placed) == 2
    assert packing.pack(packing.pieces(made(spark, []), path)).count() == 0


def test_best_fit():
    assert packing.best_fit(np.array([6, 5, 4, 5]), 10) == [0, 1, 0, 1]


# decontamination

def brute_hits(text, items, window=10):
    split = lambda t: WORD.findall((t or "").encode().translate(ALNUM))
    words, hit, found = split(text), set(), set()
    for item, t in items:
        own = split(t)
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == own[k : k + n]:
                    hit |= set(range(at, at + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("slice_bytes", [8 << 20, 200])
def test_decontamination_against_brute_force(spark, slice_bytes):
    items = [(1, prose(50, 30)), (2, "short Item"), (3, None), (4, "..."), (5, prose(50, 12)), (10, "é")]
    rows = [*AWKWARD, (20, prose(9, 20) + "\n" + shouted(prose(50, 30)).replace(" ", ", ") + prose(8, 9)), (21, "a SHORT--item, short item item"), (22, prose(50, 11))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = decontaminate.decontaminate(made(spark, rows), bench, slice_bytes=slice_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id)
        assert (r.n_words, r.n_hit, list(r.item_ids)) == brute_hits(text, items)
    twenty = next(r for r in got if r.doc_id == 20)
    text = dict(rows)[20]
    assert any(text[s.start : s.end].startswith(shouted(prose(50, 30).split()[0])) for s in twenty.spans)
    clean = decontaminate.without_contaminated(made(spark, rows), bench, slice_bytes=slice_bytes)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in got if not r.n_hit}
    assert decontaminate.decontaminate(made(spark, rows), bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(made(spark, []), bench).count() == 0


def test_machine_is_bounded_and_cuts_long_items():
    draw = random.Random(2)
    vocabulary = [f"w{k}" for k in range(5000)]
    items = [(str(k), " ".join(draw.choices(vocabulary, k=100)).encode()) for k in range(300)]
    machine = decontaminate.Machine(items, 10)
    stats = machine.trie.get_stats()
    assert stats["nodes_count"] <= 20 * 300 * 100 + 1 and stats["longest_word"] == 20
    # what a slice of full size may take in a worker
    size = sum(len(t) for _, t in items)
    assert stats["total_size"] / size * decontaminate.SLICE_BYTES < 600e6
    long = " ".join(draw.choices(vocabulary, k=500)).encode()
    parts = list(decontaminate._parts(long, 10, 800))
    assert len(parts) > 2
    whole, cut = decontaminate.Machine([("x", long)], 10), decontaminate.Machine([("x", p) for p in parts], 10)
    assert whole.scan(long)[2] == cut.scan(long)[2] == {"x"} and sorted(whole.scan(long)[1]) == sorted(cut.scan(long)[1])
    assert len(whole.sizes) == len(cut.sizes) == 491


# warc

@pytest.mark.parametrize("few", [20_000, 0])
def test_warc_round_trip(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", few)
    monkeypatch.setattr(warc, "FILTER_BITS", 1 << 27 if few else 16)
    rows = [(5, "http://a\r\nb", "<p>é</p>"), (3, "u", "<p>é</p>"), (9, None, None), (10, "v", ""), (11, "w", "x" * 300_000), (12, "w", "y"), (None, "n", "y")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, first string")
    bundles = warc.write_archives(pages.repartition(1), frame_bytes=1000, bundle_bytes=1)
    got = {r.page_id: r for r in warc.read_archives(bundles).collect()}
    assert len(got) == len(rows) and got[None].record_type == "revisit" and got[None].refers_to == 12
    assert (got[5].record_type, got[5].refers_to, got[3].record_type, got[10].refers_to) == ("revisit", 3, "response", 9)
    assert got[5].payload_bytes == len("<p>é</p>".encode()) and got[11].payload_bytes == 300_000
    reader = next(x for x in (warc.BundleReader(b.bundle) for b in bundles.collect()) if any(i[0] == 11 for i in x.index))
    assert reader.record(11)[1] == b"x" * 300_000
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_bundle_is_plain_zstandard(spark):
    import zstandard
    from pyarrow.fs import FileSystem

    pages = spark.createDataFrame([(k, "u", f"page {k}") for k in range(50)], "page_id long, url string, html string").repartition(1)
    uri = warc.write_archives(pages, frame_bytes=500).first().bundle
    fs, path = FileSystem.from_uri(uri)
    data = fs.open_input_file(path).read()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 50


# chat formatting

def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", r"<\s>", r"[\\ROLE]x[PART]", "<s>[ROLE]assistant[/ROLE]", "\\", "", None, "[/PART]</s", "plain é\n"]
    rows = [(k, t, role, text) for k in range(4) for t, (role, text) in enumerate(zip(["system", "user", "user", "assistant", "assistant", "[ROLE]", None, "user", "assistant"], random.Random(k).sample(hard, 9), strict=True))]
    rows += [(7, 1, "assistant", "b"), (7, 1, "assistant", "a"), (7, None, "user", "first"), (7, 1, "assistant", "a"), (None, 0, "user", "x")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, t string")
    read = chat_format.read_back(chat_format.format_conversations(turns))
    back = {r.conv_id: r for r in read.collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert [(t.role, t.text) for t in back[conv].turns] == [(role, text) for _, role, text in own]
        assert "".join(back[conv].loss) == "".join(text for _, role, text in own if role == "assistant")
    assert chat_format.digests(read).count() == len(back)
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


# quality

def test_quality_learns_and_keeps(spark):
    good = [(k, prose(k, 60).capitalize() + ".") for k in range(0, 400)]
    bad = [(k, " ".join(f"{w}$$$" for w in prose(k, 60).split())) for k in range(400, 500)]
    docs = made(spark, [*good, *bad, *((1000 + k, t) for k, (_, t) in enumerate(AWKWARD))])
    labels = spark.createDataFrame([(k, int(k < 400), "x") for k in range(500)] + [(1, None, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    model = quality.fit(docs, labels, most=200)
    got = {r.doc_id: r for r in docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("out"), quality.score(model, F.col("text")).alias("s")).collect()}
    out = [r for k, r in got.items() if k < 500 and r.out]
    assert {k for k in range(500) if zlib.crc32(str(k).encode()) % 4 == 2} == {r.doc_id for r in out}
    assert sum((r.s >= quality.CUT) == (r.doc_id < 400) for r in out) >= 0.97 * len(out)
    assert all(0 <= r.s <= 1 for r in got.values()) and len(got) == 500 + len(AWKWARD)
    none = quality.fit(docs, labels.filter("quality = 1"))
    assert none(b"anything") == pytest.approx(quality.CUT, abs=1e-5) and none(b"anything") >= quality.CUT and none(b"") >= quality.CUT


def test_quality_learns_from_every_labelled_document(spark, monkeypatch):
    """A mark that only documents outside any bounded sample carry is learnt; the threshold is the quantile of all."""
    monkeypatch.setattr(quality, "BLOCK", 512)
    ids = [k for k in range(9600) if zlib.crc32(str(k).encode()) % 4 != 2]
    docs = spark.createDataFrame([(k, f"{'zq zq' if k % 8 == 0 else 'ab cd'} {k}") for k in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 8 > 0)) for k in ids], "doc_id long, quality int")
    single, blocks = quality._labelled(docs, labels, None)
    rows = single.collect()
    assert blocks == -(-len(ids) // 512) and sorted(int(bytes(r.text).split()[-1]) for r in rows if r.own) == ids
    seen = {b: {r.label for r in rows if r.block == b} for b in range(blocks)}
    assert all(held == {0, 1} for held in seen.values()) and max(sum(r.block == b for r in rows) for b in seen) < 2 * 512
    model = quality.fit(docs, labels)
    assert model(b"zq zq 5") < quality.CUT <= model(b"ab cd 5")
    below = docs.filter(quality.score(model, F.col("text")) < quality.CUT).count()
    assert below == sum(k % 8 == 0 for k in ids)


def test_neighbours_are_exact(spark):
    draw = random.Random(3)
    for values in ([1.0], [2.0, 2.0], [draw.choice([0.1, 0.2, 0.3]) for _ in range(50)], [draw.gauss(0, 1) ** 9 for _ in range(300)], [1e300, 1e-300, 5.0]):
        held, order = spark.createDataFrame([(v,) for v in values], "s double"), sorted(values)
        for place in {0, len(values) // 3, len(values) // 2, len(values) - 1}:
            assert quality.neighbours(held, place) == (order[place], order[min(place + 1, len(order) - 1)])


# license scan

def test_license_scan(spark):
    rows = [*AWKWARD, (20, "Apache  LICENSE apache license cc-by CC by cc by"), (21, "x Licensed under the Apach Licence, Version 2.0 y"), (22, "GNU general public licenses"), (23, "the " + "mit license " * 3)]
    got = {r.doc_id: r for r in license_scan.scan_licenses(made(spark, rows)).collect()}
    exact = lambda k: [(p.label, p.first_word) for p in got[k].places if p.exact]
    assert sorted(exact(20)) == [("apache", 0), ("apache", 2), ("cc-by", 4), ("cc-by", 6), ("cc-by", 8)]
    assert exact(21) == [] and [(p.label, p.first_word, p.n_words) for p in got[21].places] == [("apache", 1, 8)]
    assert dict(rows)[21][got[21].places[0].start : got[21].places[0].end] == "Licensed under the Apach Licence, Version 2.0"
    assert exact(22) == [] and [w for _, w in sorted(exact(23))] == [1, 3, 5]
    assert got[5].n_words == 3000 and got[1].n_words == 0
    assert license_scan.scan_licenses(made(spark, [])).count() == 0


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            before, row[j] = row[j], min(before + (a != b), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def brute_notices(normal, words, most):
    starts = [m.end() for m in re.finditer(" ", normal)][:-1]
    ends = [m.start() for m in re.finditer(" ", normal)][1:]
    found = {}
    for a in starts:
        near = [(edits(normal[a:b], words), a, b) for b in ends if a < b and abs(b - a - len(words)) <= most]
        if near and min(near)[0] <= most:
            found[a] = min(near)
    kept = []
    for n, a, b in sorted(found.values()):
        if all(b <= x or y <= a for _, x, y in kept):
            kept.append((n, a, b))
    return sorted((a, n) for n, a, b in kept)


@pytest.mark.parametrize("seed", range(8))
def test_notices_against_brute_force(seed):
    draw = random.Random(seed)
    notices = {"all rights reserved": ("p", 1), "released under the mit license": ("m", 3)}
    finder = license_scan.Finder({}, notices)

    def bent(words, n):
        for _ in range(n):
            k = draw.randrange(len(words))
            words = words[:k] + draw.choice(["", "x", "q" + words[k]]) + words[k + 1 :]
        return words

    text = " " + " ".join(draw.choice([prose(k, draw.randint(0, 3)), bent("all rights reserved", draw.randint(0, 2)), bent("released under the mit license", draw.randint(0, 4))]) for k in range(60)) + " "
    text = re.sub(" +", " ", text)
    for words, (label, most) in notices.items():
        got = sorted((a, n) for x, a, b, n in finder.fuzzy(text) if x == label)
        assert got == brute_notices(text, words, most)


def test_a_better_notice_hides_no_earlier_one():
    finder = license_scan.Finder({}, license_scan.NOTICES)
    assert sorted((a, n) for _, a, _, n in finder.fuzzy(" all rights reservd all rights reserved ")) == [(1, 1), (20, 0)]


def test_repeated_notices_take_linear_time():
    import time

    finder, took = license_scan.Finder({}, license_scan.NOTICES), []
    for n in (2000, 8000):
        began = time.process_time()
        assert len(finder.fuzzy(" " + "all rights reservd " * n)) == n
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_base_licenses_against_sql(spark):
    import duckdb
    import pandas as pd

    rows = [(k, t) for k, t in enumerate([None, "", "Apache License", "mit  license MIT-License", "cc by cc by", "GNU General public LICENSE. cc by é mit license", "x apache licenses", "gnu general public license " * 3])]
    frame = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    want = duckdb.sql(f"""
        with d as (select doc_id, {words} as w from frame), p(phrase, label, n) as (values {", ".join(f"('{k}', '{v}', {len(k.split())})" for k, v in license_scan.PHRASES.items())}),
        hits as (select doc_id, i - 1 as place, label from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d), p where array_to_string(w[i : i + n - 1], ' ') = phrase)
        select doc_id, count(place), min(place), max(place) from d left join hits using (doc_id) group by doc_id order by doc_id""").fetchall()
    got = []
    for r in license_scan.scan_licenses(made(spark, rows)).collect():
        own = [p.first_word for p in r.places if p.exact]
        got.append((r.doc_id, len(own), min(own, default=None), max(own, default=None)))
    assert sorted(got) == want


# suffix arrays

def brute_repeats(texts, least):
    found = {}
    for (i, x), (j, y) in itertools.combinations_with_replacement(enumerate(texts), 2):
        for a in range(len(x)):
            for b in range(len(y)):
                if (i, a) < (j, b) and (a == 0 or b == 0 or x[a - 1] != y[b - 1]):
                    n = 0
                    while a + n < len(x) and b + n < len(y) and x[a + n] == y[b + n]:
                        n += 1
                    if n >= least:
                        found.setdefault(x[a : a + n], set())
    for s in found:
        found[s] = {(i, a) for i, x in enumerate(texts) for a in range(len(x)) if x.startswith(s, a)}
    return found


@pytest.mark.parametrize("seed", range(6))
def test_maximal_repeats_against_brute_force(seed):
    draw = random.Random(seed)
    texts = [bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 60))) for _ in range(5)] + [b"abababababababab", b""]
    got = {}
    for length, numbers, offsets in suffix.maximal_repeats(texts, 9):
        places = set(zip(numbers.tolist(), offsets.tolist(), strict=True))
        k, a = next(iter(places))
        got[texts[k][a : a + length]] = places
    assert got == brute_repeats(texts, 9)


def test_strings_that_stand_for_several_are_repeats():
    groups = lambda texts, counts: sorted((length, sorted(zip(n.tolist(), o.tolist(), strict=True))) for length, n, o in suffix.maximal_repeats(texts, 8, counts))
    assert groups([b"abcdefghij"], [1]) == [] and groups([b"abcdefghij"], [3]) == [(10, [(0, 0)])] and groups([b"short"], [9]) == []
    assert groups([b"abcdefghij", b"xabcdefghijy"], [2, 1]) == [(10, [(0, 0), (1, 1)])]
    assert groups([b"abcdefghij", b"abcdefghzz"], [2, 1]) == [(8, [(0, 0), (1, 0)]), (10, [(0, 0)])]


def brute_kept(texts, least):
    seen = {}
    for t in texts:
        for a in range(len(t) - least + 1):
            seen[t[a : a + least]] = seen.get(t[a : a + least], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - least + 1):
            if seen[t[a : a + least]] > 1:
                gone[a : a + least] = True
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=False) if not g)).hexdigest()))
    return out


def repeated_rows():
    passage, draw = prose(77, 70), random.Random(4)
    rows = [*AWKWARD, (20, "x" * 450), (21, prose(5, 3000)), (22, prose(78, 60)), (23, prose(78, 60)), (23, prose(78, 60)), (24, prose(79, 30) + prose(78, 60) + prose(80, 9))]
    rows += [(30 + k, prose(k, draw.randint(1, 40)) + passage[draw.randint(0, 9) :] + prose(90 + k, draw.randint(0, 40))) for k in range(25)]
    return [*rows, (60, edited(prose(60, 400), 1, 0.02)), (61, edited(prose(60, 400), 2, 0.02))]


@pytest.mark.parametrize("most", [1024, 3])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_IDS", 300_000 if most > 3 else 0)
    rows = repeated_rows()
    docs = made(spark, rows)
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_report(docs).collect())
    assert got == sorted(brute_kept([(t or "").encode() for _, t in rows], 200))
    short = suffix_dedup.without_repeats(docs)
    assert short.columns == docs.columns and short.count() == len(rows)
    assert [r.text for r in short.filter("doc_id in (20, 21, 22, 23)").collect()] == [""] * 5
    assert [r.text for r in short.filter("doc_id = 1").collect()] == [None]
    assert suffix_dedup.removal_report(made(spark, [])).count() == 0
    assert suffix_dedup.without_repeats(made(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_wider_grams_keep_every_window(seed):
    draw = random.Random(seed)
    text = bytes(draw.randint(97, 122) for _ in range(2000))
    own, start, size, gram, _ = suffix_dedup.stretches([text], 200)
    for a, n, g in zip(start.tolist(), size.tolist(), gram.tolist(), strict=True):
        part = text[a : a + n]
        at = suffix_dedup.core_of(part, g, 200)
        todo, windows = [(part, a, at, 64)], []
        while todo:
            t, base, at, core = todo.pop()
            if core == 200:
                assert len(t) == 200
                windows.append(base)
            else:
                todo += [(t[x:y], base + x, place, width) for x, y, place, width in suffix_dedup.widened(t, at, core, 200)]
        assert sorted(windows) == list(range(a, a + n - 199))


def test_repeat_groups_have_all_their_places(spark):
    rows = repeated_rows()
    texts = {}
    for _, t in rows:
        texts.setdefault((t or "").encode(), []).append(t)
    docs = made(spark, rows)
    groups, places = (x.collect() for x in suffix_dedup.repeat_groups(docs))
    text_of = {(r.key, r.tag): (r.text or "").encode() for r in docs.select(*suffix_dedup.text_key(F.coalesce("text", F.lit(""))), "text").collect()}
    where = {}
    for p in places:
        where.setdefault((p.gram, p.whole), []).append((p.key, p.tag, p.start))
    found = {}
    for g in groups:
        own = where[g.gram, g.whole]
        assert len(own) == g.n
        found.setdefault((g.bucket, g.number), []).extend((text_of[k, t][s + g.offset : s + g.offset + g.length], k, t, s + g.offset) for k, t, s in own)
    assert found
    for members in found.values():
        strings = {m[0] for m in members}
        assert len(strings) == 1 and len(next(iter(strings))) >= 200
        string = strings.pop()
        everywhere = sum(len(same) * sum(t.startswith(string, a) for a in range(len(t) - len(string) + 1)) for t, same in texts.items())
        assert len(members) == everywhere >= 2


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 1000)
    texts = [prose(1, 900), "y" + prose(1, 900)[300:], prose(3, 500) + prose(1, 900)[995:1300]]
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_report(made(spark, list(enumerate(texts)))).collect())
    assert got == sorted(brute_kept([t.encode() for t in texts], 200))


def test_workers_keep_nothing_of_other_operators():
    path = public_tokenizers.path("word_bpe_49k.json")
    batch = pa.record_batch({"doc_id": pa.array([1], pa.int64()), "text": pa.array([b"some words"], pa.binary())})
    list(packing._tokenize(path, 2048, False, 1000)([batch]))
    words = shared.kept("packing")[path, 1000]
    list(packing._tokenize(path, 2048, False, 1000)([batch]))
    assert shared.kept("packing")[path, 1000] is words  # from task to task of one operator
    left = weakref.ref(words)
    del words
    list(suffix_dedup._post(200)([]))
    assert left() is None and set(shared._kept) == {"suffix_dedup"}


def test_hashing_stretches_takes_bounded_memory():
    batch = pa.record_batch([pa.array([1], pa.int64()), pa.array([1], pa.int32()), pa.array([random.Random(8).randbytes(2_000_000)], pa.binary())], names=["key", "tag", "text"])
    list(suffix_dedup._post(200)([batch]))  # tables of powers are made once
    tracemalloc.start()
    list(suffix_dedup._post(200)([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20
