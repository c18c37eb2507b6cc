"""Reading verses by coordinate, choosing among passages and readings, and checks over several editions.

Verses have corpus, book, chapter, verse and text.  Everything asked comes as a
table, so a thousand lookups are one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACE = ["book", "chapter", "verse"]
RANGE_LIMIT, PASSAGES, NEAR_TIE, SAME_RENDERING = 12, 12, 0.06, 0.03
OPENING, CLOSING = 3, 2


def point(verses: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of ``verses`` at the coordinates asked."""
    return verses.join(asked.select(*PLACE).distinct(), PLACE, "left_semi")


def available(verses: DataFrame, asked: DataFrame) -> DataFrame:
    """pos, coordinates and text of what there is, to be read in the order of ``pos``; what is missing is left out."""
    return asked.select("pos", *PLACE).join(verses.select(*PLACE, "text"), PLACE)


def strict(verses: DataFrame, asked: DataFrame) -> DataFrame:
    """Like :func:`available`, but a coordinate that is missing is an error."""
    found = asked.select("pos", *PLACE).join(verses.select(*PLACE, "text", F.lit(True).alias("there")), PLACE, "left")
    missing = F.raise_error(F.concat(F.lit("no verse "), F.concat_ws(" ", *[F.col(c).cast("string") for c in PLACE])))
    return found.withColumn("there", F.when(F.col("there").isNull(), missing.cast("boolean")).otherwise(F.col("there"))).filter("there").select("pos", *PLACE, "text")


def chapters(verses: DataFrame) -> DataFrame:
    """Every verse with its number ``k`` in its chapter, in reading order."""
    return verses.withColumn("k", F.row_number().over(Window.partitionBy("book", "chapter").orderBy("verse")))


def between(verses: DataFrame, asked: DataFrame) -> DataFrame:
    """id, coordinates and text of verses from ``verse`` to ``end_verse`` of one chapter."""
    spread = asked.filter("verse <= end_verse").select("id", "book", "chapter", F.explode(F.sequence("verse", "end_verse")).alias("verse"))
    return spread.join(verses.select(*PLACE, "text"), PLACE)


def across(verses: DataFrame, asked: DataFrame, limit: int = RANGE_LIMIT) -> DataFrame:
    """The first ``limit`` verses of each range (id, book, chapter, verse to end_chapter, end_verse), across chapters, in reading order."""
    ends = asked.filter(F.struct("chapter", "verse") <= F.struct(F.col("end_chapter").alias("chapter"), F.col("end_verse").alias("verse")))
    spread = ends.withColumn("c", F.explode(F.sequence("chapter", "end_chapter"))).withColumnsRenamed({"chapter": "first_chapter", "verse": "first_verse"})
    joined = spread.join(verses.select("book", F.col("chapter").alias("c"), "verse", "text"), ["book", "c"])
    inside = ((F.col("c") > F.col("first_chapter")) | (F.col("verse") >= F.col("first_verse"))) & ((F.col("c") < F.col("end_chapter")) | (F.col("verse") <= F.col("end_verse")))
    order = Window.partitionBy("id").orderBy("c", "verse")
    return joined.filter(inside).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= limit).select("id", "book", F.col("c").alias("chapter"), "verse", "k", "text")


def book_ends(verses: DataFrame) -> DataFrame:
    """book and its last chapter and verse."""
    return verses.groupBy("book").agg(F.max(F.struct("chapter", "verse")).alias("e")).select("book", F.col("e.chapter").alias("last_chapter"), F.col("e.verse").alias("last_verse"))


def positions(verses: DataFrame, opening: int = OPENING, closing: int = CLOSING) -> DataFrame:
    """Verses at the start of a book's first chapter or at the end of its last: coordinates and position."""
    ends = book_ends(verses)
    starts = verses.groupBy("book").agg(F.min("chapter").alias("first_chapter"))
    joined = verses.join(F.broadcast(ends), "book").join(F.broadcast(starts), "book")
    first = (F.col("chapter") == F.col("first_chapter")) & (F.col("verse") <= opening)
    last = (F.col("chapter") == F.col("last_chapter")) & (F.col("verse") > F.col("last_verse") - closing)
    return joined.withColumn("position", F.when(first, "opening").when(last, "closing")).filter("position is not null").select(*PLACE, "position")


def anachronistic(matches: DataFrame, key: list[str], work: str = "work_year", witness: str = "witness_year") -> DataFrame:
    """Whether all witnesses with a known year are later than the work; false where none has one."""
    return matches.groupBy(*key).agg(F.coalesce(F.bool_and(F.col(witness) > F.col(work)), F.lit(False)).alias("anachronistic"))


def located(hits: DataFrame, places: DataFrame, limit: int = PASSAGES) -> DataFrame:
    """The best passages of each query: hits (id, text_id, score, less is better) as runs of verses with their lowest score.

    ``places`` has text_id and coordinates.
    """
    verses = hits.join(places, "text_id").groupBy("id", *PLACE).agg(F.min("score").alias("score"))
    order = Window.partitionBy("id", "book", "chapter").orderBy("verse")
    runs = verses.withColumn("island", F.col("verse") - F.row_number().over(order)).groupBy("id", "book", "chapter", "island").agg(
        F.min("verse").alias("first"), F.max("verse").alias("last"), F.min("score").alias("score"))
    best = Window.partitionBy("id").orderBy("score", "book", "chapter", "first")
    return runs.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limit).drop("island")


def best_scores(hits: DataFrame, key: list[str], member: str = "verse") -> DataFrame:
    """Lowest score of each group, and its members, sorted."""
    return hits.groupBy(*key).agg(F.min("score").alias("score"), F.array_sort(F.collect_set(member)).alias("members"))


def fullest_span(spans: DataFrame, key: list[str]) -> DataFrame:
    """The span (first, last) with the most verses of each key; of equals the first."""
    best = F.max_by(F.struct("first", "last"), F.struct((F.col("last") - F.col("first")).alias("n"), -F.col("first"))).alias("s")
    return spans.groupBy(*key).agg(best).select(*key, "s.first", "s.last")


def renderings(verses: DataFrame, spans: DataFrame) -> DataFrame:
    """The text of each span (id, book, chapter, first, last) in each corpus, verses in order, and how many it has."""
    spread = spans.select("id", "book", "chapter", F.explode(F.sequence("first", "last")).alias("verse"))
    joined = spread.join(verses, PLACE).groupBy("id", "corpus").agg(F.array_sort(F.collect_list(F.struct("verse", "text"))).alias("v"))
    return joined.select("id", "corpus", F.array_join("v.text", " ").alias("text"), F.size("v").alias("verses"))


def near_best(scored: DataFrame, key: list[str], margin: float) -> DataFrame:
    """Rows whose score is within ``margin`` of their key's best, and whether another one is."""
    near = scored.withColumn("best", F.max("score").over(Window.partitionBy(*key))).filter(F.round(F.col("best") - F.col("score"), 6) <= margin)
    return near.withColumn("tied", F.count("*").over(Window.partitionBy(*key)) > 1)


def one_per_passage(matches: DataFrame, key: list[str]) -> DataFrame:
    """The best match of each passage of a key, whatever system names it."""
    order = Window.partitionBy(*key, "book", "chapter", "verse").orderBy(F.desc("score"), "system")
    return matches.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def reported(matches: DataFrame) -> DataFrame:
    """Figures as they are reported: similarity and coverage with 4 digits, bits with 2, e_value with 6."""
    digits = {"similarity": 4, "coverage": 4, "bits": 2, "e_value": 6}
    return matches.withColumns({c: F.round(c, n) for c, n in digits.items() if c in matches.columns})


def neighbours(verses: DataFrame) -> DataFrame:
    """Each verse with the one after it in the book, across chapters, and the one before."""
    order = Window.partitionBy("corpus", "book").orderBy("chapter", "verse")
    place = F.struct("chapter", "verse")
    return verses.select("corpus", *PLACE, F.lead(place).over(order).alias("n"), F.lag(place).over(order).alias("p")).select(
        "corpus", *PLACE, F.col("n.chapter").alias("next_chapter"), F.col("n.verse").alias("next_verse"), F.col("p.chapter").alias("before_chapter"), F.col("p.verse").alias("before_verse"))


def seeded_sample(rows: DataFrame, key: Column, seed: str, limit: int) -> DataFrame:
    """The first ``limit`` rows in an order that the seed and the key alone decide, with their rank."""
    drawn = rows.withColumn("draw", F.md5(F.concat(F.lit(seed), F.lit(":"), key.cast("string")).cast("binary")))
    best = drawn.orderBy("draw").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("draw"))).drop("draw")


def book_shape(declared: DataFrame, verses: DataFrame) -> DataFrame:
    """Last verse of every chapter: as declared, or else the largest that any edition holds."""
    seen = verses.groupBy("book", "chapter").agg(F.max("verse").alias("seen"))
    joined = declared.select("book", "chapter", F.col("last").alias("told")).join(seen, ["book", "chapter"], "full_outer")
    return joined.select("book", "chapter", F.coalesce("told", "seen").alias("last"), F.col("told").isNotNull().alias("declared"))


def spaced_seeds(left: DataFrame, right: DataFrame, left_key: str, right_key: str, pattern: str) -> DataFrame:
    """Places (i, j) where the tokens agree at every 1 of the pattern, whatever stands at the 0s."""
    ones = [k for k, c in enumerate(pattern) if c == "1"]

    def seeds(rows: DataFrame, key: str, at: str) -> DataFrame:
        words = rows.filter(F.size("t") >= len(pattern)).select(key, "t", F.explode(F.sequence(F.lit(0), F.size("t") - len(pattern))).alias(at))
        return words.select(key, at, F.array(*[F.get("t", F.col(at) + k) for k in ones]).alias("words")).select(key, at, F.xxhash64("words").alias("seed"), "words")

    a, b = seeds(left, left_key, "i"), seeds(right, right_key, "j")
    return a.join(b, ["seed", "words"]).select(left_key, right_key, "i", "j")


def gold_marks(marks: DataFrame, documents: DataFrame, announced: DataFrame) -> DataFrame:
    """Marks with their document's source, and whether a formula announces them."""
    return marks.join(documents, "doc_id").join(announced.select("doc_id", "first").distinct().withColumn("a", F.lit(True)), ["doc_id", "first"], "left").withColumn("announced", F.coalesce("a", F.lit(False))).drop("a")


def window_shards(lengths: DataFrame, key: str, windows: int = 50, window: int = 12, stride: int = 6) -> DataFrame:
    """A text's sweep windows in shards of ``windows``: first window, number of windows, and the words that no earlier shard counts."""
    n = F.greatest(F.lit(1), F.floor((F.col("n") - window) / stride).cast("long") + 1)
    parts = lengths.withColumn("of", n).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / windows).cast("long"))))
    held = F.least(F.lit(windows).cast("long"), F.col("of") - F.col("part") * windows)
    start = F.col("part") * windows * stride
    end = F.when(F.col("part") * windows + held == F.col("of"), F.col("n").cast("long")).otherwise(start + windows * stride)
    return parts.select(key, "part", (F.col("part") * windows).alias("first"), held.alias("windows"), (end - start).alias("words"))


def projected(boundaries: DataFrame, blocks: DataFrame, key: list[str]) -> DataFrame:
    """Boundaries carried over monotone matching blocks (a, b, size): the place of the last block at or before, and how far behind, at most its end.

    ``boundaries`` has key, verse and at; one sort, no range join.
    """
    both = boundaries.select(*key, "verse", F.col("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<a:bigint,b:bigint,size:bigint>").alias("s")).unionByName(
        blocks.select(*key, F.lit(None).cast("bigint").alias("verse"), F.col("a").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), F.col("size").cast("bigint").alias("size")).alias("s")))
    order = Window.partitionBy(*key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("s", F.last("s", ignorenulls=True).over(order)).filter("kind = 1")
    return held.select(*key, "verse", "at", (F.col("s.b") + F.least(F.col("at") - F.col("s.a"), F.col("s.size"))).alias("projected"))


def boundary_recovery(known: DataFrame, derived: DataFrame, key: list[str], near: int = 2) -> DataFrame:
    """Of known boundaries (key, verse, at): how many there are, derived, exact and within ``near`` words."""
    joined = known.join(derived.select(*key, "verse", F.col("projected")), [*key, "verse"], "left")
    off = F.abs(F.col("projected") - F.col("at"))
    return joined.groupBy(*key).agg(F.count("*").alias("known"), F.count("projected").alias("derived"), F.count_if(off == 0).alias("exact"), F.count_if(off <= near).alias("near"))


def membership(offsets: DataFrame, key: list[str], least: float = 0.95) -> DataFrame:
    """Share of a source's verses that stand at offset 0, its commonest other offset, and whether it belongs."""
    drift = offsets.filter("offset <> 0").groupBy(*key, "offset").agg(F.count("*").alias("n"))
    most = drift.groupBy(*key).agg(F.max_by("offset", F.struct("n", -F.col("offset"))).alias("drift"))
    share = offsets.groupBy(*key).agg(F.count("*").alias("verses"), F.round(F.avg((F.col("offset") == 0).cast("double")), 4).alias("share"))
    return share.join(most, key, "left").withColumn("member", F.col("share") >= least)


def ghosts(converted: DataFrame, verses: DataFrame) -> DataFrame:
    """Per book: conversions that are refused, that land on a verse of ``verses``, and that land where it has none."""
    held = verses.select(*[F.col(c).alias(f"t_{c}") for c in PLACE]).distinct().withColumn("there", F.lit(True))
    joined = converted.join(held, [f"t_{c}" for c in PLACE], "left")
    ok = F.col("status") == "ok"
    return joined.groupBy("book").agg(F.count("*").alias("checked"), F.count_if(~ok).alias("refused"), F.count_if(ok & F.col("there").isNotNull()).alias("found"), F.count_if(ok & F.col("there").isNull()).alias("ghosts"))


def best_rival(scored: DataFrame, key: list[str]) -> DataFrame:
    """Each key's own score, and the best of the others with its name: what a judge is shown."""
    rival = F.max_by(F.struct("source", "score"), F.when(~F.col("own"), F.struct("score", "source"))).alias("r")
    return scored.groupBy(*key).agg(F.max(F.when(F.col("own"), F.col("score"))).alias("score"), rival).select(*key, "score", F.col("r.source").alias("rival"), F.col("r.score").alias("rival_score"))


def fallback(asked: DataFrame, editions: DataFrame, held: DataFrame) -> DataFrame:
    """The first edition of the language's chain that holds the verse; ``wanted`` says whether the one asked for does.

    ``asked`` has id, language, wanted and verse; ``editions`` language, source and place; ``held`` source and verse.
    """
    chain = asked.join(F.broadcast(editions), "language").join(held.distinct(), ["source", "verse"])
    place = F.when(F.col("source") == F.col("wanted"), F.lit(-1)).otherwise(F.col("place"))
    first = chain.groupBy("id").agg(F.min_by("source", F.struct(place.alias("p"), "source")).alias("source"))
    told = asked.join(first, "id", "left")
    return told.select("id", "source", F.when(F.col("source").isNull(), "unreadable").when(F.col("source") == F.col("wanted"), "wanted").otherwise("fallback").alias("status"))


def bridging_tier(pairs: DataFrame, tiers: list[tuple[str, object]]) -> DataFrame:
    """The first tier whose folding makes a pair of forms (a, b) equal, or none; ``tiers`` are names and Column functions."""
    tier = F.lit(None).cast("string")
    for name, fold in reversed(tiers):
        tier = F.when(fold(F.col("a")) == fold(F.col("b")), name).otherwise(tier)
    return pairs.withColumn("tier", F.coalesce(tier, F.lit("none")))


def bare_words(rows: DataFrame, forms: list[str], by: list[str]) -> DataFrame:
    """How often each of the forms stands alone in each edition."""
    words = rows.select(*by, F.explode("t").alias("form")).filter(F.col("form").isin(forms))
    return words.groupBy(*by, "form").agg(F.count("*").alias("n"))


def held_out_split(key: Column, share: int = 10, of: int = 3) -> Column:
    """Whether a row is held out: its key's digest modulo ``share`` is below ``of``."""
    digit = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 6), 16, 10).cast("long")
    return digit % share < of


def soft_backoff(unshared: DataFrame, cosines: DataFrame, key: list[str], cap: float) -> DataFrame:
    """Evidence of pairs of words that two passages do not share: twice the bits of the best cosine, at most ``cap``.

    ``unshared`` has key, x, y and bits; ``cosines`` x, y and cosine.
    """
    joined = unshared.join(cosines, ["x", "y"])
    return joined.groupBy(*key).agg(F.max(F.struct("cosine", "bits")).alias("m")).select(*key, F.col("m.cosine").alias("cosine"), F.least(F.lit(cap), 2 * F.col("m.bits") * F.col("m.cosine")).alias("bits"))
