"""URL filter: rules first, then a tree of path templates per host.

Rules are (verdict, "host/path prefix"); the longest that fits decides.  All
other urls are judged by templates.  Paths are cut into segments; a segment that
looks like an identifier becomes ``*`` at once, and level by level a node's
children become ``*`` together when there are so many that none matters.  Then,
from the deepest level up, branches of one node whose subtrees have the same
shape are merged unless a two-proportion test tells a branch's share of bad among
labelled urls from that of the branches beside it.  Paths are kept to their last
segment; each level is one aggregated pass, so passes grow with the longest path.
A merged template is rejected when its smoothed share of bad among labelled urls
is at least ``reject``, whatever share of its urls is labelled; a branch without
labels is told apart from none.  Labels are the rules' own verdicts, or the
expression ``label`` over ``pages`` (0 good, 1 bad, anything else unlabelled).

Everything is counted on (host, template) groups with partial aggregation, so a
host that holds a third of all urls is a few rows after the first shuffle.

Defined cases: a null url or one without ``://`` has empty host and path and is
judged by the method; the empty host fits no rule; null and repeated page_ids are
judged row by row; urls of any length are read whole; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemmata.llm.shared import BROADCAST_ROWS, cut

_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Segments taken as identifiers: numbers with or without an ending, dates, long hexadecimal strings, uuids.
_IDENTIFIER = r"^(\d[\d._-]*(\.[a-zA-Z]{1,5})?|[0-9a-fA-F]{8,}|[0-9a-fA-F-]{36})$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and the path up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), *_AZ)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule string that fits, and its verdict; nulls where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0]))

    def fits(rule: str) -> Column:
        own_host, slash, prefix = rule.partition("/")
        return ((host == own_host) | F.endswith(host, F.lit(f".{own_host}"))) & F.startswith(path, F.lit(slash + prefix))

    pick = lambda k: F.coalesce(*[F.when(fits(r[1]), r[k]) for r in ordered]) if ordered else F.lit(None).cast("string")
    return pick(1), pick(0)


def _segments(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(F.rlike(s, F.lit(_IDENTIFIER)), "*").otherwise(s))


def templates(urls: DataFrame, wide: int = 32, least_share: float = 0.2) -> DataFrame:
    """host, raw (segments), template (segments), n, labelled, bad per distinct (host, raw).

    ``urls`` has host, raw and bad.  A node with more than ``wide`` different
    children, none of which holds ``least_share`` of it, is generalised.
    """
    counts = F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
    known = urls.groupBy("host", "raw").agg(*counts).withColumn("template", F.array().cast("array<string>"))
    known = cut(known)
    deepest = known.agg(F.coalesce(F.max(F.size("raw")), F.lit(0))).first()[0]
    for level in range(deepest):
        seg = F.get("raw", F.lit(level))
        children = known.filter(seg.isNotNull()).groupBy("host", "template", seg.alias("seg")).agg(F.sum("n").alias("n"))
        nodes = children.groupBy("host", "template").agg((F.count("*") > wide).alias("many"), (F.max("n") < least_share * F.sum("n")).alias("even"))
        generalised = nodes.filter("many and even").select("host", "template", F.lit(True).alias("any"))
        known = known.join(generalised, ["host", "template"], "left").withColumn(
            "template", F.when(seg.isNull(), F.col("template")).otherwise(F.concat("template", F.array(F.when(F.col("any"), F.lit("*")).otherwise(seg)))))
        known = cut(known.drop("any"))  # each level reads the one before twice, so its plan must not carry all of them
    return known


def _apart(z: float) -> Column:
    """Whether ``bad`` of ``labelled`` and the rest of ``all_bad`` of ``all_labelled`` differ by a two-proportion test; never without labels on both sides."""
    rest = F.col("all_labelled") - F.col("labelled")
    gap = F.abs(F.try_divide("bad", "labelled") - F.try_divide(F.col("all_bad") - F.col("bad"), rest))
    pooled = F.try_divide("all_bad", "all_labelled")
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), "labelled") + F.try_divide(F.lit(1), rest)))
    return F.coalesce(gap > z * error + 1e-12, F.lit(False))


def merged(known: DataFrame, z: float = 1.96) -> DataFrame:
    """host, template, labelled, bad and ``merged``: the template with the marks of merged branches, from the deepest level up.

    Branches of a node are those that differ in one segment, deeper segments being
    merged already.  Those that are not told apart from all others are marked ``/=``;
    the rest is pooled above and below the common share, and who is not told apart
    from the others there is marked ``/+`` or ``/-`` (no segment holds a slash).
    """
    counts = F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")
    every = F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad")
    kinds = cut(known.groupBy("host", "template").agg(*counts).withColumn("merged", F.col("template")))
    deepest = kinds.agg(F.coalesce(F.max(F.size("merged")), F.lit(0))).first()[0]
    for level in reversed(range(deepest)):
        seg = F.get("merged", F.lit(level))
        around = F.transform("merged", lambda s, i: F.when(i == level, F.lit("")).otherwise(s))  # noqa: B023
        placed = kinds.withColumn("around", F.when(seg.isNotNull(), around)).withColumn("seg", seg)
        branches = placed.filter("seg is not null").groupBy("host", "around", "seg").agg(*counts)
        side = F.when(~_apart(z), "/=").when(F.col("bad") * F.col("all_labelled") > F.col("all_bad") * F.col("labelled"), "/+").otherwise("/-")
        sided = branches.join(branches.groupBy("host", "around").agg(*every), ["host", "around"]).withColumn("side", side).drop("all_labelled", "all_bad")
        pooled = sided.join(sided.groupBy("host", "around", "side").agg(*every), ["host", "around", "side"])
        marks = pooled.select("host", "around", "seg", F.when((F.col("side") != "/=") & _apart(z), F.col("seg")).otherwise(F.col("side")).alias("mark"))
        own = F.transform("merged", lambda s, i: F.when(i == level, F.col("mark")).otherwise(s))  # noqa: B023
        kinds = placed.join(marks, ["host", "around", "seg"], "left").withColumn("merged", F.when(F.col("mark").isNull(), F.col("merged")).otherwise(own))
        kinds = cut(kinds.select("host", "template", "labelled", "bad", "merged"))
    return kinds


def rejected(known: DataFrame, reject: float = 0.9, alpha: float = 1.0, beta: float = 1.0, z: float = 1.96) -> DataFrame:
    """Distinct (host, raw) under a template whose merged group is rejected, with the group's smoothed purity."""
    kinds = merged(known, z)
    purity = (F.col("bad") + alpha) / (F.col("labelled") + alpha + beta)
    scored = kinds.groupBy("host", "merged").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    bad_groups = scored.filter(purity >= reject).select("host", "merged", purity.alias("purity"))
    bad_templates = kinds.join(bad_groups, ["host", "merged"]).select("host", "template", "purity")
    return known.join(bad_templates, ["host", "template"]).select("host", "raw", "template", "purity")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], reject: float = 0.9, label: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity (both null unless a template rejects) per row of ``pages``."""
    host, path = host_and_path(F.col("url"))
    said = F.lit(None).cast("long") if label is None else F.try_to_number(label.cast("string"), F.lit("9")).cast("long")
    parsed = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"), F.when(said.isin(0, 1), said).alias("bad"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumn("rule", rule).withColumn("rule_verdict", verdict).withColumn("raw", _segments(F.col("path")))
    learnt = F.col("bad") if label is not None else F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0).cast("long")
    dropped = cut(rejected(templates(judged.select("host", "raw", learnt.alias("bad"))), reject))
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    verdicts = F.coalesce("rule_verdict", F.when(F.col("purity").isNotNull(), "block").otherwise("allow"))
    return judged.join(dropped, ["host", "raw"], "left").select(
        "page_id", "host", "path", "rule", verdicts.alias("verdict"), F.concat_ws("/", "template").alias("template"), "purity"
    )
