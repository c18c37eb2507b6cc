"""Citations in Markdown: finding tags, marking spans, rendering passages.

Tags are ``{{Luke 2:42 | en=ASV}}``, ``[passage="Luke 2:42" en="ASV"]`` and
fenced ``passage`` blocks of ``key: value`` lines.  Documents are read and
written per row; passages are looked up by a join before rendering.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemmata.functions.text import fold_text

#: Where a tag may begin, and what follows there: name=value, the value quoted or up to a given end.
_OPENING = re.compile(r"\{\{|\[[ \t]*passage[ \t]*=|^```[ \t]*passage[ \t]*\r?\n", re.M)
_VALUE = re.compile(r"""\s*([A-Za-z_][\w.]*)[ \t]*=[ \t]*("[^"]*"|'[^']*'|[^\s"'\]]+)""")
_QUOTED = re.compile(r"""\s*("[^"]*"|'[^']*'|[^\s"'\]]+)""")
_CLOSING_FENCE = re.compile(r"^```[ \t]*$", re.M)
#: Options that a tag may carry; emphasis is ``bold.`` or ``italic.`` and a language.
OPTIONS = {"en", "original", "context", "vrs", "naming", "template"}
_MARKS = {"bold": "**", "italic": "*"}
#: Keys under which a fenced block may name its reference.
REFERENCE_KEYS = ("passage", "reference", "ref")


def _bare(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def _short(text: str, at: int) -> tuple[int, str, dict[str, str], str | None] | None:
    """End, reference, options and error of what stands behind two braces: segments between bars."""
    end = text.find("}}", at)
    body = text[at:end]
    if end < 0 or "{" in body or "}" in body or "\n" in body:
        return None
    reference, *rest = (segment.strip() for segment in body.split("|"))
    pairs = [segment.partition("=") for segment in rest if segment]
    bad = next((f"unread option {name}" for name, equals, _ in pairs if not equals), None)
    return end + 2, reference, {name.strip().lower(): _bare(value) for name, equals, value in pairs if equals}, bad


def _attributes(text: str, at: int) -> tuple[int, str, dict[str, str], str | None] | None:
    """The same behind an opening bracket: a quoted reference, then name=value up to the closing bracket."""
    reference = _QUOTED.match(text, at)
    options: dict[str, str] = {}
    at = reference.end() if reference else at
    while pair := _VALUE.match(text, at):
        options[pair[1].lower()] = _bare(pair[2])
        at = pair.end()
    while at < len(text) and text[at].isspace():
        at += 1
    return (at + 1, _bare(reference[1]) if reference else "", options, None) if text[at : at + 1] == "]" else None


def _fenced(text: str, at: int) -> tuple[int, str, dict[str, str], str | None] | None:
    """The same behind an opening fence: lines of ``key: value`` up to a closing one."""
    closing = _CLOSING_FENCE.search(text, at)
    if not closing:
        return None
    lines = (line.partition(":") for line in text[at : closing.start()].splitlines())
    held = {key.strip().lower(): _bare(value) for key, _, value in lines if value.strip()}
    names = [held.pop(k) for k in REFERENCE_KEYS if k in held]
    return closing.end(), names[0] if names else "", held, None


def citations(text: str) -> list[dict]:
    """Tags in order of place: reference, options, start, end, inline, and error where an option is unknown or unread; no tag is sought within another."""
    out, at = [], 0
    while opening := _OPENING.search(text, at):
        mark = opening[0][0]
        made = {"{": _short, "[": _attributes, "`": _fenced}[mark](text, opening.end())
        if made is None:
            at = opening.start() + 1
            continue
        at, reference, options, error = made
        unknown = sorted(k for k in options if k not in OPTIONS and k.partition(".")[0] not in _MARKS)
        error = "no reference" if not reference else error or (f"unknown option {unknown[0]}" if unknown else None)
        out.append({"reference": reference, "options": options, "start": opening.start(), "end": at, "inline": mark == "{", "error": error})
    return out


def _folded_places(text: str) -> tuple[str, list[int]]:
    """The normal form letter by letter, and the place in ``text`` that each letter came from."""
    letters, places = [], []
    for k, c in enumerate(text):
        plain = " " if c.isspace() else fold_text(c)
        if plain == " " and (not letters or letters[-1] == " "):
            continue
        letters += plain
        places += [k] * len(plain)
    return "".join(letters), places


def mark_spans(text: str, spans: list[tuple[str, str]]) -> str:
    """Put marks around spans given as (``first words .. last words``, style).

    Anchors are matched in the normal form.  One that is not there, or spans that
    overlap, are errors.  Every place of the text gets the mark of the span it lies
    in, and one pass writes a mark wherever that changes.
    """
    folded, places = _folded_places(text)
    inside = [0] * (len(text) + 1)  # number of the span that holds a place, 0 for none
    for number, (span, _) in enumerate(spans, 1):
        head, _, tail = (fold_text(part) for part in span.partition(".."))
        opening = folded.find(head) if head else -1
        closing = folded.find(tail or head, opening) if opening >= 0 else -1
        if closing < 0 or (".." in span and not tail):
            raise ValueError(f"span not found: {span}")
        held = range(places[opening], places[closing + len(tail or head) - 1] + 1)
        if any(inside[k] for k in held):
            raise ValueError("spans overlap")
        for k in held:
            inside[k] = number
    out, now = [], 0
    for k, c in enumerate(text):
        number = inside[k]
        if now and not number and not c.isspace() and not fold_text(c):
            number = now  # marks that combine with the letter before them
        if number != now:
            out += [_MARKS[spans[n - 1][1]] for n in (now, number) if n]
            now = number
        out.append(c)
    return "".join([*out, _MARKS[spans[now - 1][1]] if now else ""])


def tags(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per tag: key, n, reference, options, start, end, inline, error."""
    kind = T.ArrayType(T.StructType([
        T.StructField("reference", T.StringType()), T.StructField("options", T.MapType(T.StringType(), T.StringType())), T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()), T.StructField("inline", T.BooleanType()), T.StructField("error", T.StringType())]))

    @F.pandas_udf(kind)
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([citations(t or "") for t in texts])

    return docs.select(key, F.posexplode(read(F.col(text))).alias("n", "tag")).select(key, "n", "tag.*")


def render(docs: DataFrame, found: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with each tag replaced by its passage (reference, body, label), or left with a warning where there is none.

    ``found`` is of :func:`tags`; one document's tags are gathered, which its own
    length bounds.
    """
    joined = found.join(passages, "reference", "left")
    marked = F.concat(F.lit("*"), "reference", F.lit(" — not found*"))
    inline = F.concat(F.lit("“"), "body", F.lit("” ("), "reference", F.lit(")"))
    block = F.concat(F.lit("> "), F.regexp_replace("body", "\n", "\n> "), F.lit("\n>\n> — "), "reference", F.coalesce(F.concat(F.lit(", "), "label"), F.lit("")))
    body = F.when(F.col("error").isNotNull() | F.col("body").isNull(), marked).when(F.col("inline"), inline).otherwise(block)
    pieces = joined.withColumn("out", body).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "out"))).alias("p"), F.count_if(F.col("body").isNull()).alias("missing"))
    whole = docs.select(key, text).join(pieces, key, "left")
    n = F.size("p")
    start = lambda i: F.when(i == 0, 0).otherwise(F.get("p", i - 1)["end"])
    parts = F.transform("p", lambda p, i: F.concat(F.substr(F.col(text), start(i) + 1, p["start"] - start(i)), p["out"]))
    tail = F.substr(F.col(text), F.get("p", n - 1)["end"] + 1, F.length(text))
    return whole.select(key, F.coalesce(F.concat(F.array_join(parts, ""), tail), text).alias("rendered"), F.coalesce("missing", F.lit(0)).alias("missing"))
