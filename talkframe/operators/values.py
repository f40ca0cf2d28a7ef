"""Detected values: what a draft claims, kept where the transcript bears it out.

A draft's list of items and a transcript are values of one row, so all of this is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.functions import text as X
from talkframe.functions.entities import value_anchors

MOST_VALUE_WORDS, MOST_LABEL_WORDS, MOST_BARE_WORDS, MOST_VALUES = 6, 5, 3, 24


def parse_item(item: Column) -> Column:
    """``label: value`` as ``(label, value_line, text)``; null where it reads as prose."""
    def split_at(text: Column, colon: Column) -> Column:
        label = F.when(colon > 1, X.strip(F.substring(text, F.lit(1), colon - 1)))
        value = F.when(colon > 1, X.strip(F.substring(text, colon + 1, F.length(text)))).otherwise(text)
        return F.struct(label.alias("label"), value.alias("value"), text.alias("text"))

    def lines(p: Column) -> Column:
        # An empty label is no label.
        return F.struct(X.match_form(F.nullif(p["label"], F.lit(""))).alias("label"), X.match_form(p["value"]).alias("value_line"), p["text"].alias("text"))

    def checked(p: Column) -> Column:
        label, value_line = p["label"], p["value_line"]
        count = F.size(X.split_words(value_line))
        fit = F.when(label.isNull(), count <= MOST_BARE_WORDS).otherwise(
            (count <= MOST_VALUE_WORDS) & (F.size(X.split_words(label)) <= MOST_LABEL_WORDS) & (label != value_line)
        )
        return F.when((value_line != "") & fit, p)

    parts = X.let(X.strip(item), lambda text: X.let(F.instr(text, ":"), lambda colon: split_at(text, colon)))
    return X.let(X.let(parts, lines), checked)


def item_words(p: Column) -> Column:
    """Words of an item. A colon parts words, so its label and its value have them; but not so lower case, in which a last sigma differs."""
    line = F.when(F.contains(p["text"], F.lit("Σ")), X.match_form(p["text"])).otherwise(F.trim(F.concat_ws(" ", p["label"], p["value_line"])))
    return X.split_words(line)


def stands_in(hay: Column, value_line: Column) -> Column:
    """Whether the words of a value stand side by side in ``hay``, a match form between spaces.

    Only the last word may run on, and only with a letter.
    """
    return F.contains(hay, F.concat(F.lit(" "), value_line, F.lit(" "))) | (
        F.contains(hay, F.concat(F.lit(" "), value_line))
        & F.regexp_like(hay, F.concat(F.lit(" "), X.quote_pattern(value_line), F.lit(r"\p{L}[^ ]* ")))
    )


def _suffix_of(long: Column, short: Column) -> Column:
    rest = F.substring(long, F.length(short) + 1, F.length(long))
    return F.startswith(long, short) & F.regexp_like(rest, F.lit(r"^\p{L}"))


def words_match(a: Column, b: Column) -> Column:
    return (a == b) | _suffix_of(a, b) | _suffix_of(b, a)


def covers(words: Column, anchor: Column) -> Column:
    """Whether every word of an anchor matches some word of an item, endings aside."""
    return (anchor["line"] != "") & F.forall(anchor["words"], lambda a: F.exists(words, lambda t: words_match(t, a)))


def merge_values(items: Column, anchors: Column, hay: Column) -> Column:
    """Items the transcript bears out, then anchors none of them covers; 24 at most.

    ``hay`` is the transcript's match form. Of items with one label the last wins its place, but
    all of them cover anchors, so that a corrected value does not come back.
    """
    parsed = F.filter(F.transform(items, parse_item), lambda p: p.isNotNull())
    lined = F.transform(anchors, lambda a: F.struct(a.alias("text"), X.match_form(a).alias("line")))
    worded = F.transform(lined, lambda a: F.struct(a["text"].alias("text"), a["line"].alias("line"), X.split_words(a["line"]).alias("words")))

    def merged(grounded: Column) -> Column:
        labels = F.transform(grounded, lambda p: p["label"])
        last = X.let(
            labels,
            lambda ls: F.filter(
                grounded, lambda p, i: p["label"].isNull() | ~F.array_contains(F.slice(ls, i + 2, F.size(ls)), F.coalesce(p["label"], F.lit("")))
            ),
        )
        kept = F.slice(F.transform(last, lambda p: p["text"]), 1, MOST_VALUES)
        missed = X.let(F.transform(grounded, item_words), lambda of: F.filter(worded, lambda a: ~F.exists(of, lambda words: covers(words, a))))
        return F.slice(F.concat(kept, F.transform(missed, lambda a: a["text"])), 1, MOST_VALUES)

    spaced = F.concat(F.lit(" "), hay, F.lit(" "))
    return X.let(X.let(spaced, lambda h: F.filter(parsed, lambda p: stands_in(h, p["value_line"]))), merged)


def detect_values(drafts: DataFrame, items: str = "items", text: str = "text") -> DataFrame:
    """Adds ``detected`` to rows with a transcript and a draft's claimed items."""
    ready = drafts.withColumn("_hay", X.match_form(F.col(text))).withColumn("_anchors", value_anchors(F.col(text)))
    return ready.withColumn("detected", merge_values(F.col(items), F.col("_anchors"), F.col("_hay"))).drop("_hay", "_anchors")
