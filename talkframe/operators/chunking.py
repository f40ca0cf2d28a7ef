"""Cutting long texts into overlapping chunks that fit a token budget.

A text is one row, and cutting it depends on nothing else, so all of this is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.functions import text as X

# Where a text is cut, coarsest first. A speaker label stays with what follows it,
# any other mark with what precedes it.
CUTS = [r"(?<=\n\n)", r"(?=\nSPEAKER_)", r"(?<=\n)", r"(?<=\. )", r"(?<= )"]


def _tokens(c: Column, chars_per_token: float) -> Column:
    return X.token_estimate(c, chars_per_token)


def pieces(text: Column, max_tokens: int, chars_per_token: float = 3.5) -> Column:
    """Pieces within the budget: what is too long is cut at the next finer place, at last by length."""
    return X.let(X.strip(text), lambda whole: _pieces(whole, max_tokens, chars_per_token))


def _pieces(whole: Column, max_tokens: int, chars_per_token: float) -> Column:
    parts_of_one = lambda p: F.filter(F.array(p), lambda q: q != "")
    parts = parts_of_one(whole)
    fits = lambda p: _tokens(p, chars_per_token) <= max_tokens
    for cut in CUTS:
        finer = lambda p, cut=cut: F.filter(F.transform(F.split(p, cut), X.strip), lambda q: q != "")
        parts = F.flatten(F.transform(parts, lambda p: F.when(fits(p), F.array(p)).otherwise(finer(p))))
    width = max(1, int(max_tokens * chars_per_token))
    by_length = lambda p: F.filter(
        F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / width)), lambda i: X.strip(F.substring(p, i * width + 1, F.lit(width)))),
        lambda q: q != "",
    )
    cut_up = F.flatten(F.transform(parts, lambda p: F.when(fits(p), F.array(p)).otherwise(by_length(p))))
    return F.when(fits(whole), parts_of_one(whole)).otherwise(cut_up)


def pack(parts: Column, max_tokens: int, chars_per_token: float = 3.5) -> Column:
    """Join neighbours while they fit. A chunk of one piece keeps its white space, a joined one is squeezed."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("raw"), F.lit("").alias("flat"))
    ready = F.transform(parts, lambda p: F.struct(p.alias("raw"), X.squeeze(p).alias("flat")))

    def step(acc: Column, p: Column) -> Column:
        joined = F.concat(acc["flat"], F.lit(" "), p["flat"])
        length = F.length(acc["flat"]) + 1 + F.length(p["flat"])
        opened = F.struct(acc["done"].alias("done"), p["raw"].alias("raw"), p["flat"].alias("flat"))
        grown = F.struct(acc["done"].alias("done"), joined.alias("raw"), joined.alias("flat"))
        closed = F.struct(F.concat(acc["done"], F.array(acc["raw"])).alias("done"), p["raw"].alias("raw"), p["flat"].alias("flat"))
        return F.when(acc["raw"] == "", opened).when(F.ceil(length / float(chars_per_token)) <= max_tokens, grown).otherwise(closed)

    finish = lambda acc: F.when(acc["raw"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["raw"])))
    return F.aggregate(ready, start, step, finish)


def _tail(chunk: Column, overlap_tokens: int, chars_per_token: float) -> Column:
    """Last sentences of a chunk, as many as it takes to reach the overlap."""
    sentences = F.reverse(F.filter(F.split(chunk, rf"(?<=[.!?]){X.SPACE}+"), lambda s: s != ""))
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.lit(0).cast("bigint").alias("tokens"))
    step = lambda acc, s: F.when(acc["tokens"] >= overlap_tokens, acc).otherwise(
        F.struct(F.concat(F.array(s), acc["taken"]).alias("taken"), (acc["tokens"] + _tokens(s, chars_per_token)).alias("tokens"))
    )
    return X.strip(F.aggregate(sentences, start, step, lambda acc: F.array_join(acc["taken"], " ")))


def overlapped(chunks: Column, overlap_tokens: int, chars_per_token: float = 3.5) -> Column:
    """Start every chunk with the tail of the one before it, unless it starts with it anyway."""
    if overlap_tokens <= 0:
        return chunks

    def step(acc: Column, c: Column) -> Column:
        opened = lambda tail: F.when((tail == "") | F.startswith(c, tail), c).otherwise(X.squeeze(F.concat(tail, F.lit(" "), c)))
        return F.concat(acc, F.array(X.let(_tail(F.element_at(acc, -1), overlap_tokens, chars_per_token), opened)))

    folded = lambda cs: F.aggregate(F.slice(cs, F.lit(2), F.size(cs)), F.slice(cs, 1, 1), step)
    return X.let(chunks, lambda cs: F.when(F.size(cs) > 1, folded(cs)).otherwise(cs))


def chunk_array(text: Column, max_tokens: int, overlap_tokens: int, chars_per_token: float = 3.5) -> Column:
    packed = pack(pieces(text, max_tokens, chars_per_token), max_tokens, chars_per_token)
    return overlapped(packed, overlap_tokens, chars_per_token)


def chunk_rows(docs: DataFrame, max_tokens: int, overlap_tokens: int, chars_per_token: float = 3.5, text: str = "text") -> DataFrame:
    """One row per chunk: the other columns, ``chunk_idx``, ``n_chunks`` and ``chunk``."""
    others = [c for c in docs.columns if c != text]
    cut_up = docs.select(*others, chunk_array(F.col(text), max_tokens, overlap_tokens, chars_per_token).alias("_c"))
    # The outer form keeps Spark from testing the array for emptiness, which would cut every text again.
    each = cut_up.select(*others, F.size("_c").alias("n_chunks"), F.posexplode_outer("_c").alias("chunk_idx", "chunk"))
    return each.filter(F.col("chunk").isNotNull())
