"""Corrections from a table of misspelt words, and labels found without pairing items with all of them.

A text meets only the entries whose first word it holds: distinct first words are joined with the
table's, and what is found travels to the text as a short list. The longest entry at a place is
then replaced inside the row, in one pass. Rows follow the words of the texts, not texts times entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.functions import text as X

_EDGE_BEFORE, _EDGE_AFTER = r"(?iu)(?<![\p{L}\p{N}])(?:", r")(?![\p{L}\p{N}])"
_NO_WORD = r"[^\p{L}\p{N}]+"


def _folded(c: Column) -> Column:
    """One form for all letters that a search without case takes as equal: i, ı, I and İ are."""
    return F.lower(F.translate(c, "Iİı", "iii"))


def _first_word(c: Column) -> Column:
    return F.get(F.array_remove(F.split(_folded(c), _NO_WORD), ""), F.lit(0))


def entries(dictionary: DataFrame) -> DataFrame:
    """``(key, word, first)`` of a table ``(key, word)``; of equal keys the smallest word counts, a key without letters and digits none."""
    rows = dictionary.where(F.col("word").isNotNull()).groupBy(X.lower_tr(F.col("key")).alias("key")).agg(F.min("word").alias("word"))
    return rows.withColumn("first", _first_word(F.col("key"))).where(F.col("first").isNotNull())


def correct_texts(texts: DataFrame, dictionary: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """``texts`` with whole misspelt words of ``dictionary(key, word)`` replaced, keeping an initial capital; longer keys win.

    ``keys`` name a text. A key may hold several words. A null text stays null, and texts that share
    their keys are each corrected; a written word is not looked at again.
    """
    listed = entries(dictionary)
    words = F.array_distinct(F.array_remove(F.split(_folded(F.col(column)), _NO_WORD), ""))
    asked = texts.where(F.col(column).isNotNull()).select(*keys, F.explode(words).alias("first"))
    found = asked.join(listed, "first").groupBy(*keys).agg(F.collect_set(F.struct("key", "word")).alias("_e"))
    renamed = found.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.array_sort("_e", lambda a, b: F.coalesce(F.nullif(F.length(b["key"]) - F.length(a["key"]), F.lit(0)), F.when(a["key"] < b["key"], -1).otherwise(1))).alias("_e"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = texts.join(renamed, same, "left")
    pattern = F.concat(F.lit(_EDGE_BEFORE), F.array_join(F.transform("_e", lambda e: X.quote_pattern(e["key"])), "|"), F.lit(_EDGE_AFTER))
    right = F.map_from_entries(F.transform("_e", lambda e: F.struct(_folded(e["key"]), e["word"])))
    exact = F.map_from_entries(F.transform("_e", lambda e: F.struct(e["key"], e["word"])))

    def corrected(hit: Column) -> Column:
        word = F.coalesce(F.try_element_at(exact, X.lower_tr(hit)), F.try_element_at(right, _folded(hit)))
        first = F.substring(hit, 1, 1)
        upper = F.upper(F.translate(F.substring(word, 1, 1), "ıi", "Iİ"))
        capital = F.concat(upper, F.substring(word, F.lit(2), F.length(word)))
        return F.coalesce(F.when(first != X.lower_tr(first), capital).otherwise(word), hit)

    done = F.when(F.col("_e").isNull(), F.col(column)).otherwise(X.replace_hits(F.col(column), pattern, corrected))
    return joined.withColumn(column, done).select(*texts.columns)
