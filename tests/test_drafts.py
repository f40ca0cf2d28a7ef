"""Items of a draft: cleaned as the patterns say, and repeats left out without pairs."""

import re
import time

from pyspark.sql import functions as F

from talkframe.functions import text as X
from talkframe.operators import analysis as A


def test_items_are_cleaned_as_the_patterns_say(spark):
    """Items that no pattern can change are let past; the rest come out as the patterns have them."""
    white = "[" + re.escape(X.WHITE_CHARS) + "]"
    odd = ["", " ", "-", "- ", "-x", "- x", "* - x", "-\n\nx", "a\nb", "a \r\n\n\t b\n", "a\rb", "a \n \n\u00a0\u3000b", "\ufeffa\ufeff\nb", "- a \nb", "<a>\n>", "tespit edilmedi.", "TESP\u0130T ED\u0130LMED\u0130.", "- Tespit\nedilmedi.", "Tespit edilmedi", "xxxxxxxxxxxxxxxx"]

    def meant(s):
        s = re.sub(f"^[-*]{white}+", "", s.strip(X.WHITE_CHARS))
        s = re.sub(f"{white}*\r?\n{white}*", " ", s).replace("<", "&lt;").replace(">", "&gt;").strip(X.WHITE_CHARS)
        return None if s in ("", "tespit edilmedi.", "TESPİT EDİLMEDİ.", "Tespit edilmedi.") else s

    rows = spark.createDataFrame(list(enumerate(odd)), "i int, x string").select("i", A.clean_item(F.col("x")).alias("y"))
    assert [r.y for r in rows.orderBy("i").collect()] == [meant(s) for s in odd]
    listed = spark.createDataFrame([(["b", "A", None, "B", "a", "c", "I", "ı"],), ([],), (["x"],)], "xs array<string>")
    assert [r[0] for r in listed.select(A.first_of_each(F.col("xs"))).collect()] == [["b", "A", "c", "I"], [], ["x"]]


def test_a_long_list_of_items_is_not_compared_pair_by_pair(spark):
    """Looking each of 100,000 items up in the list took minutes."""
    items = F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.concat(F.lit("Item "), (i % 99_999).cast("string")))
    began = time.perf_counter()
    got = spark.range(1).select(F.size(A.first_of_each(items))).collect()[0][0]
    assert got == 99_999 and time.perf_counter() - began < 20


def test_a_draft_is_read_by_one_set_of_rules(spark):
    """The rules of an item stand once in the expression, not once a section: late rounds of a job cost their building."""
    built = spark.range(1).select(A.coerce_draft(F.lit('{"decisions": ["- a", "A", "b"], "nextSteps": ["c", 1]}')).alias("d"))
    plan = built._jdf.queryExecution().analyzed().toString()
    assert plan.count("&lt;") == 1
    got = built.first().d.asDict()
    assert got.pop("decisions") == ["a", "b"] and got.pop("nextSteps") == ["c"] and set(map(tuple, got.values())) == {()}
