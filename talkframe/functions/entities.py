"""Values named in a text: percentages, amounts, quantities, codes, dates, weekdays."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkframe.functions import text as X

# Words, units, months, weekdays and endings the patterns are made of.
NUMBER_WORD = "(?:sıfır|bir|iki|üç|dört|beş|altı|yedi|sekiz|dokuz|on|yirmi|otuz|kırk|elli|altmış|yetmiş|seksen|doksan|yüz|bin|milyon)"
MONTH = "(?:ocak|şubat|mart|nisan|mayıs|haziran|temmuz|ağustos|eylül|ekim|kasım|aralık)"
WEEKDAY = "(?:pazartesi|cumartesi|çarşamba|perşembe|pazar|salı|cuma)"
UNIT = (
    "(?:milyar|milyon|metrekare|metre|kilogram|kilo|vardiya|dakika|çalışan|hafta|palet|kalem|adet|puan|saat|hane|koli|kişi|ton|bin|gün|yıl|kg|ay)"
)
ENDING = (
    "(?:(?:ından|inden|undan|ünden|ında|inde|unda|ünde|lerin|ların|ndan|nden|lere|lara|leri|ları|den|dan|ler|lar|lik|lık|luk|lük|"
    r"nin|nın|nun|nün|nda|nde|si|sı|su|sü|li|lı|lu|lü|ne|na|ye|ya|de|da|e|a|i|ı|u|ü)(?!\p{L}))?"
)
CURRENCY = r"(?:TL|₺|EUR|€|USD|\$|euro|dolar|lira)"
NAMED_CURRENCY = "(?:TL|EUR|USD|euro|dolar|lira)"
OPEN, CLOSE = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
# A word edge that knows ASCII letters only, as the patterns mean it; without case these are four more.
LETTER, CASED_LETTER = "[A-Za-z0-9_ıİſ\u212a]", "[A-Za-z0-9_]"
EDGE, CASED_EDGE = (f"(?:(?<!{c})(?={c})|(?<={c})(?!{c}))" for c in (LETTER, CASED_LETTER))
S = X.SPACE

# Only words are searched without case: digits and white space have none, and looking for their cases is slow. What can end in one
# way only gives nothing back. A currency's first letter is looked at before the list of them.
COUNT = rf"[0-9]++(?:[.,][0-9]++)?+{S}++"
COIN = rf"(?=[TEUDLteudl₺€$])(?iu:{CURRENCY}){EDGE}"
AMOUNT = rf"(?:[0-9]{{1,3}}+(?:[.{X.WHITE}][0-9]{{3}})*+|[0-9]++)(?:,[0-9]++)?+{S}*+{COIN}"

# What counts as a value and holds digits, by where a run of digits begins, inside one, or before it. From one place at most one
# matches further than all others, and it comes first here. Inside a run only an amount can begin that the run's own does not end with: one of groups of three.
NUMBERS = [
    rf"(?<![0-9])(?=[0-9])(?:{AMOUNT}"
    rf"|(?<!{LETTER})(?:{COUNT}(?:(?iu:bin|milyon){S}++{COIN}|(?iu:{UNIT}{ENDING}){CLOSE})|[0-9]{{1,2}}+{S}++(?iu:{MONTH})(?:{S}+[0-9]{{4}})?{EDGE})"
    rf"|(?<!{CASED_LETTER})[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{CASED_EDGE})",
    rf"(?<=[0-9])(?=[0-9]{{1,3}}+[.{X.WHITE}][0-9]{{3}}){AMOUNT}",
    rf"%{S}*+[0-9]++(?:[.,][0-9]++)?+",
    rf"{OPEN}[A-ZÇĞIİÖŞÜ]{{2,5}}-?[0-9]{{3,8}}{CLOSE}",
]
SHORT_DATE = rf"(?<!{CASED_LETTER})(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|1[0-2])[./-][0-9]{{2,4}}{CASED_EDGE}"

# What counts as a value and may be words alone.
SHARE_WORDS = rf"(?iu)yüzde{S}+(?:[0-9]+(?:[.,][0-9]+)?|{NUMBER_WORD}(?:{S}+{NUMBER_WORD}){{0,4}})"
AMOUNT_WORDS = rf"(?iu){NUMBER_WORD}(?:{S}+{NUMBER_WORD}){{0,5}}{S}+{NAMED_CURRENCY}{EDGE}"
DAY_WORDS = rf"(?iu)(?:{OPEN}(?:bu|gelecek|önümüzdeki|haftaya|geçen|ertesi){S}+)?{OPEN}{WEEKDAY}{ENDING}(?:{S}+günü{ENDING})?{CLOSE}"

# Phrases that announce a request; all but the second are strong.
STRONG_MARKERS = ["asıl istediğim", "en çok işime yarayacak", "ihtiyacımız", "ihtiyacım", "amacımız", "amacım"]
MARKERS = ["asıl istediğim", "benim sorum", "en çok işime yarayacak", "ihtiyacımız", "ihtiyacım", "amacımız", "amacım"]

MOST_VALUES, MOST_REQUESTS = 100, 12


_MATCHES = "array<struct<start:int,end:int,value:string>>"
_GROUP = 256
_CUT = "\u0002"

# One look for all numbers, from every place where one may begin; what is found is noted there, and of the text only the run of digits is passed over.
_ALL_NUMBERS = rf"(?=[0-9%A-ZÇĞİÖŞÜ])(?=({'|'.join(NUMBERS)})|({SHORT_DATE}))([0-9]*+)"


def _folded(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Walk through ``items`` with a carried value; ``step`` gives the next one and what to keep.

    An array that grows item by item is copied each time, so items are kept group by group.
    """

    def walk(acc: Column, item: Column) -> Column:
        carried, kept = step(acc["carried"], item)
        return F.struct(carried.alias("carried"), F.concat(acc["kept"], kept).alias("kept"))

    def one_group(acc: Column, group: Column) -> Column:
        done = F.aggregate(group, F.struct(acc["carried"].alias("carried"), F.array().cast(kind).alias("kept")), walk)
        return X.let(done, lambda d: F.struct(d["carried"].alias("carried"), F.concat(acc["kept"], d["kept"]).alias("kept")))

    last = F.floor((F.size(items) - 1) / _GROUP).cast("int")
    groups = F.transform(F.sequence(F.lit(0), last), lambda g: F.slice(items, g * _GROUP + 1, F.lit(_GROUP)))
    zero = F.struct(start.alias("carried"), F.array().cast(kind).alias("kept"))
    return F.aggregate(groups, zero, one_group, lambda acc: acc["kept"])


def _found(text: Column, pattern: str, noted: str) -> Column:
    """Matches as ``(start, end, value)``, in order, without those that an earlier one covers.

    ``noted`` puts before what it leaves of the text: a mark, a value, a mark, a short date, a mark. So lengths add up to positions.
    A short date that begins inside another one is none. No pattern matches the mark, so a text's own marks give way to another control character.
    """
    marked = F.regexp_replace(F.replace(text, F.lit(_CUT), F.lit("\u0001")), pattern, F.lit(noted))

    def cut(pieces: Column, i: Column) -> Column:
        value, date = F.get(pieces, i + 1), F.get(pieces, i + 2)
        said = F.when(date == "", value).otherwise(date)
        return F.struct(F.length(F.get(pieces, i)).alias("gap"), F.length(said).alias("size"), (date != "").alias("dated"), said.alias("value"))

    def step(seen: Column, c: Column) -> tuple[Column, Column]:
        start = seen["at"] + c["gap"]
        until = start + c["size"]
        counts = ~c["dated"] | (start >= seen["dated"])
        hit = F.struct(start.alias("start"), until.alias("end"), c["value"].alias("value"))
        after = F.struct(
            start.alias("at"),
            F.when(counts, F.greatest(seen["furthest"], until)).otherwise(seen["furthest"]).alias("furthest"),
            F.when(counts & c["dated"], until).otherwise(seen["dated"]).alias("dated"),
        )
        return after, F.when(counts & (until > seen["furthest"]), F.array(hit)).otherwise(none)

    none = F.array().cast(_MATCHES)
    zero = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("furthest"), F.lit(0).alias("dated"))
    cuts = lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 2, F.lit(3)), lambda i: cut(p, i))
    walked = lambda m: X.let(X.let(F.split(m, _CUT, -1), cuts), lambda c: _folded(c, zero, step, _MATCHES))
    return X.let(marked, lambda m: F.when(F.contains(m, F.lit(_CUT)), walked(m)).otherwise(none))


def named_values(text: Column) -> Column:
    """Matches of every pattern that none before them covers, by start and then longest first.

    Most texts name no value in words, so each of these patterns waits for a cheap look at what it needs.
    The look ignores the difference of i and ı, as the patterns do.
    """
    folded = lambda c: F.lower(F.replace(F.replace(F.replace(c, F.lit("İ"), F.lit("i")), F.lit("I"), F.lit("i")), F.lit("ı"), F.lit("i")))
    none = F.array().cast(_MATCHES)
    in_turn = lambda pattern: _found(text, pattern, f"{_CUT}$0{_CUT}{_CUT}$0")
    holds = lambda low, ws: reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in ws])

    def worded(low: Column) -> Column:
        named = ["eur", "usd", "dolar", "lira"]
        after_word = F.regexp_like(text, F.lit(rf"\p{{L}}{S}+(?=[TEUDLteudl])(?iu:{NAMED_CURRENCY})"))
        currency = holds(low, [*named, "tl"]) & after_word & (holds(low, named) | F.regexp_like(low, F.lit(f"{S}tl")))
        return F.concat(
            F.when(F.contains(low, F.lit("yüzde")), in_turn(SHARE_WORDS)).otherwise(none),
            F.when(currency, in_turn(AMOUNT_WORDS)).otherwise(none),
            F.when(holds(low, ["pazar", "cuma", "çarşamba", "perşembe", "sali"]), in_turn(DAY_WORDS)).otherwise(none),
        )

    numbers = _found(text, _ALL_NUMBERS, f"{_CUT}$1{_CUT}$2{_CUT}$3")
    both = F.struct(numbers.alias("numbers"), X.let(folded(text), worded).alias("words"))
    return X.let(both, lambda b: F.when(F.size(b["words"]) == 0, b["numbers"]).otherwise(uncovered(F.concat(b["numbers"], b["words"]))))


def uncovered(matches: Column) -> Column:
    """Matches that no other one covers, by start and then longest first; sorted they only need the furthest end so far."""
    keyed = F.transform(matches, lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("back"), m["value"].alias("value")))
    hit = lambda m: F.struct(m["start"].alias("start"), (-m["back"]).alias("end"), m["value"].alias("value"))
    none = F.array().cast(_MATCHES)
    step = lambda furthest, m: (F.greatest(furthest, -m["back"]), F.when(-m["back"] > furthest, F.array(hit(m))).otherwise(none))
    return X.let(F.array_sort(keyed), lambda ms: _folded(ms, F.lit(-1), step, _MATCHES))


def unique_in_order(values: Column, most: int) -> Column:
    """First of each trimmed value, case and white space aside, at most ``most`` of them."""
    keyed = F.transform(F.array_distinct(values), lambda v: F.struct(X.squeeze(X.lower_tr(v)).alias("key"), v.alias("value")))
    value = lambda ks, keys, k: F.get(ks, (F.array_position(keys, k) - 1).cast("int"))["value"]

    def firsts(ks: Column, keys: Column, distinct: Column) -> Column:
        as_said = F.transform(F.slice(F.filter(ks, lambda k: k["key"] != ""), 1, most), lambda k: k["value"])
        looked_up = F.transform(F.slice(F.filter(distinct, lambda k: k != ""), 1, most), lambda k: value(ks, keys, k))
        return F.when(F.size(distinct) == F.size(keys), as_said).otherwise(looked_up)

    return X.let(
        keyed, lambda ks: X.let(F.transform(ks, lambda k: k["key"]), lambda keys: X.let(F.array_distinct(keys), lambda distinct: firsts(ks, keys, distinct)))
    )


def value_anchors(text: Column) -> Column:
    """Values in the order of the text, covered and repeated ones left out."""
    return unique_in_order(F.transform(named_values(text), lambda m: m["value"]), MOST_VALUES)


def request_anchors(text: Column, markers: list[str] | None = None, strong_markers: list[str] | None = None) -> Column:
    """Sentences that announce a request, each with the one before and eight after it.

    Where a strong marker occurs anywhere only strong ones count. Markers are lower-case phrases.
    """
    weak_list = MARKERS if markers is None else markers
    strong_list = STRONG_MARKERS if strong_markers is None else strong_markers
    sentences = F.filter(F.transform(F.split(text, rf"(?<=[.!?]){S}+|\r?\n+"), X.strip), lambda s: s != "")
    holds = lambda s, markers: reduce(lambda a, b: a | b, [F.contains(s, F.lit(m)) for m in markers])

    def around(said: Column, lowered: Column) -> Column:
        strong = F.exists(lowered, lambda s: holds(s, strong_list))
        at = F.sequence(F.lit(1), F.size(lowered))
        places = X.let(
            strong,
            lambda any_strong: F.filter(
                at, lambda i: F.when(any_strong, holds(F.get(lowered, i - 1), strong_list)).otherwise(holds(F.get(lowered, i - 1), weak_list))
            ),
        )
        first = lambda i: F.greatest(i - 1, F.lit(1))
        return F.transform(places, lambda i: F.array_join(F.slice(said, first(i), i + 9 - first(i)), " "))

    found = X.let(sentences, lambda said: X.let(F.transform(said, X.lower_tr), lambda low: around(said, low)))
    low = X.lower_tr(text)
    marked = X.let(low, lambda t: holds(t, sorted({*weak_list, *strong_list})))
    return F.when(marked, unique_in_order(found, MOST_REQUESTS)).otherwise(F.array().cast("array<string>"))
