"""Column expressions for words, case, numbers and labels. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, as a list and as a pattern.
WHITE_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
WHITE = r"\s\x0b\p{Z}" + "\ufeff"
SPACE = f"[{WHITE}]"
NOT_SPACE = f"[^{WHITE}]"

# What opens a line when neither a speaker nor a side is known.
UNKNOWN_SPEAKER = "SPEAKER_??"
UNKNOWN_SIDE = "Belirsiz"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it.

    A column named twice is computed twice, and one named inside a lambda once per element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


_CUT = "\u0002"


def cut_at(text: Column, pattern: Column | str) -> Column:
    """The text as ``(gap, hit)`` pairs: what stands before each match, and the match; the last has no match.

    A split by a pattern makes the pattern anew for every row, a replacement once; so matches are marked,
    and the text is split at the marks. A text that holds a mark itself is split by the pattern.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    pairs = lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit"))
    marked = F.split(F.regexp_replace(text, regex, F.lit(f"{_CUT}$0{_CUT}")), _CUT, -1)
    paired = let(marked, lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 1, F.lit(2)), lambda i: pairs(F.get(p, i), F.get(p, i + 1))))
    plain = F.zip_with(F.split(text, regex, -1), F.regexp_extract_all(text, regex, F.lit(0)), pairs)
    return F.when(F.contains(text, F.lit(_CUT)), plain).when(text.isNotNull(), paired)


def replace_hits(text: Column, pattern: Column | str, new: Callable[[Column], Column]) -> Column:
    """Every match replaced by ``new(match)``."""
    return F.array_join(F.transform(cut_at(text, pattern), lambda c: F.concat(c["gap"], F.when(c["hit"].isNull(), "").otherwise(new(c["hit"])))), "")


def lower_tr(c: Column) -> Column:
    """Turkish lower case: I to ı and İ to i, which plain ``lower`` gets wrong."""
    return F.lower(F.replace(F.replace(c, F.lit("I"), F.lit("ı")), F.lit("İ"), F.lit("i")))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE_CHARS))


def squeeze(c: Column) -> Column:
    """White space runs become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def split_words(c: Column) -> Column:
    """Split an already squeezed string; an empty one has no words."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def word_line(c: Column) -> Column:
    """Lower-cased words joined by single spaces, punctuation dropped."""
    return F.trim(F.regexp_replace(lower_tr(c), r"[^\p{L}\p{N}]+", " "))


def words(c: Column) -> Column:
    return split_words(word_line(c))


def chars_per_second(text: Column, start: Column, end: Column) -> Column:
    return F.when((end - start) > 0, F.length(strip(text)) / (end - start))


def half_up(c: Column, digits: int) -> Column:
    """Round a non-negative number half up."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


# --- normalisation for value matching ----------------------------------------------------------

APOSTROPHES = "'‘’`´ʼ"  # fixed values


def match_form(c: Column) -> Column:
    """The form in which a value and a transcript are compared.

    Apostrophes vanish, a spelt-out or spaced percent sign is joined to its number, thousands
    groups are closed, a decimal point becomes a comma, and a comma survives only between digits.
    """
    odd = reduce(lambda x, y: x | y, [F.contains(c, F.lit(mark)) for mark in "Iİ" + APOSTROPHES])
    plain = F.when(odd, F.translate(c, "Iİ" + APOSTROPHES, "ıi")).otherwise(c)
    # A comma that does not stand between digits parts words like any other mark.
    apart = r"(?:[^\p{L}\p{N}%,]++|,(?:(?!\p{N})|(?<!\p{N},)))++"

    def formed(low: Column) -> Column:
        # Without a digit every comma parts words, and nothing else needs a closer look.
        wordy = F.regexp_replace(low, r"[^\p{L}%]+", " ")
        share = F.contains(low, F.lit("%")) | F.contains(low, F.lit("yüzde"))
        v = F.when(share, F.regexp_replace(low, rf"(?:yüzde|%){SPACE}+(?=[0-9])", "%")).otherwise(low)
        joined = F.regexp_replace(close_thousands(v), r"([0-9])\.([0-9])", "$1,$2")
        v = F.when(F.regexp_like(low, F.lit(f"[0-9][.{WHITE}][0-9]")), joined).otherwise(v)
        return F.trim(F.when(F.regexp_like(c, F.lit(r"\p{N}")), F.regexp_replace(v, apart, " ")).otherwise(wordy))

    return let(F.lower(plain), formed)


def close_thousands(v: Column) -> Column:
    """Join digit groups of three until nothing changes.

    A separator goes when it stands between a digit and exactly three digits. A pass replaces
    from left to right without overlap, so it can only skip the separator right after a joined
    one; joining never makes a new group of three, hence the second pass ends the work.
    """
    for _ in range(2):
        v = F.regexp_replace(v, rf"([0-9])[.{WHITE}]([0-9]{{3}})(?![0-9])", "$1$2")
    return v


# --- normalisation for transcript comparison ---------------------------------------------------

# Number words and their values.
NUMBER_WORDS = {
    "sıfır": 0, "bir": 1, "iki": 2, "üç": 3, "dört": 4, "beş": 5, "altı": 6, "yedi": 7,
    "sekiz": 8, "dokuz": 9, "on": 10, "yirmi": 20, "otuz": 30, "kırk": 40, "elli": 50,
    "altmış": 60, "yetmiş": 70, "seksen": 80, "doksan": 90, "yüz": 100, "bin": 1000,
}
_NUMBER = "(?:" + "|".join(NUMBER_WORDS) + ")"
_MARK = "\u0001"


def _number_value(run: Column) -> Column:
    """The integer a run of number words stands for; hundreds and thousands multiply what precedes."""
    value = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    at_least_one = lambda x: F.when(x == 0, F.lit(1).cast("bigint")).otherwise(x)
    zero = F.lit(0).cast("bigint")

    def step(acc: Column, w: Column) -> Column:
        total, open_part = acc["total"], acc["open"]
        return (
            F.when(w == "yüz", F.struct(total.alias("total"), (at_least_one(open_part) * 100).alias("open")))
            .when(w == "bin", F.struct((total + at_least_one(open_part) * 1000).alias("total"), zero.alias("open")))
            .otherwise(F.struct(total.alias("total"), (open_part + value[w].cast("bigint")).alias("open")))
        )

    start = F.struct(zero.alias("total"), zero.alias("open"))
    return F.aggregate(F.split(run, " "), start, step, lambda acc: acc["total"] + acc["open"])


def compare_line(c: Column) -> Column:
    """Comparable words joined by spaces: numbers as digits, percent joined to its number.

    Separators inside numbers vanish (two passes, so that three groups close); every other mark
    parts words. Runs of number words are cut out of the line, valued, and put back.
    """
    s = lower_tr(c)
    joined = s
    for _ in range(2):
        joined = F.regexp_replace(joined, r"([0-9])[.,]([0-9])", "$1$2")
    s = F.when(F.regexp_like(c, F.lit("[0-9]")), joined).otherwise(s)
    s = F.concat(F.lit(" "), F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}%]+", " ")), F.lit(" "))
    run = rf"(?<= )({_NUMBER}(?: {_NUMBER})*)(?= )"
    pieces = F.split(F.regexp_replace(s, run, f"{_MARK}$1{_MARK}"), _MARK)
    folded = F.transform(pieces, lambda x, i: F.when(i % 2 == 1, _number_value(x).cast("string")).otherwise(x))
    return F.trim(F.regexp_replace(F.array_join(folded, ""), r"(?<= )(?:yüzde|%) ([0-9]+)(?= )", "%$1"))


def compare_words(c: Column) -> Column:
    return split_words(compare_line(c))


# --- turns, labels, identifiers -----------------------------------------------------------------


def split_turns(c: Column) -> Column:
    """One entry per turn: a dash after white space opens the next one."""
    parts = F.split(c, rf"{SPACE}+(?=-{SPACE}*{NOT_SPACE})")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def has_line_labels(c: Column) -> Column:
    """Whether any line opens with ``Name:``, ``[tag]:`` or a numbered speaker label."""
    label = r"(?iu)^(?:\[[^\]]+\]|(?:speaker|konuşmacı)[ _-]?[0-9]+|\p{L}[\p{L} .'-]{0,40}):" + f"{SPACE}+"
    # A trailing label with nothing after it has lost its white space to the trim, so it does not count.
    return F.exists(F.split(c, r"\r?\n"), lambda line: F.regexp_like(strip(line), F.lit(label)))


def quote_pattern(c: Column) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\/-])", r"\\$1")


_BEFORE_LABEL = r"(?<![\p{L}\p{N}_])"
_AFTER_LABEL = r"(?![\p{L}\p{N}_])"


def mentions_label(text: Column, label: Column) -> Column:
    """Whether ``label`` stands in ``text`` bounded by non-word characters."""
    return F.regexp_like(text, F.concat(F.lit(_BEFORE_LABEL), quote_pattern(label), F.lit(_AFTER_LABEL)))


def rename_labels(text: Column, names: Column) -> Column:
    """Replace every bounded label of the map ``names`` in one pass, longest label first.

    The text is cut at the labels once and each cut is looked up, so a written name is never
    looked at again.
    """
    longer_first = lambda a, b: F.coalesce(F.nullif(F.length(b) - F.length(a), F.lit(0)), F.when(a < b, -1).otherwise(1))
    alternatives = F.array_join(F.transform(F.array_sort(F.map_keys(names), longer_first), quote_pattern), "|")
    pattern = F.concat(F.lit(f"{_BEFORE_LABEL}(?:"), alternatives, F.lit(f"){_AFTER_LABEL}"))
    renamed = replace_hits(text, pattern, lambda x: F.coalesce(names[x], x))
    return F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, text).otherwise(renamed)


def name_error(c: Column) -> Column:
    """Why a speaker name is refused; null when it is fine. A blank name means no change."""
    name = strip(c)
    return (
        F.when(name == "", None)
        .when(F.regexp_like(name, F.lit(r"[:\r\n]")), F.lit("separator"))
        .when(F.regexp_like(name, F.lit(r"(?i)^speaker[ _-]?[0-9]+$")), F.lit("reserved"))
    )


_ID_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}-[0-9]{2}-[0-9]{2}-[0-9]{3}Z$"


def id_to_timestamp(c: Column) -> Column:
    """A meeting id as a timestamp; null where its shape or its date is wrong."""
    iso = F.regexp_replace(c, r"^(.{10})T(..)-(..)-(..)-(...)Z$", "$1T$2:$3:$4.$5Z")
    return F.when(F.regexp_like(c, F.lit(_ID_SHAPE)), F.try_to_timestamp(iso))


def timestamp_to_id(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'")


def check_scope(c: Column) -> Column:
    """``group`` where missing; an unknown value is an error."""
    return (
        F.when(c.isNull(), F.lit("group"))
        .when(c.isin("group", "two-party"), c)
        .otherwise(F.raise_error(F.concat(F.lit("unknown meeting scope: "), c)).cast("string"))
    )


def check_language(c: Column) -> Column:
    """Only the two known languages pass; anything else, null included, is an error."""
    return F.when(c.isin("turkish", "foreign"), c).otherwise(
        F.raise_error(F.concat(F.lit("unknown meeting language: "), F.coalesce(c, F.lit("null")))).cast("string")
    )


def display_name(name: Column, created: Column, edited: Column) -> Column:
    base = F.coalesce(name, F.date_format(created, "dd.MM.yyyy HH:mm"))
    return F.when(edited, F.concat(base, F.lit(" (Edited)"))).otherwise(base)


def clean_file_name(c: Column) -> Column:
    cleaned = F.regexp_replace(strip(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', " ")), r"[. ]+$", "")
    cleaned = F.substring(cleaned, 1, 150)
    return F.when(cleaned == "", F.lit("toplanti")).otherwise(cleaned)


def token_estimate(text: Column, chars_per_token: float = 3.5) -> Column:
    return F.ceil(F.length(text) / F.lit(float(chars_per_token)))


# --- domain dictionary ---------------------------------------------------------------------------

# Misspelt words and their corrections.
DOMAIN_DICTIONARY = {"fre": "fire", "compilence": "compliance"}


def correct_words(text: Column, dictionary: dict[str, str] | None = None) -> Column:
    """Replace whole misspelt words, keeping an initial capital; longer keys win.

    The dictionary is a small fixed map given in code, so it travels inside the expression.
    """
    table = DOMAIN_DICTIONARY if dictionary is None else dictionary
    if not table:
        return text
    keys = sorted(table, key=len, reverse=True)
    quoted = ["".join("\\" + ch if ch in r".*+?^${}()|[]\/-" else ch for ch in k) for k in keys]
    pattern = r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(quoted) + r")(?![\p{L}\p{N}])"
    right = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def corrected(x: Column) -> Column:
        word = right[lower_tr(x)]
        first = F.substring(x, 1, 1)
        upper = F.upper(F.translate(F.substring(word, 1, 1), "ıi", "Iİ"))
        capital = F.concat(upper, F.substring(word, F.lit(2), F.length(word)))
        return F.coalesce(F.when(first != lower_tr(first), capital).otherwise(word), x)

    return replace_hits(text, pattern, corrected)
