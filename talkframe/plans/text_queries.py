"""Queries over texts: normal forms, comparison with references, values, chunks, drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.functions import entities as E
from talkframe.functions import text as X
from talkframe.operators import dictionary as D
from talkframe.operators import analysis as A
from talkframe.operators import chunking as C
from talkframe.operators import quality as Q
from talkframe.operators import values as V
from talkframe.plans import tables as T
from talkframe.plans.registry import query
from talkframe.session import widen

LOWER = "lower(replace(replace({0}, 'I', 'ı'), 'İ', 'i'))"


def match_sql(column: str) -> str:
    """The match form in RE2, which has no look-around: neighbours are captured and put back."""
    s = f"translate({LOWER.format(column)}, '''‘’`´ʼ', '')"
    s = rf"regexp_replace({s}, '(?:yüzde|%){T.SPACE_SQL}+([0-9])', '%\1', 'g')"
    for _ in range(4):
        s = rf"regexp_replace({s}, '([0-9])[.{X.WHITE}]([0-9]{{3}})([^0-9]|$)', '\1\2\3', 'g')"
    s = rf"regexp_replace({s}, '([0-9])\.([0-9])', '\1,\2', 'g')"
    s = rf"regexp_replace({s}, '[^\p{{L}}\p{{N}}%,]+', ' ', 'g')"
    s = f"regexp_replace({s}, ',{{2,}}', ' ', 'g')"
    s = rf"regexp_replace({s}, ',([^\p{{N}},]|$)', ' \1', 'g')"
    s = rf"regexp_replace({s}, '(^|[^\p{{N}},]),', '\1 ', 'g')"
    return f"trim(regexp_replace({s}, ' +', ' ', 'g'))"


NUMBERS_SQL = "MAP {" + ", ".join(f"'{w}': {v}" for w, v in X.NUMBER_WORDS.items()) + "}"


def compare_sql(name: str, source: str, key: str, column: str) -> str:
    """CTEs that end in ``{name}({key}, line)``: the comparison form of a column, word by word."""
    low = LOWER.format(column)
    for _ in range(2):
        low = rf"regexp_replace({low}, '([0-9])[.,]([0-9])', '\1\2', 'g')"
    return rf"""
{name}_s AS (SELECT {key}, trim(regexp_replace({low}, '[^\p{{L}}\p{{N}}%]+', ' ', 'g')) AS s FROM {source}),
{name}_t AS (SELECT {key}, unnest(string_split(s, ' ')) AS w, generate_subscripts(string_split(s, ' '), 1) AS p FROM {name}_s),
{name}_v AS (SELECT *, {NUMBERS_SQL}[w] AS v FROM {name}_t),
{name}_i AS (SELECT *, CASE WHEN v IS NULL THEN -p ELSE p - row_number() OVER (PARTITION BY {key}, v IS NULL ORDER BY p) END AS island FROM {name}_v),
{name}_r AS (SELECT {key}, min(p) AS p, CASE WHEN max(v) IS NULL THEN max(w) ELSE
    CAST(list_reduce(list_prepend({{'t': 0, 'c': 0, 'v': 0}}, list({{'t': 0, 'c': 0, 'v': coalesce(v, 0)}} ORDER BY p)), lambda a, x:
      CASE WHEN x.v = 100 THEN {{'t': a.t, 'c': greatest(a.c, 1) * 100, 'v': 0}}
           WHEN x.v = 1000 THEN {{'t': a.t + greatest(a.c, 1) * 1000, 'c': 0, 'v': 0}}
           ELSE {{'t': a.t, 'c': a.c + x.v, 'v': 0}} END).t
    + list_reduce(list_prepend({{'t': 0, 'c': 0, 'v': 0}}, list({{'t': 0, 'c': 0, 'v': coalesce(v, 0)}} ORDER BY p)), lambda a, x:
      CASE WHEN x.v = 100 THEN {{'t': a.t, 'c': greatest(a.c, 1) * 100, 'v': 0}}
           WHEN x.v = 1000 THEN {{'t': a.t + greatest(a.c, 1) * 1000, 'c': 0, 'v': 0}}
           ELSE {{'t': a.t, 'c': a.c + x.v, 'v': 0}} END).c AS VARCHAR) END AS w
  FROM {name}_i GROUP BY {key}, island),
{name}_l AS (SELECT {key}, ' ' || replace(string_agg(w, ' ' ORDER BY p), ' ', '  ') || ' ' AS s FROM {name}_r GROUP BY {key}),
{name} AS (SELECT {key}, trim(regexp_replace(regexp_replace(s, ' (?:yüzde|%)  ([0-9]+) ', ' %\1 ', 'g'), ' +', ' ', 'g')) AS line FROM {name}_l)"""


@query("match_forms", f"SELECT doc_id, md5({match_sql('text')}) AS form, length({match_sql('text')}) AS n FROM documents")
def match_forms(spark: SparkSession, sf: str) -> DataFrame:
    docs = T.texts(spark, sf).select("doc_id", X.match_form(F.col("text")).alias("f"))
    return docs.select("doc_id", F.md5("f").alias("form"), F.length("f").cast("bigint").alias("n"))


@query("compare_forms", "WITH " + compare_sql("c", "documents", "doc_id", "text") + " SELECT doc_id, md5(line) AS form, length(line) AS n FROM c")
def compare_forms(spark: SparkSession, sf: str) -> DataFrame:
    docs = T.texts(spark, sf).select("doc_id", X.compare_line(F.col("text")).alias("f"))
    return docs.select("doc_id", F.md5("f").alias("form"), F.length("f").cast("bigint").alias("n"))


SCENARIOS = "(SELECT count(*) FROM benchmark)"
"""As many scenarios as the benchmark has items."""


def doc_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as runs of scenarios, each with the benchmark item of its scenario as reference."""
    items = T.read(spark, sf, "benchmark").agg(F.count(F.lit(1))).scalar()
    docs = T.texts(spark, sf).select("doc_id", "text", (F.col("doc_id") % items).alias("scenario"))
    refs = T.read(spark, sf, "benchmark").select(F.col("item_id").alias("scenario"), F.col("text").alias("reference"))
    return docs.join(refs, "scenario", "left")


def item_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The long words of a benchmark item as the terms of its scenario."""
    worded = T.read(spark, sf, "benchmark").select(F.col("item_id").alias("scenario"), F.explode(X.words(F.col("text"))).alias("term"))
    return worded.filter(F.length("term") >= 8).distinct()


TERMS_SQL = f"terms AS (SELECT DISTINCT item_id AS scenario, term FROM (SELECT item_id, unnest({T.sql_words('text')}) AS term FROM benchmark) WHERE length(term) >= 8)"
TERM_FORMS = "WITH " + TERMS_SQL + "," + compare_sql("hay", "documents", "doc_id", "text") + "," + compare_sql("needle", "terms", "term", "term")


@query(
    "term_presence",
    TERM_FORMS
    + f""" SELECT h.doc_id, t.term, contains(h.line, n.line) AS present
    FROM hay h JOIN terms t ON t.scenario = h.doc_id % {SCENARIOS} JOIN (SELECT DISTINCT * FROM needle) n ON n.term = t.term""",
)
def term_presence(spark: SparkSession, sf: str) -> DataFrame:
    return Q.term_presence(doc_runs(spark, sf), item_terms(spark, sf), ["doc_id"])


@query(
    "term_recall",
    TERM_FORMS
    + f""", hits AS (SELECT h.doc_id, contains(h.line, n.line) AS present
      FROM hay h JOIN terms t ON t.scenario = h.doc_id % {SCENARIOS} JOIN (SELECT DISTINCT * FROM needle) n ON n.term = t.term)
    SELECT d.doc_id, count(*) FILTER (WHERE present) AS found, count(present) AS total,
      CASE WHEN count(present) = 0 THEN 1.0 ELSE CAST(count(*) FILTER (WHERE present) AS DOUBLE) / count(present) END AS recall
    FROM documents d LEFT JOIN hits h USING (doc_id) GROUP BY d.doc_id""",
)
def term_recall(spark: SparkSession, sf: str) -> DataFrame:
    return Q.term_recall(doc_runs(spark, sf), item_terms(spark, sf), ["doc_id"])


@query("word_errors")
def word_errors(spark: SparkSession, sf: str) -> DataFrame:
    """References are single sentences, so no table of distances is large."""
    return Q.word_errors(doc_runs(spark, sf), long_texts=False).select("doc_id", "distance", "ref_tokens", "hyp_tokens", "wer")


@query(
    "invented_sentences",
    "WITH sentences AS (SELECT doc_id, doc_id * 1000000 + generate_subscripts(string_split_regex(text, '[.!?]+'), 1) AS sid, unnest(string_split_regex(text, '[.!?]+')) AS text FROM documents),"
    + compare_sql("said", "sentences", "sid", "text")
    + ","
    + compare_sql("ref", "benchmark", "item_id", "text")
    + f""" SELECT s.doc_id, CASE WHEN any_value(r.item_id) IS NOT NULL THEN
        count(*) FILTER (WHERE len(string_split(f.line, ' ')) >= 3 AND NOT contains(r.line, f.line)) END AS invented
    FROM sentences s JOIN said f USING (sid) LEFT JOIN ref r ON r.item_id = s.doc_id % {SCENARIOS} GROUP BY s.doc_id""",
)
def invented_sentences(spark: SparkSession, sf: str) -> DataFrame:
    runs = doc_runs(spark, sf)
    return runs.select("doc_id", Q.invented_sentences(F.col("text"), F.col("reference")).cast("bigint").alias("invented"))


@query("metric_rows")
def metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Metric blocks of documents as runs; their lines stand for segments."""
    line = F.transform(
        F.split("text", "\n"),
        lambda s, i: F.struct(
            (i * 1.5).alias("start"), (i * 1.5 + F.length(s) / 14).alias("end"), (F.length(s) < 20).alias("duplicate"), F.lit(False).alias("overlap")
        ),
    )
    runs = doc_runs(spark, sf).select(
        "*",
        F.concat(F.lit("ref/"), F.col("scenario").cast("string")).alias("reference_path"),
        (F.length("text") / 14).alias("duration_sec"),
        (F.length("text") * 20.0).alias("ms"),
        F.lit(1500.4).alias("load_ms"),
        (F.length("text") * 1000.0).alias("peak_rss"),
        F.lit(5_000_000.0).alias("disk_bytes"),
        line.alias("segments"),
    )
    return Q.metric_rows(runs, item_terms(spark, sf), ["doc_id", "scenario"])


@query("value_anchors")
def value_anchors(spark: SparkSession, sf: str) -> DataFrame:
    docs = T.texts(spark, sf).select("doc_id", F.posexplode(E.value_anchors(F.col("text"))).alias("rank", "value"))
    return docs


def order_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as sentences that name a code, an amount, a date, a share and a number of pieces."""
    code, price = F.lpad((F.col("o_orderkey") % 100_000_000).cast("string"), 8, "0"), F.floor("o_totalprice").cast("string")
    share, pieces = (F.col("o_custkey") % 90 + 1).cast("string"), (F.col("o_custkey") % 37 + 2).cast("string")
    said = F.concat(
        F.lit("ORD-"), code, F.lit(" kodlu sipariş "), price, F.lit(" TL tutarında, "), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit(" günü teslim; indirim %"), share, F.lit(", "), pieces, F.lit(" adet. ORD-"), code, F.lit(" tamam."),
    )
    return widen(T.read(spark, sf, "orders")).select("o_orderkey", said.alias("text"), price.alias("price"), pieces.alias("pieces"))


ORDER_VALUES_SQL = """WITH v AS (SELECT o_orderkey, 'ORD-' || lpad(CAST(o_orderkey % 100000000 AS VARCHAR), 8, '0') AS code, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS price,
  strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%d') || ' günü' AS days, '%' || (o_custkey % 90 + 1) AS share, (o_custkey % 37 + 2) || ' adet' AS pieces FROM orders),
  listed AS (SELECT o_orderkey, {} AS vs FROM v)
SELECT o_orderkey, CAST(generate_subscripts(vs, 1) - 1 AS INT) AS rank, unnest(vs) AS value FROM listed"""


@query("order_values", ORDER_VALUES_SQL.format("[code, price || ' TL', day, days, share, pieces]"))
def order_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every value an order's sentence names, each once; the date's last two digits are also a number of days, which no other value covers."""
    return order_sentences(spark, sf).select("o_orderkey", F.posexplode(E.value_anchors(F.col("text"))).alias("rank", "value"))


@query("order_claims", ORDER_VALUES_SQL.format("['Tutar: ' || price || ' TL', 'Adet: ' || pieces, code, day, days, share]"))
def order_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims about an order: one that its sentence does not bear out goes, and what no claim covers is added."""
    claims = F.array(F.concat(F.lit("Tutar: "), "price", F.lit(" TL")), F.lit("Depo: 987654321 koli"), F.concat(F.lit("Adet: "), "pieces", F.lit(" adet")))
    claimed = order_sentences(spark, sf).withColumn("items", claims)
    # a plain explode would look beforehand whether there is anything, and work the values out again for that
    found = V.detect_values(claimed).select("o_orderkey", F.posexplode_outer("detected").alias("rank", "value"))
    return found.filter(F.col("rank").isNotNull())


SENTENCES_SQL = rf"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?]){T.SPACE_SQL}+', '\1' || chr(1), 'g'), chr(1) || '|\r?\n+'), lambda s: {T.sql_strip('s')}), lambda s: s <> '')"


@query(
    "request_anchors",
    f"""WITH said AS (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents),
    pos AS (SELECT doc_id, s, unnest(s) AS one, generate_subscripts(s, 1) AS i FROM said),
    low AS (SELECT *, {LOWER.format('one')} AS l FROM pos),
    strong AS (SELECT doc_id, bool_or(contains(l, 'tsch') OR contains(l, 'enough')) AS any_strong FROM low GROUP BY ALL),
    hit AS (SELECT doc_id, i, array_to_string(s[greatest(i - 1, 1):i + 8], ' ') AS anchor FROM low JOIN strong USING (doc_id)
      WHERE CASE WHEN any_strong THEN contains(l, 'tsch') OR contains(l, 'enough') ELSE contains(l, 'qu') OR contains(l, 'tsch') END),
    keyed AS (SELECT *, {T.sql_squeeze(LOWER.format('anchor'))} AS k FROM hit),
    once AS (SELECT * FROM keyed WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY i) = 1)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS rank, md5({T.sql_strip('anchor')}) AS anchor FROM once
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 12""",
)
def request_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """The marker rule with markers that occur in these texts."""
    found = E.request_anchors(F.col("text"), ["qu", "tsch"], ["tsch", "enough"])
    docs = T.texts(spark, sf).select("doc_id", F.posexplode(found).alias("rank", "anchor"))
    return docs.select("doc_id", F.col("rank").cast("bigint").alias("rank"), F.md5("anchor").alias("anchor"))


@query(
    "grounded_values",
    f"""WITH w AS (SELECT doc_id, {match_sql('text')} AS hay, string_split({match_sql('text')}, ' ') AS t FROM documents),
    claims AS (
      SELECT doc_id, hay, 1 AS k, 'opening' AS label, t[1] || ' ' || t[2][:greatest(length(t[2]) - 1, 1)] AS v FROM w UNION ALL
      SELECT doc_id, hay, 2, 'closing', t[-2] || ' ' || t[-1] FROM w UNION ALL
      SELECT doc_id, hay, 3, 'crossed', t[2] || ' ' || t[1] FROM w UNION ALL
      SELECT doc_id, hay, 4, 'opening', t[1] FROM w),
    grounded AS (SELECT * FROM claims WHERE v IS NOT NULL AND trim(v) <> '' AND {match_sql('v')} <> ''
      AND (contains(' ' || hay || ' ', ' ' || {match_sql('v')} || ' ') OR regexp_matches(' ' || hay || ' ', ' ' || regexp_escape({match_sql('v')}) || '\\p{{L}}'))
      AND {match_sql('v')} <> label)
    SELECT doc_id, v FROM grounded g WHERE k <> 1 OR NOT EXISTS (SELECT 1 FROM grounded o WHERE o.doc_id = g.doc_id AND o.k = 4)""".replace("\\\\p", "\\p"),
)
def grounded_values(spark: SparkSession, sf: str) -> DataFrame:
    """Claims made of a text's own words, one cut off, one in the wrong order, one label given twice."""
    docs = T.texts(spark, sf).select("doc_id", X.match_form(F.col("text")).alias("hay"))
    worded = docs.withColumn("t", F.split("hay", " "))
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    end = F.size("t")
    cut_off = F.substring(second, F.lit(1), F.greatest(F.length(second) - 1, F.lit(1)))
    claims = F.array(
        F.concat(F.lit("opening: "), first, F.lit(" "), cut_off),
        F.concat(F.lit("closing: "), F.get("t", end - 2), F.lit(" "), F.get("t", end - 1)),
        F.concat(F.lit("crossed: "), second, F.lit(" "), first),
        F.concat(F.lit("opening: "), first),
    )
    ready = worded.withColumn("items", F.array_compact(claims)).withColumn("anchors", F.array().cast("array<string>"))
    kept = ready.select("doc_id", F.explode(V.merge_values(F.col("items"), F.col("anchors"), F.col("hay"))).alias("item"))
    return kept.select("doc_id", F.regexp_replace("item", "^[a-z]+: ", "").alias("v"))


@query("detected_values")
def detected_values(spark: SparkSession, sf: str) -> DataFrame:
    """Digits claimed under one label, and the anchors of the text they leave uncovered."""
    numbers = F.transform(F.regexp_extract_all("text", F.lit(r"[0-9]+"), F.lit(0)), lambda n: F.concat(F.lit("number: "), n))
    docs = T.texts(spark, sf).withColumn("items", numbers)
    return V.detect_values(docs).select("doc_id", F.posexplode_outer("detected").alias("rank", "value")).filter(F.col("rank").isNotNull())


@query(
    "token_estimates",
    "SELECT doc_id, CAST(ceil(length(text) / CAST(3.5 AS DOUBLE)) AS BIGINT) AS tokens, ceil(length(text) / CAST(3.5 AS DOUBLE)) + 4096 <= 8192 AS fits FROM documents",
)
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    tokens = X.token_estimate(F.col("text"))
    return T.texts(spark, sf).select("doc_id", tokens.alias("tokens"), (tokens + 4096 <= 8192).alias("fits"))


@query("text_chunks")
def text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = T.texts(spark, sf)
    return C.chunk_rows(docs, 220, 40).select("doc_id", "chunk_idx", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


@query(
    "turn_splits",
    rf"""SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '{T.SPACE_SQL}+-({T.SPACE_SQL}*[^{X.WHITE}])', chr(1) || '-\1', 'g'), chr(1)), lambda s: {T.sql_strip('s')}), lambda s: s <> '')) AS turns FROM documents""",
)
def turn_splits(spark: SparkSession, sf: str) -> DataFrame:
    return T.texts(spark, sf).select("doc_id", F.size(X.split_turns(F.col("text"))).cast("bigint").alias("turns"))


@query(
    "labelled_texts",
    rf"""SELECT doc_id, len(list_filter(string_split_regex(text, '\r?\n'), lambda l: regexp_matches({T.sql_strip('l')}, '(?i)^(?:\[[^\]]+\]|(?:speaker|konuşmacı)[ _-]?[0-9]+|\p{{L}}[\p{{L}} .''-]{{0,40}}):{T.SPACE_SQL}+'))) > 0 AS labelled FROM documents""",
)
def labelled_texts(spark: SparkSession, sf: str) -> DataFrame:
    return T.texts(spark, sf).select("doc_id", X.has_line_labels(F.col("text")).alias("labelled"))


FIXES = {"und": "and", "the": "teh", "des": "der"}


@query(
    "corrected_words",
    r"""WITH parts AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS p FROM documents)
    SELECT doc_id, md5(array_to_string(list_transform(p, lambda w: CASE lower(w)
      WHEN 'und' THEN CASE WHEN left(w, 1) = 'U' THEN 'And' ELSE 'and' END
      WHEN 'the' THEN CASE WHEN left(w, 1) = 'T' THEN 'Teh' ELSE 'teh' END
      WHEN 'des' THEN CASE WHEN left(w, 1) = 'D' THEN 'Der' ELSE 'der' END ELSE w END), '')) AS digest FROM parts""",
)
def corrected_words(spark: SparkSession, sf: str) -> DataFrame:
    return T.texts(spark, sf).select("doc_id", F.md5(X.correct_words(F.col("text"), FIXES)).alias("digest"))


DICTIONARY_SQL = r"""parts AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS p FROM documents),
    dictionary AS (SELECT DISTINCT lower(w) AS key FROM (SELECT unnest(p) AS w FROM parts) WHERE regexp_full_match(lower(w), '[a-hj-z]+') AND length(w) >= 7 AND length(w) % 3 = 1)"""


@query(
    "dictionary_texts",
    f"""WITH {DICTIONARY_SQL},
    pieces AS (SELECT doc_id, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM parts)
    SELECT doc_id, md5(string_agg(CASE WHEN key IS NULL THEN w WHEN left(w, 1) <> lower(left(w, 1)) THEN upper(left(reverse(key), 1)) || substr(reverse(key), 2) ELSE reverse(key) END, '' ORDER BY i)) AS digest,
      count(key) AS corrected FROM pieces LEFT JOIN dictionary ON key = lower(w) GROUP BY doc_id""",
)
def dictionary_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents corrected by a dictionary as a table: every long enough word of the corpus stands in it, written backwards."""
    texts = T.texts(spark, sf).select("doc_id", "text")
    word = texts.select("doc_id", F.explode(F.array_remove(F.split("text", r"[^\p{L}\p{N}]+"), "")).alias("w")).withColumn("key", F.lower("w"))
    known = word.filter(F.col("key").rlike("^[a-hj-z]+$") & (F.length("w") >= 7) & (F.length("w") % 3 == 1))
    dictionary = known.select("key").distinct().withColumn("word", F.reverse("key"))
    counts = known.groupBy("doc_id").agg(F.count("*").alias("corrected"))
    done = D.correct_texts(texts, dictionary, ["doc_id"]).select("doc_id", F.md5("text").alias("digest"))
    return done.join(counts, "doc_id", "left").withColumn("corrected", F.coalesce("corrected", F.lit(0)).cast("bigint"))


# --- drafts --------------------------------------------------------------------------------------


def raw_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as what an extractor might return: lines, sentences and clauses as items of three sections."""
    raw = F.to_json(
        F.struct(
            F.split("text", "\n").alias("mainRequest"),
            F.transform(F.split("text", r"\. "), lambda s: F.concat(F.lit("- "), s)).alias("decisions"),
            F.split("text", ", ").alias("actionItems"),
            F.array(F.lit(1), F.lit(2)).alias("nextSteps"),
            F.lit("none").alias("unknown"),
        )
    )
    return T.texts(spark, sf).select("doc_id", "text", raw.alias("raw"))


CLEAN = (
    rf"{T.sql_strip('replace(replace(regexp_replace(regexp_replace(' + T.sql_strip('x') + ', ' + chr(39) + '^[-*]' + T.SPACE_SQL + '+' + chr(39) + ', ' + chr(39) + chr(39) + '), ' + chr(39) + T.SPACE_SQL + '*' + chr(92) + 'r?' + chr(92) + 'n' + T.SPACE_SQL + '*' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + '<' + chr(39) + ', ' + chr(39) + '&lt;' + chr(39) + '), ' + chr(39) + '>' + chr(39) + ', ' + chr(39) + '&gt;' + chr(39) + ')')}"
)
DRAFT_ITEMS_SQL = f"""WITH raw AS (
  SELECT doc_id, 0 AS s, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents UNION ALL
  SELECT doc_id, 2, '- ' || unnest(string_split(text, '. ')), generate_subscripts(string_split(text, '. '), 1) FROM documents UNION ALL
  SELECT doc_id, 4, unnest(string_split(text, ', ')), generate_subscripts(string_split(text, ', '), 1) FROM documents),
cleaned AS (SELECT doc_id, s, i, {CLEAN} AS item FROM raw),
kept AS (SELECT *, {LOWER.format('item')} AS k FROM cleaned WHERE item <> '' AND {LOWER.format('item')} <> 'tespit edilmedi.'),
items AS (SELECT doc_id, s, i, item FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id, s, k ORDER BY i) = 1)
"""


@query(
    "draft_items",
    DRAFT_ITEMS_SQL + "SELECT doc_id, CAST(s AS INT) AS section_idx, row_number() OVER (PARTITION BY doc_id, s ORDER BY i) - 1 AS item_idx, md5(item) AS item FROM items",
)
def draft_items(spark: SparkSession, sf: str) -> DataFrame:
    drafts = raw_drafts(spark, sf).withColumn("draft", A.coerce_draft(F.col("raw")))
    items = A.draft_items(drafts, ["doc_id"])
    return items.select("doc_id", "section_idx", F.col("item_idx").cast("bigint").alias("item_idx"), F.md5("item").alias("item"))


@query(
    "section_counts",
    DRAFT_ITEMS_SQL
    + """, per AS (SELECT doc_id, s, count(*) AS n FROM items GROUP BY ALL),
    grid AS (SELECT doc_id, unnest(generate_series(0, 8)) AS s FROM documents)
    SELECT doc_id, CAST(s AS INT) AS section_idx, CAST(coalesce(n, 0) AS INT) AS items,
      CAST(count(n) OVER (PARTITION BY doc_id) AS INT) AS filled_sections, CAST(coalesce(sum(n) OVER (PARTITION BY doc_id), 0) AS INT) AS total_items
    FROM grid LEFT JOIN per USING (doc_id, s)""",
)
def section_counts(spark: SparkSession, sf: str) -> DataFrame:
    drafts = raw_drafts(spark, sf).withColumn("draft", A.coerce_draft(F.col("raw")))
    return A.section_counts(drafts, ["doc_id"]).drop("section_key")


@query(
    "draft_round_trip",
    DRAFT_ITEMS_SQL + "SELECT d.doc_id, count(i.item) AS items, count(i.item) AS parsed FROM documents d LEFT JOIN items i ON i.doc_id = d.doc_id AND i.s <> 4 GROUP BY d.doc_id",
)
def draft_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Drafts with one section emptied, printed and read back."""
    drafts = raw_drafts(spark, sf).withColumn("draft", A.coerce_draft(F.col("raw")))
    edited = drafts.withColumn("draft", A.replace_section(F.col("draft"), "actionItems", F.array(F.lit("  "))))
    back = edited.withColumn("markdown", A.serialize_draft(F.col("draft"))).withColumn("back", A.parse_draft(F.col("markdown")))
    total = lambda c: sum(F.size(F.col(c)[k]) for k in A.SECTIONS).cast("bigint")
    return back.select("doc_id", total("draft").alias("items"), total("back").alias("parsed"))


@query("moved_actions")
def moved_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Clauses with an invented owner appended: they become next steps where lines carry no labels."""
    owned = F.transform(F.split("text", ", "), lambda s: F.concat(F.regexp_replace(s, r"[()]", ""), F.lit(" (Konuşmacı: X).")))
    raw = F.to_json(F.struct(owned.alias("actionItems")))
    docs = T.texts(spark, sf).select("doc_id", "text", raw.alias("raw")).withColumn("draft", A.coerce_draft(F.col("raw")))
    moved = docs.withColumn("draft", A.move_unlabeled_actions(F.col("draft"), F.col("text")))
    return moved.select("doc_id", F.size("draft.actionItems").alias("actions"), F.size("draft.nextSteps").alias("steps"))


@query("analysis_job")
def analysis_job(spark: SparkSession, sf: str) -> DataFrame:
    """All documents through the whole job with the extractive extractor."""
    docs = T.texts(spark, sf)
    done = A.analyze(docs, A.extractive, A.AnalysisConfig(num_ctx=6144, chunk_tokens=900))
    return done.select("doc_id", "status", F.size("draft.mainRequest").alias("requests"), F.size("draft.detectedValues").alias("values"))
