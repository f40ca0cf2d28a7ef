"""Registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm import extraction, language, leaks, lines, merkle, mixing, negatives, rules, sharding, simhash, substrings, toxicity, warc
from talkframe.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_table(read(spark, sf, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.scored(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query
def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.judge(read(spark, sf, "documents"))


@query
def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    rows = mixing.mixed_documents(read(spark, sf, "documents"))
    return rows.withColumn("first_position", F.round("first_position", 9))


@query
def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf, "documents"))


@query
def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = leaks.leaked(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 9).alias("similarity"))


@query
def op7_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.extract(read(spark, sf, "pages"))


@query
def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archived(read(spark, sf, "pages"))


@query
def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    rows = lines.without_repeats(docs, lines.LineIndex.of(docs))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


@query
def op10_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.languages(read(spark, sf, "documents"))


@query
def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.manifest(read(spark, sf, "documents"))


@query
def op12_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = substrings.without_repeats(read(spark, sf, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


@query
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.hard_negatives(read(spark, sf, "embeddings"))


def time_sql(share: str, weight: str) -> str:
    """``mixing.training_time`` as SQL."""
    cases = []
    for base, knots in mixing.SCHEDULES.items():
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
        whole, done = sum(areas), 0.0
        for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
            need, slope = f"({share} * {whole!r}::DOUBLE - {done!r}::DOUBLE)", (w1 - w0) / (t1 - t0)
            root = f"sqrt(greatest({w0 * w0!r}::DOUBLE + 2 * {slope!r}::DOUBLE * {need}, 0))"
            done += area
            cases.append(f"WHEN {weight} = {base} AND {share} * {whole!r}::DOUBLE <= {done!r}::DOUBLE THEN least({t0!r}::DOUBLE + 2 * {need} / greatest({w0!r}::DOUBLE + {root}, 1e-12), 1)")
    return f"CASE {' '.join(cases)} ELSE 1 END"


WORDS_SQL = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))"

SQL["op4_mixing"] = f"""
WITH d AS (SELECT doc_id, source, {WORDS_SQL}::BIGINT AS size, md5(concat_ws('|', '17', doc_id::VARCHAR)) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * {mixing.MOST_REPEATS}.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, weight, least(cap, weight * (SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap)) AS target FROM l),
r AS (SELECT doc_id, size, source_size, weight, target,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 1 END AS times
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, times + CASE WHEN 2 * before + size < 2 * (target - times * source_size) THEN 1 ELSE 0 END AS copies FROM r),
p AS (SELECT *, CASE WHEN target > 0 THEN least((before + size / 2) / target, 1) ELSE 0 END AS share FROM c)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::INT AS copies,
  CASE WHEN copies > 0 THEN round({time_sql("share", "weight")}, 9) END AS first_position FROM p"""

TERMS_SQL = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '')"

#: Every window of an item's length, of the documents that share a run of five words with the item.
SQL["op6_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS_SQL} AS w FROM documents),
i AS (SELECT item_id, {TERMS_SQL} AS w FROM benchmark),
ds AS (SELECT r, unnest(generate_series(1, len(w) - 4)) AS p FROM d WHERE len(w) > 4),
dg AS (SELECT ds.r, p, array_to_string(w[p:p + 4], ' ') AS g FROM ds JOIN d USING (r)),
iss AS (SELECT item_id, unnest(generate_series(1, len(w) - 4)) AS p FROM i WHERE len(w) > 4),
ig AS (SELECT iss.item_id, array_to_string(w[p:p + 4], ' ') AS g FROM iss JOIN i USING (item_id)),
ic AS (SELECT item_id, g, count(*) AS n FROM ig GROUP BY ALL),
near AS (SELECT DISTINCT r, item_id FROM dg JOIN ig USING (g)),
win AS (SELECT r, item_id, len(i.w) - 4 AS n, unnest(generate_series(1, greatest(1, len(d.w) - len(i.w) + 1))) AS s FROM near JOIN d USING (r) JOIN i USING (item_id)),
wc AS (SELECT win.r, win.item_id, s, dg.g, count(*) AS n FROM win JOIN dg ON dg.r = win.r AND dg.p >= s AND dg.p < s + win.n GROUP BY ALL),
sim AS (SELECT wc.r, wc.item_id, wc.s, sum(wc.n) AS a, coalesce(sum(least(wc.n, ic.n)), 0) AS common FROM wc LEFT JOIN ic ON ic.item_id = wc.item_id AND ic.g = wc.g GROUP BY ALL),
tot AS (SELECT item_id, sum(n) AS b FROM ic GROUP BY item_id)
SELECT d.doc_id, sim.item_id, round(max(common / (a + b - common))::DOUBLE, 9) AS similarity
FROM sim JOIN tot USING (item_id) JOIN d USING (r) WHERE common / (a + b - common) >= {leaks.SIMILARITY} GROUP BY d.doc_id, sim.item_id"""

BLANKS_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL["op9_line_dedup"] = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
k AS (SELECT *, translate(trim(line, {BLANKS_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
b AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {lines.SHORTEST} GROUP BY key HAVING count(DISTINCT doc_id) >= {lines.DOCUMENTS})
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (b.key IS NOT NULL AND k.doc_id <> b.keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (b.key IS NULL OR k.doc_id = b.keeper), '')) AS kept_sha256
FROM k LEFT JOIN b USING (key) GROUP BY k.doc_id"""

SQL["op12_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
s AS (SELECT r, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) > 34),
g AS (SELECT s.r, s.i, sha256(array_to_string(w[s.i:s.i + 34], ' ')) AS h FROM s JOIN d USING (r)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
m AS (SELECT p.r, p.i, p.word, max(t.i) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM p LEFT JOIN t ON t.r = p.r AND t.i = p.i),
k AS (SELECT r, count(*) AS n, count(*) FILTER (gone) AS lost, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM m GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(lost, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""

#: Trees of DuckDB: levels by recursion, one node per run of two; crc32 bit by bit over the id's digits.
SQL["op11_merkle_manifest"] = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, *, doc_id::VARCHAR AS digits FROM documents),
c AS (SELECT r, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(digits, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT) AS crc FROM d),
f AS (SELECT d.*, crc % 7 = 0 AND n_chars IS NOT NULL AS due FROM d JOIN c USING (r)),
l AS (SELECT r, doc_id, lang, due, {leaf} AS leaf, {forged} AS forged FROM f),
i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
t AS (SELECT lang, 0 AS level, i, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM i
  UNION ALL SELECT lang, level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), any_value((n + 1) // 2) FROM t WHERE n > 1 GROUP BY lang, level, i // 2),
s AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM t WHERE n = 1),
u AS (SELECT 0 AS level, i, subroot AS node, count(*) OVER () AS n FROM s
  UNION ALL SELECT level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), any_value((n + 1) // 2) FROM u WHERE n > 1 GROUP BY level, i // 2),
heights AS (SELECT lang, max(level) AS height FROM t GROUP BY lang),
steps AS (
  SELECT i.r, t.level AS step, i.i >> t.level AS at, o.node FROM i JOIN t ON t.lang IS NOT DISTINCT FROM i.lang AND t.i = i.i >> t.level AND t.n > 1
    LEFT JOIN t o ON o.lang IS NOT DISTINCT FROM i.lang AND o.level = t.level AND o.i = xor(t.i, 1)
  UNION ALL
  SELECT i.r, h.height + u.level, s.i >> u.level, o.node FROM i JOIN s ON s.lang IS NOT DISTINCT FROM i.lang JOIN heights h ON h.lang IS NOT DISTINCT FROM i.lang
    JOIN u ON u.i = s.i >> u.level AND u.n > 1 LEFT JOIN u o ON o.level = u.level AND o.i = xor(u.i, 1)),
proof AS (SELECT r, sha256(coalesce(string_agg(node, '' ORDER BY step), '')) AS proof_sha256 FROM steps GROUP BY r),
way AS (SELECT r, 0 AS step, CASE WHEN due THEN forged ELSE leaf END AS node FROM l
  UNION ALL SELECT way.r, way.step + 1, sha256(CASE WHEN steps.at % 2 = 1 THEN coalesce(steps.node, '') || way.node ELSE way.node || coalesce(steps.node, '') END)
  FROM way JOIN steps ON steps.r = way.r AND steps.step = way.step),
folded AS (SELECT r, arg_max(node, step) AS folded_root FROM way GROUP BY r),
root AS (SELECT node AS root FROM u WHERE n = 1)
SELECT i.doc_id, i.leaf, s.subroot, root.root, coalesce(proof.proof_sha256, sha256('')) AS proof_sha256, folded.folded_root, folded.folded_root = root.root AS verified, 2 * i.i - bit_count(i.i) AS log_position
FROM i JOIN s ON s.lang IS NOT DISTINCT FROM i.lang JOIN folded USING (r) LEFT JOIN proof USING (r), root"""


def hashed_sql(*values: str) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode({v}::VARCHAR)) || ':' || {v}::VARCHAR, '-')" for v in values) + "))"


SQL["op11_merkle_manifest"] = SQL["op11_merkle_manifest"].format(
    leaf=hashed_sql("doc_id", "source", "lang", "n_chars", "text"), forged=hashed_sql("doc_id", "source", "lang", "(n_chars::HUGEINT + 1)", "text")
)

SQL["op13_hard_negatives"] = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, list_inner_product(a.q, x.q)::BIGINT AS score
  FROM v a JOIN v x ON len(a.q) = len(x.q) AND a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""

SQL["op8_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p),
r AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r"""
