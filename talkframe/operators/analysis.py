"""Drafts of an analysis: their shape, and the job that gets them from a user's extractor.

A draft is a struct of nine arrays of strings, one per section. The extractor is any callable
``(system, user, schema) -> dict or JSON string``; it runs inside tasks.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from talkframe.functions import text as X
from talkframe.functions.entities import request_anchors, value_anchors
from talkframe.operators import chunking
from talkframe.operators.values import merge_values
from talkframe.session import cut, runs_in_tasks

runs_in_tasks(__name__)

# Section keys, their headings in order, and what an empty section says.
SECTIONS = {
    "mainRequest": "Ana İstek ve Amaç",
    "contextAndTopics": "Bağlam ve Ana Konular",
    "decisions": "Alınan Kararlar",
    "rejectedOrDeferred": "Reddedilen veya Ertelenen Seçenekler",
    "actionItems": "Aksiyon Maddeleri",
    "questionsAndAnswers": "Sorular ve Cevaplar",
    "risksAndBlockers": "Riskler ve Engelleyiciler",
    "nextSteps": "Sonraki Adımlar",
    "detectedValues": "Tespit Edilen Değerler",
}
EMPTY_SECTION = "Tespit edilmedi."

DRAFT_TYPE = "struct<" + ",".join(f"{k}:array<string>" for k in SECTIONS) + ">"
DRAFT_SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "properties": {k: {"type": "array", "items": {"type": "string"}} for k in SECTIONS},
    "required": list(SECTIONS),
}


# --- drafts --------------------------------------------------------------------------------------


def clean_item(c: Column) -> Column:
    """One line without bullet or raw markup; null when nothing is left.

    Patterns and lower case cost more than all the rest, so only items that can be changed by them meet them.
    """
    bare = lambda x: F.when(F.startswith(x, F.lit("-")) | F.startswith(x, F.lit("*")), F.regexp_replace(x, rf"^[-*]{X.SPACE}+", "")).otherwise(x)
    # The ends are bare by now, so white space around a line break is what a strip of the lines takes away.
    lines = lambda x: F.array_join(F.filter(F.transform(F.split(x, "\n"), X.strip), lambda q: q != ""), " ")
    one_line = lambda x: F.when(F.contains(x, F.lit("\n")), lines(x)).otherwise(x)
    item = X.let(X.let(X.strip(c), bare), one_line)
    item = X.strip(F.replace(F.replace(item, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))
    empty = lambda x: (x == "") | ((F.length(x) == len(EMPTY_SECTION)) & (X.lower_tr(x) == EMPTY_SECTION.lower()))
    return X.let(item, lambda x: F.when(~empty(x), x))


def first_of_each(items: Column) -> Column:
    """Without repeats, case aside. Only a list that has some is sorted for its first places."""

    def first(xs: Column, keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        opens = lambda ps: F.filter(ps, lambda p, j: (j == 0) | (F.get(ps, j - 1)["k"] != p["k"]))
        at = F.sort_array(F.transform(X.let(placed, opens), lambda p: p["i"]))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), xs).otherwise(F.transform(at, lambda i: F.get(xs, i)))

    return X.let(F.array_compact(items), lambda xs: X.let(F.transform(xs, X.lower_tr), lambda keys: first(xs, keys)))


def _section_strings(parsed: Column, key: str) -> Column:
    """Strings of one section of a parsed draft; anything else in it is left out."""
    values = F.try_variant_get(parsed, f"$.{key}", "array<variant>")
    strings = F.transform(values, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return F.coalesce(strings, F.array().cast("array<string>"))


def coerce_draft(raw: Column) -> Column:
    """A draft from JSON: known sections only, items cleaned, repeats dropped.

    The rules stand once in the expression and go over the sections as an array: building and planning them
    nine times over takes seconds each time.
    """
    cleaned = lambda items: first_of_each(F.array_compact(F.transform(items, clean_item)))
    sections = lambda parsed: F.transform(F.array(*[_section_strings(parsed, k) for k in SECTIONS]), cleaned)
    named = lambda each: F.struct(*[F.get(each, F.lit(i)).alias(k) for i, k in enumerate(SECTIONS)])
    return X.let(F.try_parse_json(raw), lambda parsed: X.let(sections(parsed), named))


def serialize_draft(draft: Column) -> Column:
    """Markdown with all nine headings; an empty section says so."""
    parts = []
    for key, title in SECTIONS.items():
        bullets = F.array_join(F.transform(draft[key], lambda x: F.concat(F.lit("- "), x)), "\n")
        body = F.when(F.size(draft[key]) > 0, bullets).otherwise(F.lit(f"- {EMPTY_SECTION}"))
        parts.append(F.concat(F.lit(f"### {title}\n\n"), body))
    return F.concat_ws("\n\n", *parts)


def parse_draft(markdown: Column) -> Column:
    """The draft a markdown text holds; text outside known headings is left out."""
    lines = F.transform(F.split(F.coalesce(markdown, F.lit("")), r"\r?\n"), X.strip)
    heading = rf"^###{X.SPACE}+(.+)$"

    def opened_at(ls: Column, heads: Column) -> Column:
        """Each heading's title with the lines below it; what stands before the first opens no part."""
        until = lambda k: F.coalesce(F.get(heads, k + 1), F.size(ls))
        title = lambda h: F.array(F.regexp_replace(F.get(ls, h), heading, "$1"))
        return F.transform(heads, lambda h, k: F.concat(title(h), F.slice(ls, h + 2, until(k) - h - 1)))

    at = lambda ls: F.array_compact(F.transform(ls, lambda s, i: F.when(F.startswith(s, F.lit("###")) & F.regexp_like(s, F.lit(heading)), i)))
    bullet = rf"^[-*]{X.SPACE}+(.+)$"

    def section(opened: Column, title: str) -> Column:
        mine = F.filter(opened, lambda p: X.strip(p[0]) == title)
        below = F.flatten(F.transform(mine, lambda p: F.slice(p, F.lit(2), F.size(p))))
        marked = F.filter(below, lambda s: F.startswith(s, F.lit("-")) | F.startswith(s, F.lit("*")))
        # A bullet that is taken off leaves a shorter line; a line that stays as it is has none.
        said = lambda s: X.let(F.regexp_replace(s, bullet, "$1"), lambda q: F.when(q != s, clean_item(q)))
        return F.array_compact(F.transform(marked, said))

    headed = X.let(lines, lambda ls: X.let(at(ls), lambda heads: opened_at(ls, heads)))
    return X.let(headed, lambda opened: F.struct(*[section(opened, title).alias(key) for key, title in SECTIONS.items()]))


def draft_items(drafts: DataFrame, keys: list[str], draft: str = "draft") -> DataFrame:
    """Long form: ``(*keys, section_idx, section_key, item_idx, item)``."""
    sections = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.col(draft)[k].alias("items")) for i, k in enumerate(SECTIONS)])
    each = drafts.select(*keys, F.explode(sections).alias("s"))
    return each.select(
        *keys, F.col("s.i").alias("section_idx"), F.col("s.k").alias("section_key"), F.posexplode("s.items").alias("item_idx", "item")
    )


def section_counts(drafts: DataFrame, keys: list[str], draft: str = "draft") -> DataFrame:
    """Items per section, empty sections included, with the filled sections and items of the whole draft."""
    sizes = [F.size(F.col(draft)[k]) for k in SECTIONS]
    counts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), n.alias("n")) for (i, k), n in zip(enumerate(SECTIONS), sizes)])
    filled = sum((n > 0).cast("int") for n in sizes)
    each = drafts.select(*keys, filled.alias("filled_sections"), sum(sizes).alias("total_items"), F.explode(counts).alias("s"))
    return each.select(
        *keys, F.col("s.i").alias("section_idx"), F.col("s.k").alias("section_key"), F.col("s.n").alias("items"), "filled_sections", "total_items"
    )


def replace_section(draft: Column, key: str, items: Column) -> Column:
    """The draft with one section replaced; blank items are dropped."""
    if key not in SECTIONS:
        raise ValueError(f"unknown section: {key}")
    fresh = F.filter(F.transform(items, X.strip), lambda x: x != "")
    return F.struct(*[(fresh if k == key else draft[k]).alias(k) for k in SECTIONS])


_ATTRIBUTION = rf"(?iu){X.SPACE}*\((?:konuşmacı|speaker){X.SPACE}*:[^)]+\)\.?{X.SPACE}*$"


def move_unlabeled_actions(draft: Column, transcript: Column) -> Column:
    """Without speaker labels in the transcript nobody can own an action: such items become next steps."""
    named = F.lit(_ATTRIBUTION)
    owned = F.filter(draft["actionItems"], lambda x: F.regexp_like(x, named))
    cleaned = F.transform(owned, lambda x: X.strip(F.regexp_replace(x, _ATTRIBUTION, "")))
    moved = first_of_each(F.filter(cleaned, lambda x: x != ""))
    known = F.transform(draft["nextSteps"], X.lower_tr)
    fresh = X.let(known, lambda ks: F.filter(moved, lambda x: ~F.array_contains(ks, X.lower_tr(x))))
    changed = {
        "actionItems": F.filter(draft["actionItems"], lambda x: ~F.regexp_like(x, named)),
        "nextSteps": F.concat(draft["nextSteps"], fresh),
    }
    fixed = F.struct(*[changed.get(k, draft[k]).alias(k) for k in SECTIONS])
    return F.when(X.has_line_labels(transcript), draft).otherwise(fixed)


# --- the extractor -------------------------------------------------------------------------------

Extractor = Callable[[str, str, dict], object]


class ExtractorError(Exception):
    """A failed call; ``retryable`` ones (busy, server fault, timeout) are tried again."""

    def __init__(self, message: str, retryable: bool = False):
        super().__init__(message)
        self.retryable = retryable


def call_with_retry(fn: Extractor, system: str, user: str, retries: int, backoff_s: float) -> tuple[str | None, str | None]:
    """``(json, None)`` or ``(None, error)``; waits k back-offs before the k-th retry."""
    for attempt in range(retries + 1):
        try:
            out = fn(system, user, DRAFT_SCHEMA)
            return (out if isinstance(out, str) else json.dumps(out, ensure_ascii=False)), None
        except Exception as e:  # noqa: BLE001 - one row's failure must not fail the job
            again = getattr(e, "retryable", False) or isinstance(e, TimeoutError)
            if not again or attempt == retries:
                return None, str(e) or type(e).__name__
            time.sleep(backoff_s * (attempt + 1))
    return None, "no attempt made"


def ask(prompts: DataFrame, fn: Extractor, system: str, retries: int = 2, backoff_s: float = 0.25) -> DataFrame:
    """Call the extractor on each row's ``prompt``; adds ``raw`` and ``error``.

    Calls run one after the other in a task, so running tasks bound the calls in flight.
    """
    out_schema = StructType([*prompts.schema.fields, StructField("raw", StringType()), StructField("error", StringType())])

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            answers = [call_with_retry(fn, system, p, retries, backoff_s) for p in pdf["prompt"]]
            yield pdf.assign(raw=[a[0] for a in answers], error=[a[1] for a in answers])

    return prompts.mapInPandas(run, schema=out_schema)


CALLS = "key string, raw string, error string, called_at timestamp"


def call_log(spark: SparkSession, path: str) -> DataFrame:
    """Answers kept so far, one row per prompt: its latest answer, else its latest error."""
    try:
        rows = spark.read.schema(CALLS).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], CALLS)
    answered = F.when(F.col("raw").isNotNull(), F.col("called_at"))
    return rows.groupBy("key").agg(F.max_by("raw", answered).alias("raw"), F.max_by("error", "called_at").alias("error")).withColumn("error", F.when(F.col("raw").isNull(), F.col("error")))


def ask_once(prompts: DataFrame, fn: Extractor, system: str, log: str, batch: int, tasks: int | None = None, retries: int = 2, backoff_s: float = 0.25) -> DataFrame:
    """``ask`` over a log of calls below ``log``: a prompt that has an answer there is not called again.

    Equal prompts are one call. What has no answer yet is called batch by batch, and a batch's answers
    are in the log before the next begins; a job that dies loses the calls of one batch. Errors are logged
    too, and tried again by the next job.
    """
    spark = prompts.sparkSession
    keyed = cut(prompts.withColumn("_key", F.sha2(F.concat(F.lit(system), F.lit("\x00"), F.col("prompt")), 256)))
    done = call_log(spark, log).filter(F.col("raw").isNotNull()).select(F.col("key").alias("_key"))
    pending = cut(keyed.groupBy("_key").agg(F.min("prompt").alias("prompt")).join(done, "_key", "left_anti"))
    batches = -(-pending.count() // batch)
    for b in range(batches):
        part = pending.filter(F.pmod(F.xxhash64("_key"), F.lit(batches)) == b)
        part = part.repartition("_key") if tasks is None else part.repartition(tasks, "_key")
        answers = ask(part, fn, system, retries, backoff_s)
        answers.select(F.col("_key").alias("key"), "raw", "error", F.current_timestamp().alias("called_at")).write.mode("append").parquet(log)
    told = call_log(spark, log).withColumnRenamed("key", "_key")
    return keyed.join(told, "_key").drop("_key")


# --- the job -------------------------------------------------------------------------------------


def _bullets(items: Column, none: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit(none))


@dataclass(frozen=True)
class AnalysisConfig:
    """Budgets of an extractor, and the wording of its prompts, which is the caller's to choose."""

    num_ctx: int = 8192
    chunk_tokens: int = 2200
    chunk_overlap_tokens: int = 180
    chars_per_token: float = 3.5
    concurrency: int | None = None
    retries: int = 2
    backoff_s: float = 0.25
    system: str = "Return the nine sections as arrays of strings, supported by the text only."
    whole_intro: str = "Transcript:"
    part_intro: str = "Transcript part:"
    merge_intro: str = "Merge these partial drafts:"
    reserve: int = field(default=4096)
    #: Folder of the log of calls, and how many calls are made between two writes to it.
    log: str | None = None
    log_batch: int = 2000

    def request_tokens(self, prompt_chars: Column) -> Column:
        return F.ceil((prompt_chars + len(self.system)) / self.chars_per_token) + self.reserve

    @property
    def max_chunk_tokens(self) -> int:
        system_tokens = -(-len(self.system) // 1) / self.chars_per_token
        return max(128, min(self.chunk_tokens, self.num_ctx - self.reserve - int(-(-system_tokens // 1)) - 512))

    @property
    def overlap(self) -> int:
        return min(self.chunk_overlap_tokens, self.max_chunk_tokens // 4)


def anchor_block(requests: Column, values: Column) -> Column:
    return F.concat(F.lit("Requests:\n"), _bullets(requests, "- none"), F.lit("\n\nValues:\n"), _bullets(values, "- none"), F.lit("\n\n"))


def plan(docs: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Adds anchors, the one-call prompt, and whether it fits: ``requests, values, prompt, single_pass``."""
    anchored = docs.withColumn("requests", request_anchors(F.col("text"))).withColumn("values", value_anchors(F.col("text")))
    prompt = F.concat(anchor_block(F.col("requests"), F.col("values")), F.lit(config.whole_intro + "\n"), X.strip(F.col("text")))
    prompted = anchored.withColumn("prompt", prompt)
    return prompted.withColumn("single_pass", config.request_tokens(F.length("prompt")) <= config.num_ctx)


def merge_prompt(partials: Column, anchors: Column, config: AnalysisConfig) -> Column:
    numbered = F.transform(partials, lambda p, i: F.concat(F.lit("--- Partial "), (i + 1).cast("string"), F.lit(" ---\n"), p))
    return F.concat(F.lit(config.merge_intro + "\n\n"), anchors, F.array_join(numbered, "\n\n"))


def pack_groups(costs: Column, base: int, config: AnalysisConfig) -> Column:
    """Group number for each cost in order: a group closes when the next draft would not fit."""
    start = F.struct(F.array().cast("array<int>").alias("groups"), F.lit(0).alias("group"), F.lit(0).cast("bigint").alias("used"))

    def step(acc: Column, cost: Column) -> Column:
        grown = acc["used"] + cost
        fits = (acc["used"] == 0) | (config.request_tokens(grown + base) <= config.num_ctx)
        group = F.when(fits, acc["group"]).otherwise(acc["group"] + 1)
        used = F.when(fits, grown).otherwise(cost)
        return F.struct(F.concat(acc["groups"], F.array(group)).alias("groups"), group.alias("group"), used.alias("used"))

    return F.aggregate(costs, start, step, lambda acc: acc["groups"])


def _ask(prompts: DataFrame, fn: Extractor, config: AnalysisConfig, *keys: str) -> DataFrame:
    if config.log is not None:
        return ask_once(prompts, fn, config.system, config.log, config.log_batch, config.concurrency, config.retries, config.backoff_s)
    return ask(_spread(prompts, config, *keys), fn, config.system, config.retries, config.backoff_s)


def _answer(asked: DataFrame, keys: list[str]) -> DataFrame:
    return asked.select(*keys, coerce_draft(F.col("raw")).alias("draft"), "error")


def reduce_drafts(drafts: DataFrame, docs: DataFrame, fn: Extractor, config: AnalysisConfig) -> DataFrame:
    """Merge the partial drafts ``(doc_id, draft_idx, draft, error)`` of each document into one.

    A document is done when all its drafts fit one call together with its anchors. Until then
    neighbours are merged group by group; a lone draft passes through. Where no two drafts fit
    together one larger call ends it. Every round merges a pair of each open document, so the
    rounds end. Only the size of each draft is gathered per document; the
    drafts of a group meet in the task that merges them, which the budget bounds.
    """
    anchors = docs.select("doc_id", anchor_block(F.col("requests"), F.col("values")).alias("_anchors"))
    base = len(config.merge_intro) + 2 + 60
    finished: list[DataFrame] = []
    # The rounds share their expressions, which take longer to build than a late round's few rows to work off.
    printed, read_back = serialize_draft(F.col("draft")).alias("markdown"), coerce_draft(F.col("raw")).alias("draft")
    partials = F.transform("_m", lambda m: m["markdown"])
    shown = F.when(F.col("last"), F.col("_anchors")).otherwise(anchor_block(F.array(), F.array()))
    asked_for = merge_prompt(partials, shown, config).alias("prompt")
    cost = (F.length("markdown") + 22).cast("bigint")
    packed = pack_groups(F.transform("_s", lambda s: s["cost"]), base, config).alias("_g")
    current = cut(drafts.select("*", printed))
    while True:
        sizes = current.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("draft_idx", cost.alias("cost")))).alias("_s"))
        grouped = sizes.join(anchors, "doc_id").select(
            "doc_id",
            F.transform("_s", lambda s: s["draft_idx"]).alias("_idx"),
            packed,
            (F.aggregate("_s", F.lit(0).cast("bigint"), lambda a, s: a + s["cost"]) + F.length("_anchors")).alias("_chars"),
        )
        fits = config.request_tokens(F.col("_chars") + base) <= config.num_ctx
        alone = F.array_max("_g") + 1 == F.size("_g")
        planned = grouped.withColumn("last", fits | alone).select("doc_id", "last", F.explode(F.arrays_zip("_idx", "_g")).alias("z"))
        placed = planned.select("doc_id", "last", F.col("z._idx").alias("draft_idx"), F.when(F.col("last"), 0).otherwise(F.col("z._g")).alias("group"))
        gathered = (
            current.join(placed, ["doc_id", "draft_idx"])
            .groupBy("doc_id", "group", "last")
            .agg(
                F.array_sort(F.collect_list(F.struct("draft_idx", "markdown"))).alias("_m"),
                F.max("error").alias("_e"),
                F.max_by("draft", -F.col("draft_idx")).alias("_d"),
            )
            .join(anchors, "doc_id")
        )
        needed = F.col("last") | (F.size("_m") > 1)
        calls = gathered.filter(needed).select("doc_id", "group", "last", "_e", asked_for)
        asked = _ask(calls, fn, config, "doc_id", "group")
        merged = asked.select("doc_id", "group", "last", read_back, F.coalesce("error", "_e").alias("error"))
        passed = gathered.filter(~needed).select("doc_id", "group", "last", F.col("_d").alias("draft"), F.col("_e").alias("error"))
        # Answers of an outside service are not repeatable, so they are kept before they are used twice.
        result = cut(merged.unionByName(passed))
        finished.append(result.filter(F.col("last")).select("doc_id", "draft", "error"))
        rest = result.filter(~F.col("last"))
        if rest.isEmpty():
            break
        current = cut(rest.select("doc_id", F.col("group").alias("draft_idx"), "draft", "error", printed))
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out


def _spread(prompts: DataFrame, config: AnalysisConfig, *keys: str) -> DataFrame:
    """Prompts over tasks by their size, or over as many as ``concurrency`` asks for where a service allows no more calls at once."""
    return prompts.repartition(*keys) if config.concurrency is None else prompts.repartition(config.concurrency, *keys)


def analyze(docs: DataFrame, fn: Extractor, config: AnalysisConfig | None = None) -> DataFrame:
    """Analyses of ``docs(doc_id, text)``: ``(doc_id, status, draft, markdown, error)``.

    Texts that fit one call take one; longer ones are cut, extracted part by part and merged. A
    failed call leaves its document with an error and without an analysis. A null text counts as empty.
    With ``config.log`` answers outlive the job: one that is started again calls only what has none.
    """
    config = config or AnalysisConfig()
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    planned = cut(plan(docs, config))
    direct = _answer(_ask(planned.filter(F.col("single_pass")).select("doc_id", "prompt"), fn, config, "doc_id"), ["doc_id"])

    long = planned.filter(~F.col("single_pass"))
    chunks = chunking.chunk_rows(long.select("doc_id", "text"), config.max_chunk_tokens, config.overlap, config.chars_per_token)
    head = F.concat(F.lit(config.part_intro + " "), (F.col("chunk_idx") + 1).cast("string"), F.lit("/"), F.col("n_chunks").cast("string"), F.lit("\n"))
    prompts = chunks.select("doc_id", F.col("chunk_idx").alias("draft_idx"), F.concat(head, F.col("chunk")).alias("prompt"))
    parts = _ask(prompts, fn, config, "doc_id", "draft_idx")
    mapped = _answer(parts, ["doc_id", "draft_idx"])
    reduced = reduce_drafts(mapped, long, fn, config)
    return finish(planned, cut(direct).unionByName(reduced))


def finish(planned: DataFrame, drafts: DataFrame) -> DataFrame:
    """Ground the values, move unowned actions, print; a draft with an error has no analysis."""
    joined = planned.select("doc_id", "text", "values").join(drafts, "doc_id")
    draft = F.col("draft")
    grounded = F.struct(
        *[
            (merge_values(draft[k], F.col("values"), X.match_form(F.col("text"))) if k == "detectedValues" else draft[k]).alias(k)
            for k in SECTIONS
        ]
    )
    fixed = joined.withColumn("draft", grounded).withColumn("draft", move_unlabeled_actions(F.col("draft"), F.col("text")))
    good = F.col("error").isNull()
    return fixed.select(
        "doc_id",
        F.when(good, "success").otherwise("failed").alias("status"),
        F.when(good, F.col("draft")).alias("draft"),
        F.when(good, serialize_draft(F.col("draft"))).alias("markdown"),
        "error",
    )


def extractive(system: str, user: str, schema: dict) -> dict:
    """A deterministic extractor for trials: it quotes the text and invents nothing."""
    body = user.rsplit("\n", 1)[-1] if user.count("\n") < 2 else user
    sentences = [s.strip() for s in body.replace("\n", ". ").split(". ") if s.strip()]
    values = [w.strip(".,") for w in body.split() if any(ch.isdigit() for ch in w)]
    return {
        "mainRequest": sentences[:1],
        "contextAndTopics": sentences[1:3],
        "questionsAndAnswers": [s for s in sentences if s.endswith("?")][:3],
        "detectedValues": [f"value: {v}" for v in values[:3]],
    }
