"""Run outputs, promoted references and the registry of references, read from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.functions import text as X
from talkframe.operators.quality import summary_lines
from talkframe.operators.runs import config_id
from talkframe.sources.meetings import SEGMENT_TYPE

RUN_SCHEMA = (
    "file string, recordingType string, outputType string, text string, error string, "
    "config struct<model:string,dtype:string,mode:string>, analyzer struct<model:string>, "
    "metrics struct<rtf:double,transcribeMs:bigint,audioSec:double,loadMs:bigint,peakRssMB:double,diskMB:double,wer:double,"
    "werRefTokens:bigint,referencePath:string,domainRecall:struct<terms:array<struct<term:string,present:boolean>>,found:bigint,total:bigint,recall:double>,"
    "duplicateFlags:bigint,overlapFlags:bigint,hallucinationSentences:bigint>, "
    f"segments array<{SEGMENT_TYPE}>"
)

# The two ways run files are named.
_NAMED_BY_CONFIG = r"^(.+)__(.+)\.json$"
_NAMED_BY_KIND = r"^(.+)_((?:live-)?(?:transcribe|analyze))\.json$"


def parse_run_files(files: DataFrame, kind: str, root: str) -> DataFrame:
    """Run rows of ``files`` that carry ``path`` beside the run's JSON fields.

    A name is ``<config>__<scenario>.json`` or ``<scenario>_[live-]<type>.json``. The type comes from
    the folder, then the JSON, then the name; the recording type from the JSON, else static; the
    configuration from the name, else from the JSON.
    """
    relative = F.regexp_replace(F.col("path"), "^.*?" + _quoted(root.rstrip("/")) + "/", "")
    parts = F.split(relative, "/")
    name = F.element_at(parts, -1)
    folder = F.get(parts, F.size(parts) - 2)
    by_config, by_kind = F.regexp_like(name, F.lit(_NAMED_BY_CONFIG)), F.regexp_like(name, F.lit(_NAMED_BY_KIND))
    folder_type = F.when(folder.isin("transcribe", "analyze"), folder)
    spelled = F.when(F.endswith(F.regexp_extract(name, _NAMED_BY_KIND, 2), F.lit("analyze")), "analyze").otherwise("transcribe")
    known_type = F.when(F.col("outputType").isin("transcribe", "analyze"), F.col("outputType"))
    derived = F.coalesce(config_id(F.col("config.model"), F.col("config.dtype"), F.col("config.mode")), F.col("analyzer.model"), F.lit("unknown"))
    depth = F.size(parts)
    # <run>/<file>, <run>/<type>/<file> and <run>/live/<type>/<file> are run files; anything else is not.
    placed = (depth == 2) | ((depth == 3) & folder_type.isNotNull()) | ((depth == 4) & (F.get(parts, F.lit(1)) == "live") & folder_type.isNotNull())
    return files.filter(placed & (by_config | by_kind) & ~((depth == 2) & name.isin("summary.json", "summary.md"))).select(
        F.lit(kind).alias("kind"),
        F.get(parts, F.lit(0)).alias("run_id"),
        F.when(by_config, F.regexp_extract(name, _NAMED_BY_CONFIG, 1)).otherwise(derived).alias("config_id"),
        F.when(by_config, F.regexp_extract(name, _NAMED_BY_CONFIG, 2)).otherwise(F.regexp_extract(name, _NAMED_BY_KIND, 1)).alias("scenario"),
        F.when(F.col("recordingType") == "live", "live").otherwise("static").alias("recording_type"),
        F.when(by_config, F.coalesce(folder_type, known_type, F.lit("transcribe"))).otherwise(spelled).alias("output_type"),
        relative.alias("path"),
        "text",
        "segments",
        "metrics",
    )


def _quoted(path: str) -> str:
    return "".join("\\" + ch if ch in r".*+?^${}()|[]\-" else ch for ch in path)


def _read(spark: SparkSession, root: str) -> DataFrame:
    df = (
        spark.read.schema(RUN_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    )
    return df.withColumn("path", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/"))


def scan_runs(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return parse_run_files(_read(spark, root), kind, root)


def scan_references(spark: SparkSession, root: str) -> DataFrame:
    """Promoted references lie one level higher than runs; they get a run id of their own."""
    files = _read(spark, root)
    deeper = files.withColumn("path", F.regexp_replace("path", _quoted(root.rstrip("/")) + "/", root.rstrip("/") + "/control-group/"))
    rows = parse_run_files(deeper, "control", root)
    return rows.withColumn("path", F.regexp_replace("path", "^control-group/", ""))


def parse_registry(lines: DataFrame) -> DataFrame:
    """References named by a markdown table's ``value`` lines: ``(scenario, kind, recording_type, path)``.

    Prose, the header and the separator are passed over, and so are empty cells.
    """
    line = X.strip(F.col("value"))
    cells = F.transform(F.split(F.regexp_replace(F.regexp_replace(line, r"^\|", ""), r"\|$", ""), r"\|"), X.strip)
    rows = lines.filter(F.startswith(line, F.lit("|"))).select(cells.alias("c")).withColumn("scenario", F.get("c", F.lit(0)))
    rows = rows.filter((F.col("scenario") != "") & ~F.regexp_like("scenario", F.lit(r"^:?-{3,}:?$")) & (F.lower("scenario") != "dosya"))
    columns = [("transcribe", "static"), ("analyze", "static"), ("transcribe", "live"), ("analyze", "live")]
    each = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.lit(r).alias("recording_type"), F.get("c", F.lit(i + 1)).alias("path")) for i, (k, r) in enumerate(columns)]
    )
    named = rows.select("scenario", F.explode(each).alias("e")).select("scenario", "e.*")
    return named.filter(F.col("path").isNotNull() & ~F.col("path").isin("", "-", "—"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry file; a missing one is an empty registry."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return parse_registry(spark.createDataFrame([], "value string"))
    return parse_registry(spark.read.text(path))


def write_summary(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metric rows as a table and as printed lines, in the order of configuration and scenario."""
    metrics.write.mode(mode).parquet(f"{path}/metrics")
    keys = ["config_id", "recording_type", "scenario"]
    lines = summary_lines(metrics).repartitionByRange(*keys).sortWithinPartitions(*keys)
    lines.select(F.col("line").alias("value")).write.mode(mode).text(f"{path}/summary")
