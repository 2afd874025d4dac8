"""What runs leave behind, read back: lines of progress, manifests and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of lines. Fixed values.
KINDS = ("progress", "info", "warning", "error", "result")


def progress(spark: SparkSession, path: str) -> DataFrame:
    """(type, stage, message, percent, manifest) of each line of JSON in a file or folder, in no order of its own. What is
    not JSON or of no known kind is left out; a line without a type is an info, one without a percentage stands at 0."""
    fields = "type string, stage string, message string, percent double, manifest string, _bad string"
    rows = spark.read.schema(fields).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.where(F.col("_bad").isNull())
    return rows.select(
        F.coalesce("type", F.lit("info")).alias("type"), F.coalesce("stage", F.lit("")).alias("stage"), F.coalesce("message", F.lit("")).alias("message"),
        F.coalesce("percent", F.lit(0.0)).alias("percent"), "manifest",
    ).where(F.col("type").isin(*KINDS))


def runs(spark: SparkSession, path: str) -> DataFrame:
    """A row for each manifest ``path`` matches (a file, a folder's glob): run_id, before_date, after_date, output_dir,
    runtime_seconds, output_paths (a map), and the summary beside it as JSON, null where there is none."""
    name = F.col("_metadata.file_path")
    folder = F.regexp_replace(name, r"/[^/]*\z", "")
    fields = "run_id string, before_date string, after_date string, runtime_seconds double, output_paths map<string,string>"
    told = spark.read.schema(fields).json(path, multiLine=True).withColumn("output_dir", folder)
    beside = [f"{r[0]}/summary.json" for r in told.select("output_dir").distinct().toLocalIterator()]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    beside = [p for p in beside if hadoop.Path(p).getFileSystem(conf).exists(hadoop.Path(p))]
    columns = ["run_id", "before_date", "after_date", "output_dir", F.coalesce("runtime_seconds", F.lit(0.0)).alias("runtime_seconds"), "output_paths"]
    if not beside:
        return told.select(*columns, F.lit(None).cast("string").alias("summary"))
    summaries = spark.read.text(beside, wholetext=True).select(folder.alias("output_dir"), F.col("value").alias("summary"))
    return told.join(summaries, "output_dir", "left").select(*columns, "summary")
