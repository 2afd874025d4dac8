"""Finding a folder's band files, and a scene's date, from names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.errors import AnalysisError


WANTED = ("B02", "B03", "B04")
#: A band token is not part of a longer run of letters and digits; a date is 20 and six digits. Fixed patterns and names.
TOKEN = r"(?i)(?<![A-Za-z0-9])(B0[2348]|B8A)(?![A-Za-z0-9])"


class DiscoveryError(AnalysisError):
    """A folder lacks a band, or has it twice."""


def date_label(folder: Column) -> Column:
    """The date in a folder's name, or else the name."""
    return F.coalesce(F.nullif(F.regexp_extract(folder, r"(20[0-9]{6})", 1), F.lit("")), folder)


def _tokens(stem: Column) -> Column:
    """The bands that a name holds, each once."""
    return F.array_distinct(F.regexp_extract_all(F.upper(stem), F.lit(TOKEN), 1))


def band_table(names: DataFrame, wanted: tuple[str, ...] = WANTED) -> DataFrame:
    """(folder, band, n, status) for each wanted band of each folder, from (folder, name)."""
    files = names.where(F.lower("name").rlike("[.](tif|tiff|jp2)$"))
    stem = F.regexp_replace("name", "[.][^.]*$", "")
    found = files.select("folder", F.explode(_tokens(stem)).alias("band"))
    every = names.select("folder").distinct().select("folder", F.explode(F.array(*[F.lit(b) for b in wanted])).alias("band"))
    out = every.join(found.groupBy("folder", "band").agg(F.count("*").alias("n")), ["folder", "band"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.withColumn("status", F.when(F.col("n") == 0, "missing").when(F.col("n") > 1, "duplicate").otherwise("ok"))


def discover(spark: SparkSession, folder: str, wanted: tuple[str, ...] = WANTED) -> dict[str, str]:
    """The path of each wanted band's file; an error where one is missing or there are two."""
    files = spark.read.format("binaryFile").load(folder).select("path").select(F.lit(folder).alias("folder"), "path", F.element_at(F.split("path", "/"), -1).alias("name"))
    bad = band_table(files, wanted).where("status <> 'ok'").orderBy("band").collect()
    if bad:
        raise DiscoveryError("; ".join(f"{r['band']}: {r['status']}" for r in bad))
    stem = F.regexp_replace("name", "[.][^.]*$", "")
    rows = files.where(F.lower("name").rlike("[.](tif|tiff|jp2)$")).select("path", F.explode(_tokens(stem)).alias("band"))
    return {r["band"]: r["path"] for r in rows.where(F.col("band").isin(*wanted)).collect()}
