"""Series, scores and results in files: CSV by position, score files by line, JSON parameters, Parquet for the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsquorum.functions.scalar import canonical_params
from tsquorum.sources import schemas


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, dataset_id, no, line): whole files, so that line numbers hold; the id is the MD5 of the content."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    lines = F.split(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"\n+\z", ""), "\n")
    return raw.select("path", F.md5("content").alias("dataset_id"), F.posexplode(lines).alias("no", "line"))


def read_series(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(series_id, name, t, value, is_anomaly): the second column is the value, the last one the label (0/1, also as a
    float or a word); t counts the rows. series_id is the MD5 of the file. A first line without a number is a header."""
    lines = _lines(spark, path).where(F.length("line") > 0)
    number = lambda at: F.expr(f"try_cast(trim(element_at(_c, {at})) AS double)")
    marked = F.lower(F.trim(F.element_at("_c", -1))).isin("true", "yes") | (number(-1) > 0)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.csv)?$", 1)
    parsed = lines.withColumn("_c", F.split("line", ",")).select(F.col("dataset_id").alias("series_id"), name.alias("name"), "no", number(2).alias("value"), marked.alias("y"))
    first = parsed.groupBy("series_id").agg(F.min_by(F.struct("value"), "no").alias("_v"), F.min("no").alias("_no"))
    rows = parsed.join(first, "series_id").withColumn("_shift", F.when(F.col("_v.value").isNull(), 1).otherwise(0))
    return rows.where(F.col("no") >= F.col("_no") + F.col("_shift")).select("series_id", "name", (F.col("no") - F.col("_no") - F.col("_shift")).cast("long").alias("t"), "value", F.coalesce("y", F.lit(False)).alias("is_anomaly"))


def content_hash(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, hexhash)."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("hexhash"))


def series_from(df: DataFrame, value: str, label: str, order: str, name: str) -> DataFrame:
    """A series from any frame; rows are numbered in the given order."""
    from pyspark.sql import Window

    t = (F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(order)) - 1).cast("long")
    return df.select(F.lit(name).alias("series_id"), t.alias("t"), F.col(value).cast("double").alias("value"), F.col(label).cast("boolean").alias("is_anomaly"))


def write_series(series: DataFrame, path: str) -> None:
    """A folder per series with CSV files timestamp,value,is_anomaly in order of time."""
    out = series.select("series_id", F.col("t").alias("timestamp"), "value", F.col("is_anomaly").cast("int").alias("is_anomaly"))
    out.repartition("series_id").sortWithinPartitions("series_id", "timestamp").write.partitionBy("series_id").option("header", True).mode("overwrite").csv(path)


def read_scores(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(dataset_id, instance, t, score) from files with a score per line, named <dataset>-<algorithm>-<params>.csv."""
    name = F.regexp_extract("path", r"([^/]+?)\.csv$", 1)
    lines = _lines(spark, path)
    return lines.select(F.split_part(name, F.lit("-"), F.lit(1)).alias("dataset_id"), F.regexp_extract(name, r"^[^-]+-(.*)$", 1).alias("instance"), F.col("no").cast("long").alias("t"), F.expr("try_cast(line AS double)").alias("score"))


def write_scores(scores: DataFrame, path: str) -> None:
    scores.repartition("dataset_id", "instance").sortWithinPartitions("dataset_id", "instance", "t").write.partitionBy("dataset_id", "instance").mode("overwrite").parquet(path)


def load_scores(spark: SparkSession, path: str, dataset_id: str, instances: list[str]) -> DataFrame:
    """Scores of some instances: partition pruning reads only theirs."""
    read = spark.read.schema(schemas.SCORES).parquet(path)
    return read.where((F.col("dataset_id") == dataset_id) & F.col("instance").isin(instances))


def write_results(results: DataFrame, path: str) -> None:
    """CSV with parameters (a map) as sorted JSON."""
    results.withColumn("params", canonical_params(F.col("params"))).write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.schema(schemas.RESULTS).option("header", True).option("escape", '"').csv(path)
    return read.withColumn("params", F.from_json("params", "map<string,string>"))


def append_trace(trace: DataFrame, path: str) -> None:
    """Traces are appended; every write makes files of its own names."""
    trace.write.mode("append").parquet(path)


def trace_entries(trace: DataFrame) -> DataFrame:
    """(timer, depth, duration_ns): ended timers; nested names are joined by -%-."""
    ended = trace.where("type = 'END'")
    return ended.select("timer", (F.size(F.split("timer", "-%-")) - 1).cast("long").alias("depth"), "duration_ns")
