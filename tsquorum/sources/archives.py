"""Result backups (tar.gz) and baseline folders, read by tasks and loaded into the store.

An archive is streamed by one task: its bytes are inflated as they come, its members gone through in order, their rows handed on in
small batches; nothing is unpacked to disk. Loading is one job per table for any number of archives.

Fixed values: the names of the members and their columns, of the metrics, and of the settings that don't identify a configuration.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import posixpath
import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsquorum.functions.scalar import name_timestamp
from tsquorum.sources.store import Store

CONFIG, VERSION, RESULTS, METRICS, CLEANING, TRACE = "config.json", "version.txt", "execution-results.csv", "metrics.csv", "cleaning-metrics.json", "runtimes.csv"
SCORES, RANKINGS, INSTANCES = "scores", "rankings", "selected-instances.csv"
METRIC_COLUMNS = {
    "PrAUC": "pr_auc", "RocAUC": "roc_auc", "RangePrAUC": "range_pr_auc", "RangeRocAUC": "range_roc_auc", "RangePrVUS": "range_pr_vus", "RangeRocVUS": "range_roc_vus", "PrecisionAtK": "precision_at_k",
    "RangePrecision": "range_precision", "RangeRecall": "range_recall", "RangeFScore": "range_fscore", "Precision": "precision", "Recall": "recall", "FScore": "fscore",
}
#: Settings of a run's place and output.
PASSING = {
    "general": ("cache_key", "tmp_path", "result_path", "TIMESTAMP", "algorithm_selection_method", "score_normalization_method", "score_aggregation_method", "plot_final_scores", "compute_all_combinations"),
    "consolidation": ("plot",),
}
BATCH = 5000


class ArchiveError(ValueError):
    """An archive that can't be read, or lacks what every archive has."""


def settings_id(text: str) -> tuple[str, str]:
    """(id, canonical text) of JSON settings: the MD5 of their sorted text."""
    canonical = json.dumps(json.loads(text), sort_keys=True)
    return hashlib.md5(canonical.encode()).hexdigest(), canonical


def _clean_config(text: str) -> str:
    config = {k: v for k, v in json.loads(text).items() if k != "data_gen_plotting"}
    return json.dumps({k: {a: b for a, b in v.items() if a not in PASSING.get(k, ())} if isinstance(v, dict) else v for k, v in config.items()}, sort_keys=True)


def member_rows(name: str, source: io.BufferedIOBase) -> Iterator[tuple[int, dict | None, str | None]]:
    """(number, fields, text) of a member: a row per CSV row with its header's names; a line a row for scores; other texts whole."""
    text = (line.decode() for line in source)
    if name.startswith(f"{SCORES}/"):
        for no, line in enumerate(text):
            yield no, None, line.strip()
    elif name.endswith(".csv"):
        for no, row in enumerate(csv.DictReader(text)):
            fields = {k if k else "name": v for k, v in row.items() if k is not None and v not in (None, "")}
            if "params" in fields:
                fields["params_id"], fields["params"] = settings_id(fields["params"])
            yield no, fields, None
    else:
        whole = "".join(text)
        yield 0, None, _clean_config(whole) if name == CONFIG else whole


def wanted(name: str) -> bool:
    return name in (CONFIG, VERSION, RESULTS, METRICS, CLEANING, TRACE) or re.fullmatch(rf"{SCORES}/[^/]+\.csv|{RANKINGS}/[^/]+/{re.escape(INSTANCES)}", name) is not None


def read_archives(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(archive, member, no, fields, text): the rows of the members of tar.gz archives, see ``member_rows``; an archive per task.

    ``archive`` is the file's name without its ending. Members that aren't known, folders and links are skipped. A damaged archive raises ArchiveError.
    """
    listed = spark.read.format("binaryFile").load(paths).select("path")  # the column of contents isn't read
    schema = "archive string, member string, no bigint, fields map<string,string>, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string()]
            columns = [*zip(*rows, strict=True)]
            columns[3] = [None if f is None else list(f.items()) for f in columns[3]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["archive", "member", "no", "fields", "text"])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", path))
                archive, rows = re.sub(r"\.tar\.gz$|\.tgz$", "", posixpath.basename(path)), []
                try:
                    with store.open_input_stream(at, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|gz") as tar:
                        for member in tar:
                            name = posixpath.normpath(member.name).lstrip("/")
                            if not member.isfile() or not wanted(name):
                                continue
                            for row in member_rows(name, tar.extractfile(member)):
                                rows.append((archive, name, *row))
                                if len(rows) >= BATCH:
                                    yield packed(rows)
                                    rows = []
                except (tarfile.TarError, EOFError, OSError, UnicodeDecodeError, json.JSONDecodeError) as e:
                    raise ArchiveError(f"{path}: {e}") from e
                if rows:
                    yield packed(rows)

    return listed.repartition(max(1, listed.count())).mapInArrow(run, schema)


def _field(name: str, kind: str = "string") -> Column:
    return F.expr(f"try_cast(fields['{name}'] AS {kind})")


def import_archives(store: Store, paths: str | list[str]) -> int:
    """Loads result backups into the store's tables and returns how many were new.

    Archives whose experiment is in the store are left out, so loading twice adds nothing. The experiments are written last: what a load that
    broke off left behind belongs to none and is cleared first. Scores without a result, and results without scores, are kept apart from each other.
    """
    spark = store.spark
    known = store["experiment"]
    for name in ("algorithm_scoring", "algorithm_execution", "execution", "algorithm_ranking", "runtime_trace", "cleaning_metrics"):
        left = store[name].where("experiment_id is not null").join(known.select(F.col("id").alias("experiment_id")), "experiment_id", "left_anti").select("experiment_id").distinct()
        if not left.isEmpty():
            for row in left.collect():  # of the load that broke off
                store.delete_experiment(row["experiment_id"])
    rows = read_archives(spark, paths)
    names = rows.select(F.col("archive").alias("name")).distinct().join(known.select("name"), "name", "left_anti")
    order = Window.partitionBy().orderBy("name")  # a row per archive
    new = names.select("name", (F.row_number().over(order) + store.next_id("experiment") - 1).alias("experiment_id"))
    listed = [(r["name"], r["experiment_id"]) for r in new.collect()]
    if not listed:
        return 0
    ids = spark.createDataFrame(listed, "archive string, experiment_id bigint")
    rows = rows.join(ids, "archive")
    folder = f"{store.path}/.load"  # read once; each table takes its members from there
    rows.withColumn("kind", F.when(F.col("member").startswith(f"{SCORES}/"), "scores").otherwise("others")).write.mode("overwrite").partitionBy("kind").parquet(folder)
    read = spark.read.parquet(folder)
    small, scores = read.where("kind = 'others'"), read.where("kind = 'scores'")
    of = lambda member: small.where(F.col("member") == member)

    missing = ids.join(of(CONFIG).select("archive"), "archive", "left_anti").unionByName(ids.join(of(RESULTS).select("archive"), "archive", "left_anti"))
    if not missing.isEmpty():
        raise ArchiveError(f"{missing.first()['archive']} has no {CONFIG} or no {RESULTS}")
    config = of(CONFIG).select("experiment_id", F.md5("text").alias("config_id"), F.col("text").alias("config"))
    store.append("configuration", config.select(F.col("config_id").alias("id"), "config").dropDuplicates(["id"]).join(store["configuration"].select("id"), "id", "left_anti"))
    trace = of(TRACE).select(
        "experiment_id", F.col("no").alias("position"), _field("Timer").alias("trace_name"), _field("Type").alias("trace_type"), _field("Begin (ns)", "bigint").alias("begin_ns"), _field("End (ns)", "bigint").alias("end_ns"), _field("Duration (ns)", "bigint").alias("duration_ns"))
    store.append("runtime_trace", trace)
    results = of(RESULTS).select(
        "experiment_id", "no", _field("dataset_id").alias("dataset_id"), _field("algorithm").alias("algorithm"), _field("params_id").alias("hyper_params_id"), _field("params").alias("hyper_params"), _field("quality", "double").alias("quality"),
        _field("mean_train_quality", "double").alias("mean_train_quality"), _field("no_datasets", "double").cast("bigint").alias("no_datasets"))
    key = ["experiment_id", "dataset_id", "algorithm", "hyper_params_id"]
    first = results.groupBy(*key).agg(F.min_by("hyper_params", "no").alias("hyper_params"), F.min_by("quality", "no").alias("range_pr_auc"))
    place = F.row_number().over(Window.partitionBy().orderBy(*key)) + store.next_id("algorithm_scoring") - 1  # a row per instance of the runs
    store.append("algorithm_scoring", first.withColumn("id", place))
    scored = store["algorithm_scoring"].join(ids.select("experiment_id"), "experiment_id", "left_semi").select(*key, F.col("id").alias("algorithm_scoring_id"), "range_pr_auc")
    file = F.regexp_extract("member", rf"^{SCORES}/(.*)\.csv$", 1)
    points = scores.select("experiment_id", file.alias("file"), F.col("no").alias("time"), F.expr("try_cast(text AS double)").alias("score"))
    named = scored.where("range_pr_auc is not null").select("experiment_id", F.concat_ws("-", "dataset_id", "algorithm", "hyper_params_id").alias("file"), "algorithm_scoring_id")
    store.append("scoring", points.join(named, ["experiment_id", "file"]))
    base = store.next_id("algorithm_execution") - 1
    store.append("algorithm_execution", results.join(scored, key).withColumn("id", F.row_number().over(Window.partitionBy().orderBy("experiment_id", "no")) + base))
    dataset = results.groupBy("experiment_id").agg(F.min("dataset_id").alias("dataset_id"))
    cleaning = of(CLEANING).select("experiment_id", F.explode(F.from_json("text", "array<struct<precision:double,recall:double,f1:double,f10:double>>")).alias("c")).select("experiment_id", "c.*")
    store.append("cleaning_metrics", cleaning.join(dataset, "experiment_id"))

    rankings = of(METRICS).select("experiment_id", "no", *[_field(f"{c}-method").alias(f"{k}_method") for c, k in (("selection", "ranking"), ("normalization", "normalization"), ("aggregation", "aggregation"))], *[_field(c, "double").alias(k) for c, k in METRIC_COLUMNS.items()], _field("name").alias("ranking"))
    numbered = rankings.withColumn("id", F.row_number().over(Window.partitionBy().orderBy("experiment_id", "no")) + store.next_id("algorithm_ranking") - 1)
    store.append("algorithm_ranking", numbered.select("id", "experiment_id"))
    chosen = small.where(F.col("member").startswith(f"{RANKINGS}/")).select("experiment_id", F.split_part("member", F.lit("/"), F.lit(2)).alias("ranking"), F.col("no").alias("rank"), _field("dataset_id").alias("dataset_id"), _field("algorithm").alias("algorithm"), _field("params_id").alias("hyper_params_id"))
    entries = chosen.join(numbered.select("experiment_id", "ranking", F.col("id").alias("ranking_id")), ["experiment_id", "ranking"]).join(scored, key)
    store.append("algorithm_ranking_entry", entries)
    whole = trace.where("trace_name = 'autotsad' and trace_type = 'END'").groupBy("experiment_id").agg((F.min("duration_ns") / 1e9).alias("runtime"))
    version = of(VERSION).select("experiment_id", F.trim(F.regexp_replace("text", r"\s+$", "")).alias("version"))
    runs = numbered.withColumn("algorithm_ranking_id", F.col("id")).join(dataset, "experiment_id").join(config.select("experiment_id", "config_id"), "experiment_id").join(whole, "experiment_id", "left").join(version, "experiment_id", "left")
    first_run = store.next_id("execution") - 1
    store.append("execution", runs.withColumns({"version": F.coalesce("version", F.lit("unknown")), "id": F.row_number().over(Window.partitionBy().orderBy("algorithm_ranking_id")) + first_run}))
    store.append("experiment", ids.select(F.col("experiment_id").alias("id"), F.col("archive").alias("name"), F.lit("").alias("description"), name_timestamp(F.regexp_replace("archive", "_", "-")).alias("date")))
    return len(listed)


def import_baseline_folders(store: Store, path: str, name: str | None = None) -> int:
    """Loads result folders ``<prefix>-<dataset hash>-<rest>`` below ``path`` and returns how many were new.

    A folder has metrics.json and scores.csv, and may have config.json and runtime.txt (nanoseconds); others, and those with "failed" in
    their name, are left out, as are baselines of a dataset that the store has. The baseline is the prefix (``name`` where it has digits or is missing) and the rest.
    """
    spark = store.spark
    small = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{metrics.json,config.json,runtime.txt}").load(path)
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    texts = small.select(folder.alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("content").cast("string").alias("text"))
    one = lambda file: F.max(F.when(F.col("file") == file, F.col("text")))
    found = texts.where(~F.col("folder").contains("failed") & F.col("folder").rlike(r"^(.*-)?[0-9a-f]{32}-.*$")).groupBy("folder").agg(one("metrics.json").alias("metrics"), one("config.json").alias("config"), one("runtime.txt").alias("runtime"))
    parts = F.split("folder", "-")
    prefix = F.trim(parts[0])
    prefix = F.when(prefix.rlike("[0-9]") | (prefix == ""), F.lit(name)).otherwise(prefix)
    runs = found.where("metrics is not null").withColumns({"prefix": prefix, "rest": F.trim(F.element_at(parts, -1)), "dataset_id": F.trim(F.element_at(parts, -2))})
    unnamed = runs.where("prefix is null").limit(1).collect()
    if unnamed:
        raise ValueError(f"{unnamed[0]['folder']} doesn't name its baseline")
    scores = _score_lines(spark, path)
    runs = runs.join(scores.select("folder").distinct(), "folder", "left_semi").withColumn("name", F.concat_ws("-", "prefix", "rest"))
    new = runs.join(store["baseline_execution"].select("dataset_id", "name"), ["dataset_id", "name"], "left_anti")
    sized = new.withColumn("_n", F.row_number().over(Window.partitionBy("dataset_id", "name").orderBy("folder"))).where("_n = 1").drop("_n")
    place = F.row_number().over(Window.partitionBy().orderBy("dataset_id", "name"))  # a row per folder
    metric = lambda c: F.get_json_object("metrics", f"$.{c}").cast("double")
    kept = sized.select(
        (place + store.next_id("algorithm_scoring") - 1).alias("scoring_id"), (place + store.next_id("baseline_execution") - 1).alias("id"), "folder", "dataset_id", "name", F.col("name").alias("algorithm"),
        F.md5(F.coalesce("config", F.lit("{}"))).alias("hyper_params_id"), F.coalesce("config", F.lit("{}")).alias("hyper_params"), (F.trim("runtime").cast("double") / 1e9).alias("runtime"), *[metric(c).alias(k) for c, k in METRIC_COLUMNS.items()])
    staged = f"{store.path}/.load"
    kept.write.mode("overwrite").parquet(staged)  # ids are given out once
    kept = spark.read.parquet(staged)
    n = kept.count()
    store.append("algorithm_scoring", kept.withColumn("id", F.col("scoring_id")))
    store.append("scoring", scores.join(kept.select("folder", F.col("scoring_id").alias("algorithm_scoring_id")), "folder"))
    store.append("baseline_execution", kept.withColumn("algorithm_scoring_id", F.col("scoring_id")))
    return n


def _score_lines(spark: SparkSession, path: str) -> DataFrame:
    """(folder, time, score) of the files scores.csv below a folder: a score per line."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "scores.csv").text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("folder"), "value")
    numbered = lines.select("folder", F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("time", "line"))
    return numbered.select("folder", F.col("time").cast("long").alias("time"), F.expr("try_cast(trim(line) AS double)").alias("score"))

