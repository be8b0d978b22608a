"""Reports over the result store: functions of DataFrames with the store's columns. Dimensions are small; big sides
are filtered and aggregated before they are joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filter names and the columns they restrict.
FILTERS = {
    "versions": "version", "config_ids": "config_id", "ranking_methods": "ranking_method", "normalization_methods": "normalization_method",
    "aggregation_methods": "aggregation_method", "experiments": "experiment_id",
}


def filtered(executions: DataFrame, **filters: list) -> DataFrame:
    """Restricts every dimension that has a list; an empty list is no filter."""
    unknown = set(filters) - set(FILTERS)
    if unknown:
        raise ValueError(f"no such filter: {sorted(unknown)}")
    clauses = [F.col(FILTERS[k]).isin(v) for k, v in filters.items() if v]
    return executions.where(reduce(lambda a, b: a & b, clauses)) if clauses else executions


def chosen(datasets: DataFrame, paper: bool = False, revision: bool = False) -> DataFrame:
    out = datasets.where("paper") if paper else datasets
    return out.where("revision") if revision else out


def list_datasets(executions: DataFrame, datasets: DataFrame, **filters: list) -> DataFrame:
    used = filtered(executions, **filters).select(F.col("dataset_id").alias("hexhash")).distinct()
    return datasets.join(used, "hexhash", "left_semi").select("hexhash", "name", "collection").distinct()


def collections(datasets: DataFrame) -> DataFrame:
    return datasets.where("paper").groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


def method_name(prefix: str, *parts: str) -> Column:
    return F.concat(F.lit(prefix), F.concat_ws("-", *parts))


METHOD_PARTS = ("ranking_method", "normalization_method", "aggregation_method")


def available_methods(executions: DataFrame, baselines: DataFrame) -> DataFrame:
    ours = executions.select(F.concat_ws("-", *METHOD_PARTS).alias("method"), F.lit("ensemble").alias("type"))
    theirs = baselines.select(F.col("name").alias("method"), baseline_type(F.col("name")).alias("type"))
    return ours.union(theirs).distinct()


def baseline_type(name: Column) -> Column:
    return F.when(name.startswith("select"), "selective ensemble").when(name == "best-algo", "oracle").otherwise("baseline")


def all_results(executions: DataFrame, baselines: DataFrame, datasets: DataFrame, **filters: list) -> DataFrame:
    """Results of ensembles and baselines with their dataset's name and collection."""
    dims = datasets.select(F.col("hexhash").alias("dataset_id"), F.col("name").alias("dataset"), "collection")
    ours = filtered(executions, **filters).select("dataset_id", F.concat_ws("-", *METHOD_PARTS).alias("method"), F.lit("ensemble").alias("type"), "range_pr_auc", "runtime")
    theirs = baselines.select("dataset_id", F.col("name").alias("method"), baseline_type(F.col("name")).alias("type"), "range_pr_auc", "runtime")
    return ours.unionByName(theirs).join(dims, "dataset_id")


def without_methods(results: DataFrame, suffix: str = "", part: str = "", prefix: str = "") -> DataFrame:
    out = results
    for test, text in ((F.endswith, suffix), (F.contains, part), (F.startswith, prefix)):
        out = out.where(~test(F.col("method"), F.lit(text))) if text else out
    return out


def ranking_results(executions: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries of each execution's ranking with their scoring."""
    return executions.select(F.col("id").alias("execution_id"), "dataset_id", F.col("algorithm_ranking_id").alias("ranking_id")).join(entries, "ranking_id").select("execution_id", "dataset_id", "rank", "algorithm", F.col("range_pr_auc").alias("quality"))


def baseline_rankings(baselines: DataFrame, entries: DataFrame) -> DataFrame:
    """A baseline's ranking, or its single scoring as rank 1."""
    ranked = baselines.join(entries.select("ranking_id", "rank", F.col("id").alias("ranked_scoring")), F.col("algorithm_ranking_id") == F.col("ranking_id"), "left")
    scored = ranked.withColumn("scoring_id", F.coalesce("ranked_scoring", "algorithm_scoring_id"))
    return scored.select(F.col("id").alias("baseline_id"), "name", F.coalesce("rank", F.lit(1).cast("long")).alias("rank"), "scoring_id")


def top1(executions: DataFrame, entries: DataFrame, first_rank: int = 0) -> DataFrame:
    """The first entry of each ranking; ranks are written from 0."""
    return ranking_results(executions, entries.where(F.col("rank") == first_rank))


def runtime_traces(traces: DataFrame, executions: DataFrame, names: list[str]) -> DataFrame:
    runs = executions.select("experiment_id", "config_id").distinct()
    return traces.where(F.col("trace_name").isin(names) & (F.col("trace_type") == "END")).join(runs, "experiment_id")


def mean_runtimes(executions: DataFrame, baselines: DataFrame) -> DataFrame:
    def per(df: DataFrame, method: Column) -> DataFrame:
        return df.groupBy(method.alias("method")).agg(F.round(F.avg("runtime"), 4).alias("mean_runtime"), F.countDistinct("dataset_id").alias("datasets"))

    return per(executions, F.concat_ws("-", *METHOD_PARTS)).union(per(baselines, F.col("name"))).distinct()


def improvements(executions: DataFrame, better: Column, base: Column) -> DataFrame:
    """Difference of two kinds of executions on one dataset with equal methods, best of each kind."""
    keys = ["dataset_id", *METHOD_PARTS[1:]]
    one = executions.where(better).groupBy(*keys).agg(F.max("range_pr_auc").alias("_new"))
    two = executions.where(base).groupBy(*keys).agg(F.max("range_pr_auc").alias("_old"))
    return one.join(two, keys).withColumn("improvement", F.round(F.col("_new") - F.col("_old"), 6)).drop("_new", "_old")


def exact_missing(new: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key tuple isn't known."""
    return new.join(known.select(*keys).distinct(), keys, "left_anti")


def loose_missing(new: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of which some single key value isn't known, as independent membership tests per column leave."""
    out = new
    for k in keys:
        out = out.join(known.select(F.col(k)).distinct().withColumn(f"_has_{k}", F.lit(True)), k, "left")
    seen = reduce(lambda a, b: a & b, [F.coalesce(f"_has_{k}", F.lit(False)) for k in keys])
    return out.where(~seen).drop(*[f"_has_{k}" for k in keys])


def best_per_group(rows: DataFrame, keys: list[str], value: str, ties: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(value).desc(), *ties)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def grouped_traces(traces: DataFrame, groups: dict[str, list[str]], by: list[str]) -> DataFrame:
    """Runtime and first position of groups of traces."""
    name = reduce(lambda c, g: c.when(F.col("trace_name").isin(g[1]), g[0]), groups.items(), F.when(F.lit(False), F.lit(""))).otherwise(F.col("trace_name"))
    return traces.groupBy(*by, name.alias("trace_group")).agg(F.sum("duration_ns").cast("long").alias("duration_ns"), F.min("position").alias("position"))


def relative_runtime(traces: DataFrame, by: list[str]) -> DataFrame:
    """Share of each trace in its run, in percent."""
    share = F.col("duration_ns") / F.sum("duration_ns").over(Window.partitionBy(*by)) * 100
    return traces.withColumn("percent", share)


def stratified(rows: DataFrame, group: str, key: str, n: int, seed: int = 1) -> DataFrame:
    """At most ``n`` rows of each group, chosen by a seeded hash of their key."""
    order = Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], priority: dict[str, int]) -> DataFrame:
    """Rows of both by key; the status with the higher priority wins, of equal ones the new row."""
    level = reduce(lambda c, p: c.when(F.col("status") == p[0], p[1]), priority.items(), F.when(F.lit(False), F.lit(0))).otherwise(F.lit(-1))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(level.desc(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def without_experiment(store: dict[str, DataFrame], experiment: int) -> dict[str, DataFrame]:
    """The store without an experiment's rows; plain Parquet has no deletes, so tables are rewritten."""
    return {name: t.where(F.col("experiment_id") != experiment) if "experiment_id" in t.columns else t for name, t in store.items()}
