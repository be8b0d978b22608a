"""The result store: thirteen tables as Parquet folders, registered as views; imports, baselines, deletes.

Any JDBC database with the same tables can be read by ``from_jdbc`` and written by ``to_jdbc``. One writer at a time:
ids are the largest one plus one. Readers may come at any time; a table that is being replaced is read from its old
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsquorum.functions.scalar import clean_dataset_name, name_timestamp, params_id
from tsquorum.sources import files, schemas


class Store:
    """Tables by name; missing ones are empty."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, name: str):
        """File system and path of a folder of the store."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _exists(self, name: str) -> bool:
        system, target = self._folder(name)
        return system.exists(target)

    def __getitem__(self, name: str) -> DataFrame:
        schema = schemas.STORE[name]
        for folder in (name, f".{name}.old"):
            if self._exists(folder):
                return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        return self.spark.createDataFrame([], schema)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows; columns are cast to the schema, missing ones are null. Big tables are laid out by series."""
        empty = self.spark.createDataFrame([], schemas.STORE[name])
        cast = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema]
        out = rows.select(*cast)
        key = {"timeseries": "dataset_id", "scoring": "algorithm_scoring_id"}.get(name)
        if key:
            out = out.repartition(key).sortWithinPartitions(key, "time")
        self._restore(name)
        out.write.mode("append").parquet(f"{self.path}/{name}")

    def register(self, prefix: str = "") -> None:
        for name in schemas.STORE:
            self[name].createOrReplaceTempView(prefix + name)

    def load_dataset(self, path: str, collection: str, paper: bool = False) -> None:
        """Adds a series file under its cleaned name; one that is there already is refused."""
        series = files.read_series(self.spark, path)
        parts = path.rstrip("/").split("/")
        parent = parts[-2] if len(parts) > 1 else ""
        head = series.select(F.col("series_id").alias("hexhash"), clean_dataset_name(F.col("name"), F.lit(parent)).alias("name"), F.lit(collection).alias("collection"), F.lit(paper).alias("paper"), F.lit(False).alias("revision")).distinct()
        if not head.join(self["dataset"], "hexhash", "left_semi").isEmpty():
            raise ValueError(f"{path} is in the store")
        self.append("timeseries", series.select(F.col("series_id").alias("dataset_id"), F.col("t").alias("time"), "value", "is_anomaly"))
        self.append("dataset", head)

    def load_series(self, hexhash: str) -> DataFrame:
        """(t, value, is_anomaly) in order of time; sorted files and statistics prune the scan."""
        return self["timeseries"].where(F.col("dataset_id") == hexhash).orderBy("time").select(F.col("time").alias("t"), "value", "is_anomaly")

    def next_id(self, name: str) -> int:
        return (self[name].agg(F.max("id")).first()[0] or 0) + 1

    def import_backup(self, name: str, version: str, config_id: str, config: str, results: DataFrame, scores: DataFrame, ranking: DataFrame, executions: DataFrame, trace: DataFrame) -> int:
        """One finished run as frames: new configuration and experiment, scorings that aren't there yet, their scores,
        the ranking from 0, executions, and traces. Returns the experiment's id."""
        spark, experiment = self.spark, self.next_id("experiment")
        one = spark.range(1)
        if self["configuration"].where(F.col("id") == config_id).isEmpty():
            self.append("configuration", one.select(F.lit(config_id).alias("id"), F.lit(config).alias("config")))
        self.append("experiment", one.select(F.lit(experiment).alias("id"), F.lit(name).alias("name"), name_timestamp(F.lit(name)).alias("date")))
        keyed = results.withColumn("hyper_params_id", params_id(F.col("params")))
        known = self["algorithm_scoring"].select("dataset_id", "algorithm", "hyper_params_id")
        new = keyed.join(known, ["dataset_id", "algorithm", "hyper_params_id"], "left_anti")
        order = Window.partitionBy().orderBy("dataset_id", "algorithm", "hyper_params_id")  # one row per instance of a run
        base = self.next_id("algorithm_scoring") - 1
        self.append("algorithm_scoring", new.select((F.row_number().over(order) + base).alias("id"), "dataset_id", F.lit(experiment).alias("experiment_id"), "algorithm", "hyper_params_id", F.to_json("params").alias("hyper_params"), F.col("quality").alias("range_pr_auc"), F.col("duration").alias("runtime")))
        ids = self["algorithm_scoring"].select("id", "dataset_id", F.concat_ws("-", "algorithm", "hyper_params_id").alias("instance"))
        fresh = self["scoring"].select(F.col("algorithm_scoring_id").alias("id")).distinct()
        self.append("scoring", scores.join(ids.join(fresh, "id", "left_anti"), ["dataset_id", "instance"]).select(F.col("id").alias("algorithm_scoring_id"), F.col("t").alias("time"), "score"))
        rank_id = self.next_id("algorithm_ranking")
        self.append("algorithm_ranking", one.select(F.lit(rank_id).alias("id"), F.lit(experiment).alias("experiment_id")))
        self.append("algorithm_ranking_entry", ranking.join(ids, ["dataset_id", "instance"]).select(F.lit(rank_id).alias("ranking_id"), "rank", F.col("id").alias("algorithm_scoring_id")))
        first = self.next_id("execution") - 1
        place = Window.partitionBy().orderBy("dataset_id", "ranking_method", "normalization_method", "aggregation_method")
        self.append("execution", executions.withColumns({"id": F.row_number().over(place) + first, "config_id": F.lit(config_id), "experiment_id": F.lit(experiment), "version": F.lit(version), "algorithm_ranking_id": F.lit(rank_id)}))
        self.append("runtime_trace", trace.withColumns({"experiment_id": F.lit(experiment), "trace_name": F.col("timer"), "trace_type": F.col("type"), "position": F.row_number().over(Window.partitionBy().orderBy("begin_ns"))}))
        return experiment

    def import_baselines(self, listed: DataFrame) -> None:
        """Result folders <prefix>-<hash>-<rest>: (folder, name, runtime, metrics..); others are ignored."""
        pattern = r"^(?:(.*)-)?([0-9a-f]{32})-.*$"
        rows = listed.where(F.col("folder").rlike(pattern)).withColumn("dataset_id", F.regexp_extract("folder", pattern, 2))
        known = self["baseline_execution"].select("dataset_id", "name")
        base = self.next_id("baseline_execution") - 1
        new = rows.join(known, ["dataset_id", "name"], "left_anti")
        self.append("baseline_execution", new.withColumn("id", F.row_number().over(Window.partitionBy().orderBy("dataset_id", "name")) + base))

    def delete_experiment(self, experiment: int) -> None:
        """Rewrites the tables that hold the experiment's rows, dependants first; after a crash, it can be run again."""
        scorings = self["algorithm_scoring"].where(F.col("experiment_id") == experiment).select(F.col("id").alias("algorithm_scoring_id"))
        rankings = self["algorithm_ranking"].where(F.col("experiment_id") == experiment).select(F.col("id").alias("ranking_id"))
        keep = {
            "algorithm_ranking_entry": self["algorithm_ranking_entry"].join(rankings, "ranking_id", "left_anti"),
            "scoring": self["scoring"].join(scorings, "algorithm_scoring_id", "left_anti"),
        }
        for name, schema in schemas.STORE.items():
            if "experiment_id" in schema:
                keep[name] = self[name].where(F.col("experiment_id") != experiment)
        keep["experiment"] = self["experiment"].where(F.col("id") != experiment)
        for name, rows in keep.items():
            self._replace(name, rows)

    def _restore(self, name: str) -> None:
        """Takes the old folder back where a replacement broke off with the table away."""
        system, target = self._folder(name)
        aside = self._folder(f".{name}.old")[1]
        if not system.exists(target) and system.exists(aside):
            system.rename(aside, target)

    def _replace(self, name: str, rows: DataFrame) -> None:
        """Writes ``rows`` beside the table, moves the table aside, and the rows into its place; no step loses both."""
        self._restore(name)
        rows.write.mode("overwrite").parquet(f"{self.path}/.{name}.new")
        system, target = self._folder(name)
        new, aside = self._folder(f".{name}.new")[1], self._folder(f".{name}.old")[1]
        system.delete(aside, True)
        if system.exists(target) and not system.rename(target, aside):
            raise OSError(f"cannot move {target} aside")
        if not system.rename(new, target):
            self._restore(name)
            raise OSError(f"cannot move {new} into place")
        system.delete(aside, True)


def from_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """A table of a database, filters and columns pushed down.

    With a numeric or time ``column`` and its ``bounds``, ``partitions`` tasks read a range each; rows beyond the bounds
    or with a null there are read, too.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column is not None:
        low, high = bounds
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=partitions)
    return reader.load()


def to_jdbc(rows: DataFrame, url: str, table: str, mode: str = "append", isolation: str = "SERIALIZABLE", **options: str) -> None:
    """Writes rows to a table of a database, a transaction per partition at the given isolation level."""
    rows.write.format("jdbc").option("url", url).option("dbtable", table).option("isolationLevel", isolation).options(**options).mode(mode).save()


#: Kinds of database columns that hold a type of ours without loss.
_HOLDS = {"string": ("string", "varchar", "char"), "bigint": ("bigint", "int", "smallint"), "double": ("double", "float", "decimal"), "boolean": ("boolean",), "timestamp": ("timestamp", "timestamp_ntz")}
#: The keys of the result store's tables.
KEYS = {
    "dataset": ("hexhash",), "timeseries": ("dataset_id", "time"), "configuration": ("id",), "experiment": ("id",), "algorithm_scoring": ("id",), "scoring": ("algorithm_scoring_id", "time"), "algorithm_ranking": ("id",),
    "algorithm_ranking_entry": ("ranking_id", "rank"), "algorithm_execution": ("id",), "execution": ("id",), "baseline_execution": ("id",), "runtime_trace": ("experiment_id", "position"), "cleaning_metrics": (),
}


def reflect(spark: SparkSession, url: str, prefix: str = "", **options: str) -> list[str]:
    """What a database lacks of the store's 13 tables: missing tables and columns, columns whose kind can't hold ours, and primary keys that
    differ. An empty list: it can be used. Names are compared without regard to case; columns beyond ours don't matter.

    Tables and keys come from the database's catalogue, by JDBC metadata; columns from an empty read of each table. No rows are read.
    """
    props = spark._jvm.java.util.Properties()
    for k, value in options.items():
        props.setProperty(k, value)
    if "driver" in options:
        spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, props)
    wrong = []
    try:
        meta = connection.getMetaData()
        listed = meta.getTables(None, None, "%", None)
        there = {}
        while listed.next():
            there[listed.getString("TABLE_NAME").lower()] = (listed.getString("TABLE_SCHEM"), listed.getString("TABLE_NAME"))
        for name, schema in schemas.STORE.items():
            full = (prefix + name).lower()
            if full not in there:
                wrong.append(f"{prefix}{name}: no such table")
                continue
            found = meta.getPrimaryKeys(None, *there[full])
            keys = {}
            while found.next():
                keys[found.getInt("KEY_SEQ")] = found.getString("COLUMN_NAME").lower()
            own = tuple(keys[k] for k in sorted(keys))
            if set(own) != set(KEYS[name]):
                wrong.append(f"{prefix}{name}: its primary key is ({', '.join(own)}), not ({', '.join(KEYS[name])})")
            columns = {f.name.lower(): f.dataType.simpleString().split("(")[0] for f in from_jdbc(spark, url, there[full][1], **options).schema}
            for part in schema.split(", "):
                column, kind = part.split()
                if column not in columns:
                    wrong.append(f"{prefix}{name}: no column {column}")
                elif columns[column] not in _HOLDS[kind]:
                    wrong.append(f"{prefix}{name}: column {column} is {columns[column]}, not {kind}")
    finally:
        connection.close()
    return wrong


def external_baselines(results: DataFrame, datasets: DataFrame, metric: str) -> dict[str, DataFrame]:
    """From benchmark results (collection, dataset, algorithm, <metric>, runtime): the best algorithm per dataset, the
    mean over algorithms, and single algorithms, joined to the store's datasets."""
    joined = results.join(datasets.select("hexhash", "collection", F.col("name").alias("dataset")), ["collection", "dataset"])
    order = Window.partitionBy("hexhash").orderBy(F.col(metric).desc(), "algorithm")
    best = joined.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    mean = joined.groupBy("hexhash", "collection", "dataset").agg(F.avg(metric).alias(metric), F.avg("runtime").alias("runtime"))
    single = {a: joined.where(F.lower("algorithm") == a) for a in ("k-means", "sand")}
    return {"best-algo": best, "mean-algo": mean, **single}
