"""Command line: run, estimate-period, db (load-dataset, load-result-backups, load-baseline-results, delete-experiment, list), baselines select."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tsquorum", description="Unsupervised anomaly ensembles for time series on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="score series files")
    run.add_argument("path", nargs="+")
    run.add_argument("--config", help="JSON file with sections of settings")
    run.add_argument("--work", help="folder for the stages' results; a run there is resumed")
    run.add_argument("--out", required=True)
    period = sub.add_parser("estimate-period", help="period of series files")
    period.add_argument("path", nargs="+")
    db = sub.add_parser("db", help="the result store")
    db.add_argument("--store", required=True)
    dbs = db.add_subparsers(dest="action", required=True)
    load = dbs.add_parser("load-dataset")
    load.add_argument("path")
    load.add_argument("--collection", required=True)
    load.add_argument("--paper", action="store_true")
    delete = dbs.add_parser("delete-experiment")
    delete.add_argument("experiment", type=int)
    backups = dbs.add_parser("load-result-backups", help="tar.gz archives of finished runs; those that are there are left out")
    backups.add_argument("path", nargs="+")
    folders = dbs.add_parser("load-baseline-results", help="result folders below a folder")
    folders.add_argument("path")
    folders.add_argument("--name", help="the baseline of folders that don't name theirs")
    dbs.add_parser("list")
    base = sub.add_parser("baselines", help="selective ensemble without training")
    base.add_argument("path", nargs="+")
    base.add_argument("--strategy", choices=("vertical", "horizontal"), default="vertical")
    base.add_argument("--out", required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from tsquorum.operators import detectors, selective
    from tsquorum.plans import config as cfg
    from tsquorum.plans import pipeline
    from tsquorum.sources import archives, files
    from tsquorum.sources.store import Store

    spark = SparkSession.builder.appName("tsquorum").getOrCreate()
    if args.command == "db":
        store = Store(spark, args.store)
        if args.action == "load-dataset":
            store.load_dataset(args.path, args.collection, args.paper)
        elif args.action == "delete-experiment":
            store.delete_experiment(args.experiment)
        elif args.action == "load-result-backups":
            print(archives.import_archives(store, args.path), "new experiments")
        elif args.action == "load-baseline-results":
            print(archives.import_baseline_folders(store, args.path, args.name), "new baseline results")
        else:
            store["dataset"].orderBy("collection", "name").show(1000, truncate=False)
        return 0
    points = files.read_series(spark, args.path)
    if args.command == "estimate-period":
        pipeline.estimate_period(points, cfg.load()).show(1000, truncate=False)
    elif args.command == "run":
        values = None
        if args.config:
            with open(args.config) as f:
                values = json.load(f)
        pipeline.run(points, cfg.load(values), args.work).write.mode("overwrite").parquet(args.out)
    else:
        jobs = spark.createDataFrame([(a, a, json.dumps(d.defaults)) for a, d in detectors.DETECTORS.items()], "instance string, algorithm string, params_json string")
        scored = detectors.run_detectors(points, jobs, ["series_id"])
        selective.select_series(scored, ["series_id"], args.strategy).write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
