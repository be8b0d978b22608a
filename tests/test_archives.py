"""Result backups and baseline folders written here come back as rows."""

from __future__ import annotations

import io
import json
import tarfile

import pytest

from tsquorum.sources import archives
from tsquorum.sources.store import Store

HASH = "0123456789abcdef0123456789abcdef"
PARAMS = [{"window_size": 10, "k": 3}, {"window_size": 20}]


def made(folder, name: str, seed: int = 0, leave_out: tuple = (), odd: bool = False):
    """An archive as a run writes it."""
    ids = [archives.settings_id(json.dumps(p))[0] for p in PARAMS]
    quoted = ['"' + json.dumps(p).replace('"', '""') + '"' for p in PARAMS]
    members = {
        "config.json": json.dumps({"general": {"seed": seed, "tmp_path": f"/x/{name}"}, "consolidation": {"plot": True, "e": 1}, "data_gen_plotting": 3}),
        "version.txt": "0.3.3\n",
        "execution-results.csv": "dataset_id,algorithm,params,quality,no_datasets,mean_train_quality\n" + f"{HASH},knn,{quoted[0]},0.5,3,0.7\n{HASH},lof,{quoted[1]},,2,0.6\n{HASH},knn,{quoted[1]},0.25,2,\n",
        "runtimes.csv": "Timer,Type,Begin (ns),End (ns),Duration (ns)\nautotsad,START,1,,\nautotsad,END,1,2000000001,2000000000\n",
        "cleaning-metrics.json": json.dumps([{"precision": 0.5, "recall": 1.0, "f1": 0.66, "f10": 0.9}]),
        "metrics.csv": ",selection-method,normalization-method,aggregation-method,PrAUC,RangePrAUC\na-minmax-max,a,minmax,max,0.1,0.2\nb-minmax-max,b,minmax,max,0.3,\n",
        f"scores/{HASH}-knn-{ids[0]}.csv": "0.1\n0.2\n1e-3\n", f"scores/{HASH}-lof-{ids[1]}.csv": "9\n", f"./scores/{HASH}-knn-{ids[1]}.csv": "nan\n0.5\n",
        "rankings/a-minmax-max/selected-instances.csv": f"dataset_id,algorithm,params\n{HASH},knn,{quoted[1]}\n{HASH},knn,{quoted[0]}\n",
        "tmp/cache/other.bin": "\x00",
    }
    with tarfile.open(folder / f"{name}.tar.gz", "w:gz") as tar:
        for member, text in members.items():
            if member not in leave_out:
                data = text.encode()
                info = tarfile.TarInfo(member)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        if odd:
            link = tarfile.TarInfo("../../metrics.csv")
            link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
            tar.addfile(link)


def counts(store):
    return {n: store[n].count() for n in ("configuration", "experiment", "algorithm_scoring", "scoring", "algorithm_execution", "algorithm_ranking", "algorithm_ranking_entry", "execution", "runtime_trace", "cleaning_metrics")}


def test_backups_come_back_and_load_once(spark, tmp_path):
    made(tmp_path, "2024-03-01_one")
    made(tmp_path, "2024-03-02-two", odd=True)
    store = Store(spark, str(tmp_path / "store"))
    assert archives.import_archives(store, str(tmp_path / "*.tar.gz")) == 2
    want = {"configuration": 1, "experiment": 2, "algorithm_scoring": 6, "scoring": 10, "algorithm_execution": 6, "algorithm_ranking": 4, "algorithm_ranking_entry": 4, "execution": 4, "runtime_trace": 4, "cleaning_metrics": 2}
    assert counts(store) == want
    assert archives.import_archives(store, str(tmp_path / "*.tar.gz")) == 0 and counts(store) == want
    store.register("r_")
    got = spark.sql("""SELECT e.name, x.ranking_method, r.rank, s.algorithm, s.hyper_params, s.range_pr_auc, x.runtime, x.version, x.range_pr_auc AS quality
        FROM r_experiment e JOIN r_execution x ON x.experiment_id = e.id JOIN r_algorithm_ranking_entry r ON r.ranking_id = x.algorithm_ranking_id JOIN r_algorithm_scoring s ON s.id = r.algorithm_scoring_id ORDER BY e.name, r.rank""").collect()
    assert [tuple(r) for r in got[:2]] == [("2024-03-01_one", "a", 0, "knn", '{"window_size": 20}', 0.25, 2.0, "0.3.3", 0.2), ("2024-03-01_one", "a", 1, "knn", '{"k": 3, "window_size": 10}', 0.5, 2.0, "0.3.3", 0.2)]
    assert len(got) == 4 and str(store["experiment"].orderBy("name").first()["date"].date()) == "2024-03-01"
    config = json.loads(store["configuration"].first()["config"])
    assert config == {"general": {"seed": 0}, "consolidation": {"e": 1}}
    points = spark.sql("SELECT time, score FROM r_scoring p JOIN r_algorithm_scoring s ON s.id = p.algorithm_scoring_id WHERE s.range_pr_auc = 0.5 AND s.experiment_id = 1 ORDER BY time").collect()
    assert [tuple(r) for r in points] == [(0, 0.1), (1, 0.2), (2, 0.001)]


def test_a_load_that_broke_off_is_cleared(spark, tmp_path, monkeypatch):
    made(tmp_path, "2024-03-01_one")
    store = Store(spark, str(tmp_path / "store"))
    real, seen = Store.append, []

    def breaks(self, name, rows):
        if name == "execution" and not seen:
            seen.append(1)
            raise RuntimeError("lost")
        real(self, name, rows)

    monkeypatch.setattr(Store, "append", breaks)
    with pytest.raises(RuntimeError):
        archives.import_archives(store, str(tmp_path / "*.tar.gz"))
    assert store["algorithm_scoring"].count() == 3 and store["experiment"].count() == 0
    assert archives.import_archives(store, str(tmp_path / "*.tar.gz")) == 1
    assert counts(store) == {"configuration": 1, "experiment": 1, "algorithm_scoring": 3, "scoring": 5, "algorithm_execution": 3, "algorithm_ranking": 2, "algorithm_ranking_entry": 2, "execution": 2, "runtime_trace": 2, "cleaning_metrics": 1}


def test_bad_archives_are_named(spark, tmp_path):
    made(tmp_path, "good")
    data = (tmp_path / "good.tar.gz").read_bytes()
    (tmp_path / "cut.tar.gz").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="cut.tar.gz"):
        archives.read_archives(spark, str(tmp_path / "cut.tar.gz")).collect()
    made(tmp_path, "bare", leave_out=("config.json",))
    with pytest.raises(archives.ArchiveError, match="bare"):
        archives.import_archives(Store(spark, str(tmp_path / "s")), str(tmp_path / "bare.tar.gz"))
    rows = archives.read_archives(spark, str(tmp_path / "good.tar.gz"))
    assert rows.where("member = 'tmp/cache/other.bin'").isEmpty() and rows.count() == 18


def test_baseline_folders(spark, tmp_path):
    for folder, parts in {f"select-{HASH}-vertical": 3, f"{HASH}-horizontal": 4, f"failed-select-{HASH}-x": 4, f"bare-{HASH}-y": 1, "nothing": 4}.items():
        at = tmp_path / "results" / folder
        at.mkdir(parents=True)
        (at / "metrics.json").write_text(json.dumps({"PrAUC": 0.5, "RangePrAUC": 0.25, "FScore": 1.0}))
        if parts > 1:
            (at / "scores.csv").write_text("0.5\n0.25\n\n")
        if parts > 2:
            (at / "config.json").write_text(json.dumps({"a": 1}))
        if parts > 3:
            (at / "runtime.txt").write_text("1500000000\n")
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError, match="name its baseline"):
        archives.import_baseline_folders(store, str(tmp_path / "results"))
    assert archives.import_baseline_folders(store, str(tmp_path / "results"), "own") == 2
    assert archives.import_baseline_folders(store, str(tmp_path / "results"), "own") == 0
    got = store["baseline_execution"].orderBy("name").select("name", "dataset_id", "runtime", "pr_auc", "range_pr_auc", "fscore").collect()
    assert [tuple(r) for r in got] == [("own-horizontal", HASH, 1.5, 0.5, 0.25, 1.0), ("select-vertical", HASH, None, 0.5, 0.25, 1.0)]
    assert store["algorithm_scoring"].count() == 2 and sorted(r["score"] for r in store["scoring"].collect()) == [0.25, 0.25, 0.5, 0.5]


def test_command_line(spark, tmp_path, capsys):
    from tsquorum.__main__ import main

    made(tmp_path, "2024-03-01_one")
    for want in ("1 new", "0 new"):
        assert main(["db", "--store", str(tmp_path / "store"), "load-result-backups", str(tmp_path / "2024-03-01_one.tar.gz")]) == 0
        assert want in capsys.readouterr().out
