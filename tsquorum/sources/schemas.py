"""Fixed schemas. Nothing is inferred from files.

Fixed values: the names and types of the result store's tables and of the exchange files.
"""

from __future__ import annotations

SERIES = "series_id string, t bigint, value double, is_anomaly boolean"
SCORES = "dataset_id string, instance string, t bigint, score double"
RESULTS = "algorithm string, params string, dataset string, quality double, duration double"
TRACE = "timer string, type string, begin_ns bigint, end_ns bigint, duration_ns bigint"
TRIALS = "algorithm string, dataset string, trial bigint, params string, quality double, duration double"
SEARCH_STATE = "algorithm string, dataset string, status string, n_completed bigint, n_desired bigint, best_score double, best_params string, seed_params array<string>, proxy string"

METRICS = (
    "pr_auc double, roc_auc double, range_pr_auc double, range_roc_auc double, range_pr_vus double, range_roc_vus double, precision_at_k double, "
    "range_precision double, range_recall double, range_fscore double, precision double, recall double, fscore double"
)

STORE: dict[str, str] = {
    "dataset": "hexhash string, name string, collection string, paper boolean, revision boolean",
    "timeseries": "dataset_id string, time bigint, value double, is_anomaly boolean",
    "configuration": "id string, config string, description string",
    "experiment": "id bigint, name string, description string, date timestamp",
    "algorithm_scoring": "id bigint, dataset_id string, experiment_id bigint, algorithm string, hyper_params_id string, hyper_params string, range_pr_auc double, range_roc_auc double, precision_at_k double, runtime double",
    "scoring": "algorithm_scoring_id bigint, time bigint, score double",
    "algorithm_ranking": "id bigint, experiment_id bigint",
    "algorithm_ranking_entry": "ranking_id bigint, rank bigint, algorithm_scoring_id bigint",
    "algorithm_execution": "id bigint, algorithm_scoring_id bigint, experiment_id bigint, mean_train_quality double, no_datasets bigint, quality double",
    "execution": f"id bigint, dataset_id string, config_id string, experiment_id bigint, version string, ranking_method string, normalization_method string, aggregation_method string, algorithm_ranking_id bigint, runtime double, {METRICS}",
    "baseline_execution": f"id bigint, dataset_id string, name string, algorithm_ranking_id bigint, algorithm_scoring_id bigint, runtime double, {METRICS}",
    "runtime_trace": "experiment_id bigint, position bigint, trace_name string, trace_type string, begin_ns bigint, end_ns bigint, duration_ns bigint",
    "cleaning_metrics": "experiment_id bigint, dataset_id string, precision double, recall double, f1 double, f10 double",
}
