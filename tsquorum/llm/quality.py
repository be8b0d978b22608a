"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base rules reject by fixed limits. On top, every rule of ``RULES`` (one signal, a grid of cutoffs) gets a cutoff
per stratum from labelled documents held out for this: a cutoff counts as safe when the exact binomial test
rejects "more than ``alpha`` of good documents fall beyond it" at a level corrected for all strata and rules.
Within a rule the cutoffs are tested from the mildest on, up to the first that fails (fixed-sequence testing), so
the grid needs no further correction. With probability ``1 - delta`` no stratum loses more than ``alpha`` of its
good documents to any rule, so at most ``alpha * len(RULES)`` to all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsquorum.llm.common import Cuts, join_spread, let

WINDOW = 8

#: Signal, its expression over the base counts, and cutoffs from the mildest to the strictest. A document whose
#: signal is above the cutoff is rejected.
RULES: tuple[tuple[str, str, tuple[float, ...]], ...] = (
    ("symbols", "n_symbols / greatest(word_chars, 1)", (0.3, 0.2, 0.15, 0.1, 0.07, 0.05)),
    ("dup_lines", "n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4)),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", (0.25, 0.2, 0.15, 0.12, 0.1)),
    ("long_words", "word_chars / greatest(n_words, 1)", (14.0, 12.0, 11.0, 10.0, 9.0)),
)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in ``window``-word windows found twice or more in ``words``, the first ones included."""

    def covered(positions: Column) -> Column:  # sorted window starts; each covers up to the next start
        gaps = F.zip_with(positions, F.slice(positions, F.lit(2), F.size(positions)), lambda a, b: F.least(b - a, F.lit(window)))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + F.coalesce(gap, F.lit(window)))

    def of_sorted(pairs: Column) -> Column:
        starts = F.filter(
            pairs,
            lambda pair, i: (F.get(pairs, i - 1)["h"].eqNullSafe(pair["h"]) & (i > 0)) | F.get(pairs, i + 1)["h"].eqNullSafe(pair["h"]),
        )
        return let(F.array_sort(F.transform(starts, lambda pair: pair["i"])), covered)

    def of_hashes(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, of_sorted))

    def of_word_hashes(one: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(one) - F.lit(window))
        return let(F.transform(starts, lambda i: F.xxhash64(*[F.get(one, i + k) for k in range(window)])), of_hashes)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > window, let(hashed, of_word_hashes)).otherwise(F.lit(0)).cast("long")


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` as a struct ``kept``, and the base counts of each whole text; null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.struct(*[F.col(c) for c in keep] or [F.lit(0).alias("_")]).alias("kept"), text.alias("text"))
    # One literal blank between words lets split() take its fast way.
    blank = F.translate("text", "\t\n\x0b\x0c\r", "     ")
    lines = F.filter(F.split("text", "\n"), lambda line: F.translate(line, " \t\x0b\x0c\r", "") != "")
    rows = slim.select("doc_id", "kept", "text", F.array_remove(F.split(blank, " "), "").alias("words"), lines.alias("lines"))
    return rows.select(
        "doc_id", "kept", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed term by term in logarithms; exact up to rounding."""
    first = n.cast("double") * F.lit(math.log1p(-p))
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1).cast("double") / i.cast("double")) + F.lit(math.log(p) - math.log1p(-p))
        top, low = F.greatest(term, state["total"]), F.least(term, state["total"])
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(low - top))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.aggregate(steps, start, step, lambda state: F.exp(F.least(state["total"], F.lit(0.0))))


def safe_cutoffs(signals: DataFrame, labels: DataFrame, *, alpha: float = 0.02, delta: float = 0.1, label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(stratum, rule, cutoff): the strictest cutoff that the held-out good documents allow; none, no row.

    ``signals`` has doc_id, stratum and a column per rule of those that the base rules pass. All labelled
    documents count; cutoffs come from a fixed grid, so no label is used twice. A document labelled twice counts
    once and as good only if all its labels are 1; labels for unknown documents are ignored.
    """
    good = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("doc_id")).agg(F.min(label).alias("_label")).where("_label = 1").select("doc_id")
    held = signals.join(good, "doc_id", "left_semi")
    counts = held.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(rule) > F.lit(cut)).alias(f"{rule}_{i}") for rule, _, cuts in RULES for i, cut in enumerate(cuts)],
    )
    grid = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("place"), F.lit(cut).alias("cutoff"), F.col(f"{rule}_{i}").alias("k"))
        for rule, _, cuts in RULES for i, cut in enumerate(cuts)
    ])
    counts = Cuts(signals.sparkSession).cut(counts, "quality-strata")
    level = F.lit(delta / (max(1, counts.count()) * len(RULES)))
    tests = counts.select("stratum", "n", F.explode(grid).alias("t")).select("stratum", "n", "t.*")
    possible = F.col("k") < F.col("n") * F.lit(alpha)  # else the tail is about one half at least
    passed = F.when(possible, binomial_tail(F.col("k"), F.col("n"), alpha) <= level).otherwise(F.lit(False))
    tested = tests.withColumn("passed", passed)
    stops = tested.groupBy("stratum", "rule").agg(F.min(F.when(~F.col("passed"), F.col("place"))).alias("stop"))
    safe = tested.join(stops, ["stratum", "rule"]).where(F.col("stop").isNull() | (F.col("place") < F.col("stop")))
    return safe.groupBy("stratum", "rule").agg(F.max_by("cutoff", "place").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", keep: tuple[str, ...] = (), alpha: float = 0.02, delta: float = 0.1) -> DataFrame:
    """doc_id, the base counts, base_failed, ``failed_rules`` (names), kept, and the ``keep`` columns as struct ``kept_cols``.

    Null text is empty and fails the base rules; a null stratum is a stratum of its own; a null id is judged but
    never labelled; repeated rows are judged alike. Without labels there are no cutoffs and only the base rules
    reject. Long texts are measured whole. Columns may have any names but ``_stratum``. An empty table gives no rows.
    """
    cuts = Cuts(docs.sparkSession)
    named = docs.withColumn("_stratum", F.col(stratum_col) if stratum_col in docs.columns else F.lit(None).cast("string"))
    names = [rule for rule, _, _ in RULES]

    def signals(counts: DataFrame) -> DataFrame:
        stratum = F.coalesce(F.col("kept._stratum").cast("string"), F.lit(""))
        return counts.withColumns({"stratum": stratum, "base_failed": base_failed(), **{rule: F.expr(f"cast({signal} as double)") for rule, signal, _ in RULES}})

    judged = measured(named, id_col=id_col, text_col=text_col, keep=("_stratum", *keep))
    if keep:  # the counts would be written with whole rows, so labelled documents are measured apart, for the cutoffs
        known = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("_labelled")).distinct()
        labelled = measured(named.join(known, named[id_col] == known["_labelled"], "left_semi"), id_col=id_col, text_col=text_col, keep=("_stratum",))
    else:
        judged = labelled = cuts.cut(judged, "quality-counts")
    found = safe_cutoffs(signals(labelled).where(~F.col("base_failed")).select("doc_id", "stratum", *names), labels, alpha=alpha, delta=delta)
    per_stratum = cuts.cut(found.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")), "quality-cutoffs")
    failed = F.array(*[F.when(F.col(rule) > F.col("cutoffs")[rule], F.lit(rule)) for rule in names])
    return join_spread(signals(judged), per_stratum, "stratum").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.array_compact(failed).alias("failed_rules"), (~F.col("base_failed") & (F.size(F.array_compact(failed)) == 0)).alias("kept"), F.col("kept").alias("kept_cols"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    renamed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no column can clash with those of the rules
    new = dict(zip(docs.columns, renamed.columns, strict=True))
    columns = {k: new.get(options.pop(k, default), default) for k, default in (("id_col", "doc_id"), ("text_col", "text"), ("stratum_col", "lang"))}
    judged = judge(renamed, labels, **columns, keep=tuple(renamed.columns), **options).where("kept")
    return judged.select(*[F.col("kept_cols")[n].alias(c) for c, n in new.items()])
