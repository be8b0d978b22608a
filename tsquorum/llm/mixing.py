"""Mixing sources to target weights.

Tokens are aggregated per source, target shares give a repetition rate per source, and each document is
emitted ``floor(rate)`` times plus one hash-seeded Bernoulli copy with probability ``rate - floor(rate)``.

The hash has ``SEEDS`` seeds to choose from; each source takes the one whose draws bring it nearest to its target.
So sources with few or very unequal documents come near theirs, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsquorum.llm.common import Cuts, join_spread, unit_draw, word_count


SEEDS = 16


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.0, max_repeat: float = 3.0) -> DataFrame:
    """Targets per source, from (source, source_size).

    Sources in code point order, null last, weigh ``weights``, repeating. The weights share ``share`` of all
    sizes; a target stops at ``max_repeat`` times its source's size and the excess is reshared by weight among
    the rest, until none is above. Sources without words get 0. No sources: no rows.

    The resharing settles at ``min(max_repeat * size, weight * level)``; the level is found from running sums
    over the sources in the order in which they reach their limit. One row per source goes through this.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("_weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    limit = F.col("source_size") * F.lit(float(max_repeat))
    ramp = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("source").isNull(), F.col("source"))
    all_rows = Window.partitionBy()
    steps = (
        weighed.withColumn("_limit", limit)
        .withColumn("_total", F.sum("source_size").over(all_rows) * F.lit(float(share)))
        .withColumn("_capped", F.coalesce(F.sum("_limit").over(ramp.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(ramp.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_place", F.row_number().over(ramp))
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_open"))
    )
    # The first source whose limit isn't reached at its level ends the capping; its level holds for all after it.
    open_at = F.min(F.when(F.col("_limit") >= F.col("_weight") * F.col("_level"), F.struct("_place", F.col("_level").alias("level")))).over(all_rows)
    level = F.coalesce(open_at["level"], F.lit(float("inf")))
    target = F.round(F.least(F.col("_limit"), F.col("_weight") * level), 6)
    return steps.select("source", "source_size", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0)).alias("target"))


def copies(rate: Column, draw: Column) -> Column:
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, keep: tuple[str, ...] = (), **targets) -> DataFrame:
    """Per document: doc_id, source, ``keep`` columns, size, source_size, target, copies.

    Null text has size 0; null source is a source of its own; a null id draws by its text, and repeated rows
    draw alike. Long texts count whole; equal documents of two sources draw by their source's seed. Other columns of the input aren't looked at unless named in ``keep``; an empty table gives none.
    """
    cuts = Cuts(docs.sparkSession)
    text, kept = F.col(text_col), F.struct(*[F.col(c) for c in keep] or [F.lit(0).alias("_")]).alias("_kept")
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(text, F.lit("")))).alias("_key")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), key, kept)
    # Words are counted once: what the plan returns is written with the sizes, unless whole rows would be.
    slim = cuts.cut(rows.select("source", "size", "_key") if keep else rows, "mix-sizes")
    table = cuts.cut(source_targets(slim.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), **targets), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    seeds = range(seed, seed + SEEDS)
    taken = [F.sum(F.col("size") * copies(rate, unit_draw(F.lit(str(k)), F.col("_key")))).alias(f"_taken_{k}") for k in seeds]
    sums = join_spread(slim, table, "source").groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), *taken)
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"_taken_{k}") - F.col("target")), F.lit(k).alias("seed")) for k in seeds]))["seed"]
    chosen = cuts.cut(sums.select("source", "source_size", "target", best.cast("string").alias("_seed")), "mix-seeds")
    joined = join_spread(rows if keep else slim, chosen, "source").withColumn("copies", copies(rate, unit_draw(F.col("_seed"), F.col("_key"))))
    cuts.drop("mix-targets")
    if keep:
        cuts.drop("mix-sizes")
    return joined.select("doc_id", "source", *[F.col("_kept")[c].alias(c) for c in keep], "size", "source_size", "target", "copies")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: the input's rows and columns, each row as often as the mix takes it."""
    renamed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no column can clash with those of the plan
    new = dict(zip(docs.columns, renamed.columns, strict=True))
    planned = plan_mix(renamed, id_col=new[id_col], text_col=new[text_col], source_col=new[source_col], keep=tuple(renamed.columns), **options)
    rows = planned.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return rows.select(*[F.col(n).alias(c) for c, n in new.items()])
