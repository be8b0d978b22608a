"""Sharding by balanced label propagation, in DataFrame functions only.

Documents with equal texts are linked. Every document starts in the shard that a hash gives it. In each round a
group's documents want to go where most of the group already is; a group larger than a shard wants the fewest
shards that hold it. How much may move between two shards is a quota: what the two exchange evenly, plus the
target's free room. Movers are taken by rank until their quota is used up, a group's documents partly if need be.
Documents without links then fill the shards up to equal sizes.

Equal texts have equal sizes, so a round works on counts per (group, shard), at most ``n_shards`` rows a group;
single documents are matched with their shard at the end, by rank within the group. No group, shard or bucket
meets in one task: ranks and running sums are made over hash buckets, whose sums (a bounded table) are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsquorum.llm.common import Cuts, chunks_for, ranked

#: Buckets for running sums; bounds the tables of bucket sums.
BUCKETS = 4096
FLOW_BUCKETS = 256
GROUP = ["h", "text_crc32"]


def _before(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same keys before this one, by bucket, then ``order``."""
    df = df.withColumn("_bucket", bucket)
    sums = df.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    outer = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = df.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return within.join(starts, [*keys, "_bucket"]).withColumn(name, F.col("_start") + F.col("_within")).drop("_bucket", "_start", "_within")


def _propagate(state: DataFrame, capacity: float, n_shards: int, cuts: Cuts, rounds: int) -> DataFrame:
    """(h, text_crc32, size, shard, n): where the documents of each group go."""
    state = cuts.cut(state, "groups")
    for _ in range(rounds):
        by_count = Window.partitionBy(*GROUP).orderBy(F.col("n").desc(), F.pmod(F.col("shard") + F.col("h"), F.lit(n_shards)))
        whole = Window.partitionBy(*GROUP)
        wanted = (
            state.withColumn("_rank", F.row_number().over(by_count) - 1)
            .withColumn("_homes", F.greatest(F.lit(1), F.ceil(F.sum(F.col("n") * F.col("size")).over(whole) / F.lit(capacity))))
            .withColumn("_home", F.collect_list("shard").over(by_count.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        )
        target = F.get("_home", F.pmod(F.col("_rank"), F.col("_homes")).cast("int"))
        movers = wanted.where("_rank >= _homes").select(*GROUP, "size", F.col("shard").alias("src"), target.alias("dst"), "n", (F.col("n") * F.col("size")).alias("bytes"))
        movers = cuts.cut(movers, "movers")
        flow = movers.groupBy("src", "dst").agg(F.sum("bytes").alias("flow"))  # at most n_shards ** 2 rows
        back = flow.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("flow").alias("back"))
        loads = state.groupBy(F.col("shard").alias("dst")).agg(F.sum(F.col("n") * F.col("size")).alias("load"))
        inflow = Window.partitionBy("dst")
        even = F.least("flow", F.coalesce("back", F.lit(0)))
        room = F.greatest(F.lit(capacity) - F.coalesce("load", F.lit(0)), F.lit(0.0))
        quota = (
            flow.join(back, ["src", "dst"], "left").join(loads, "dst", "left")
            .select("src", "dst", even.alias("even"), (F.col("flow") - even).alias("rest"), room.alias("room"))
            .withColumn("quota", F.col("even") + F.col("rest") * F.least(F.lit(1.0), F.col("room") / F.greatest(F.sum("rest").over(inflow), F.lit(1))))
            .select("src", "dst", "quota")
        )
        placed = _before(movers, ["src", "dst"], F.pmod(F.xxhash64(*GROUP), F.lit(FLOW_BUCKETS)), GROUP, "bytes", "_before")
        fits = F.floor((F.col("quota") - F.col("_before")) / F.col("size"))
        taken = placed.join(F.broadcast(quota), ["src", "dst"]).withColumn("take", F.greatest(F.lit(0), F.least(F.col("n"), fits))).where("take > 0")
        taken = cuts.cut(taken.select(*GROUP, "size", "src", "dst", "take"), "taken")
        if taken.isEmpty():
            break
        moved = state.unionByName(taken.select(*GROUP, "size", F.col("src").alias("shard"), (-F.col("take")).alias("n"))).unionByName(taken.select(*GROUP, "size", F.col("dst").alias("shard"), F.col("take").alias("n")))
        state = cuts.cut(moved.groupBy(*GROUP, "size", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "groups")
        cuts.drop("groups", keep_last=True)
    return state


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16, rounds: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot per row: shards of nearly equal bytes, equal texts together where they fit.

    size is the text's UTF-8 bytes plus 1. A null text has none, the checksum of the empty text, and no links;
    empty texts are equal texts. Slots count from 0 in each shard. Null ids and repeated rows are rows like any
    other; other columns aren't read; an empty table gives no rows. Reruns on the same rows agree.
    """
    cuts = Cuts(docs.sparkSession)
    raw = F.col(text_col).cast("binary")
    slim = docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"), F.when(F.col(text_col).isNotNull(), F.xxhash64(raw)).alias("h"),
    )
    slim = cuts.cut(slim.withColumn("start", F.pmod(F.xxhash64("doc_id", "h", F.lit(7)), F.lit(n_shards)).cast("int")), "slim")
    total = slim.agg(F.sum("size")).first()[0] or 0
    capacity = max(total / n_shards, 1.0)

    linked = slim.where("h is not null").groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_all")).where("_all > 1")
    counts = slim.where("h is not null").groupBy(*GROUP, "size", F.col("start").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    state = _propagate(counts.join(linked, GROUP, "left_semi"), capacity, n_shards, cuts, rounds)

    upto = Window.partitionBy(*GROUP).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = state.select(*GROUP, F.struct(F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first"), "shard").alias("span"))
    homes = spans.groupBy(*GROUP).agg(F.array_sort(F.collect_list("span")).alias("spans"))  # at most n_shards spans
    joined = cuts.cut(slim.drop("start").join(homes, GROUP, "left"), "joined")

    chunks = chunks_for(slim.count())
    together = ranked(joined.where("spans is not null"), GROUP, ["doc_id"], "_rank", chunks)
    home = F.element_at(F.filter("spans", lambda s: s["first"] <= F.col("_rank")), -1)["shard"]
    together = together.select("doc_id", "size", "text_crc32", home.alias("shard"))

    loads = {r["shard"]: r["load"] for r in state.groupBy("shard").agg(F.sum(F.col("n") * F.col("size")).alias("load")).collect()}  # n_shards rows
    free = [max(capacity - (loads.get(s) or 0), 0.0) for s in range(n_shards)]
    alone = joined.where("spans is null").drop("spans")
    filled = sum(free)
    rest = total - sum(loads.values())
    edges, at = [], 0.0
    for s in range(n_shards - 1):
        at += free[s] * (rest / filled if filled else 0)
        edges.append(at)
    spread = _before(alone.withColumn("_one", F.lit(1)), ["_one"], F.pmod(F.xxhash64("doc_id", "h", F.lit(11)), F.lit(BUCKETS)), ["doc_id", "h"], "size", "_before").drop("_one")
    middle = F.col("_before") + F.col("size") / 2
    place = F.size(F.filter(F.array(*[F.lit(e) for e in edges] or [F.lit(float("inf"))]), lambda e: e <= middle))
    apart = spread.select("doc_id", "size", "text_crc32", place.cast("int").alias("shard"))
    return ranked(cuts.cut(together.unionByName(apart), "sharded"), ["shard"], ["doc_id", "text_crc32"], "slot", max(1024, chunks))
