"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut into halves; each half has a codebook of its own, and the pairs of codewords form a grid of
cells. A vector visits cells in the order in which they could hold a near vector (multi-sequence traversal over the
two sorted lists of half bounds). A bound is how far the half would have to shift to fall into the codeword's
region; two unit vectors with cosine ``least`` are at most sqrt(2 - 2 * least) apart, so once the bounds of both
halves together exceed that, no further cell can hold a link: the traversal stops at a recall of 1. What a cell
holds is then verified in double precision. Visits carry a vector's components as the table has them (float or
double), from which the units in double precision are made again where they meet.

Codebooks come from a bounded sample (``SAMPLE`` vectors); every vector is indexed. Equal vectors are one class
with a multiplicity. Members and visitors of a cell are dealt into tiles of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsquorum.llm.common import Cuts, released
from tsquorum.llm.graph import components

LEAST = 0.98
#: Vectors that the codebooks are fitted on, the first by a hash of their id.
SAMPLE = 20_000
#: Bytes of the sample in double precision; of very long vectors fewer are sampled, 1000 at least.
SAMPLE_BYTES = 64 << 20
#: Rows of a block; a tile compares two blocks.
BLOCK = 2048
#: Vectors a cell would hold if all had one label; settles the number of codewords per half.
PER_CELL = 2000
MOST_WORDS = 256


def codebook(half: np.ndarray, words: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """k-means codewords of the rows, seeded by spread-out rows; at most as many as there are distinct rows."""
    distinct = np.unique(half, axis=0)
    if len(distinct) <= words:
        return distinct
    rng = np.random.default_rng(seed)
    centres = distinct[[rng.integers(len(distinct))]]
    nearest = ((distinct - centres[0]) ** 2).sum(axis=1)
    while len(centres) < words and nearest.sum() > 0:
        centres = np.vstack([centres, distinct[rng.choice(len(distinct), p=nearest / nearest.sum())]])
        nearest = np.minimum(nearest, ((distinct - centres[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        near = squared(half, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, half)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def squared(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((rows**2).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(axis=1), 0)


def bounds(half: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own codeword of each row, and per codeword the squared shift at least needed to have that one."""
    d = squared(half, words)
    own = d.argmin(axis=1)
    apart = np.sqrt(squared(words, words))[own]
    lead = d - d[np.arange(len(d)), own][:, None]
    return own, (np.divide(lead, 2 * apart, out=np.zeros_like(d), where=apart > 0)) ** 2


def multi_sequence(first: np.ndarray, second: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) by growing first[i] + second[j], up to ``limit``."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen = [(first[one[0]] + second[two[0]], 0, 0)], {(0, 0)}
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > limit:
            return
        yield int(one[i]), int(two[j])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(one) and b < len(two) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (first[one[a]] + second[two[b]], a, b))


def _units(column: pa.Array, dim: int) -> np.ndarray:
    return _unit_rows(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def fit(sample: list[np.ndarray], words: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Two codebooks for each length of vector in the sample."""
    books = {}
    for dim in sorted({len(v) for v in sample if len(v) > 1}):
        rows = np.array([v for v in sample if len(v) == dim])
        books[dim] = codebook(rows[:, : dim // 2], words), codebook(rows[:, dim // 2 :], words)
    return books


def _unit_rows(raw: np.ndarray) -> np.ndarray:
    flat = raw.astype(np.float64)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # neither huge nor tiny components overflow
    return flat / np.sqrt((flat**2).sum(axis=1, keepdims=True))


def _visits(classes: DataFrame, books: dict, least: float) -> DataFrame:
    """A member row per class in its own cell, and a visitor row in each later cell that may hold a link."""
    shared = classes.sparkSession.sparkContext.broadcast(books)
    limit = (2 - 2 * least) * (1 + 1e-9) + 1e-12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim").to_numpy())
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                rows = _units(part.column("embedding"), int(dim))
                at, cells = list(range(len(rows))), [0] * len(rows)
                visitor = [False] * len(rows)
                if dim in shared.value:
                    one, two = shared.value[dim]
                    (own1, need1), (own2, need2) = bounds(rows[:, : dim // 2], one), bounds(rows[:, dim // 2 :], two)
                    cells = (own1 * len(two) + own2).tolist()
                    for r in range(len(rows)):
                        later = [c for i, j in multi_sequence(need1[r], need2[r], limit) if (c := i * len(two) + j) > cells[r]]
                        at += [r] * len(later)
                        cells += later
                        visitor += [True] * len(later)
                taken = part.select(["label", "dim", "node", "n"]).take(pa.array(at, pa.int64()))
                raw = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, int(dim))
                units = pa.array([raw[r].tobytes() for r in at], pa.binary())
                yield pa.RecordBatch.from_arrays([taken.column("label"), taken.column("dim"), pa.array(cells, pa.int64()), pa.array(visitor), taken.column("node"), taken.column("n"), units], ["label", "dim", "cell", "visitor", "node", "n", "raw"])

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("label", "dim", "node", "n", "embedding").mapInArrow(released(run), f"label {kind}, dim int, cell bigint, visitor boolean, node bigint, n bigint, raw binary")


def _tile(rows: pd.DataFrame, least: float, kind: str) -> pd.DataFrame:
    """Links within a tile: per class the multiplicity it links with, and the smallest class it reaches here."""
    node, n, block = rows["node"].to_numpy(), rows["n"].to_numpy(), rows["block"].to_numpy()
    unit = _unit_rows(np.frombuffer(b"".join(rows["raw"]), kind).reshape(len(rows), -1))
    order = np.argsort(node, kind="stable")
    node, n, block, unit = node[order], n[order], block[order], unit[order]
    mode, visitor = rows["mode"].iloc[0], rows["visitor"].to_numpy()[order]
    links, label = np.zeros(len(node), np.int64), np.arange(len(node))
    for lo in range(0, len(node), 512):
        here = np.arange(lo, min(lo + 512, len(node)))
        near = unit[here] @ unit.T >= least
        near[here - lo, here] = False
        if mode == 2:  # two blocks: across only
            near &= block[here][:, None] != block
        else:  # visitors meet members only
            near &= ~(visitor[here][:, None] & visitor)
        links[here] = near @ n
        for r in np.flatnonzero(near.any(axis=1)):
            met = np.unique(label[np.append(np.flatnonzero(near[r]), lo + r)])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    some = links > 0
    return pd.DataFrame({"node": node[some], "links": links[some], "root": node[label[some]]})


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row; only vectors of one label and length are compared.

    Vectors that are null, zero, or hold null or non-finite components, and those without label or id, link with
    nothing: n_links 0, component_id their own id, kept true. Ids must be integers; repeated rows count as
    vectors of their own. Other columns aren't read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    cuts = Cuts(spark)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine & F.exists("embedding", lambda x: x != 0)
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("embedding"))
    rows = rows.select("vec_id", "label", "embedding", F.coalesce(usable, F.lit(False)).alias("usable"), F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))
    key = ["label", "dim", "k1", "k2"]
    keyed = rows.where("usable")
    grouped = cuts.cut(keyed.groupBy(*key).agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")), "classes")
    one = keyed.select("label", "dim", "k1", "k2", "vec_id", "embedding").join(grouped.withColumnRenamed("node", "vec_id"), [*key, "vec_id"]).dropDuplicates([*key])
    classes = cuts.cut(one.select("label", "dim", F.col("vec_id").alias("node"), "n", "embedding"), "vectors")

    n = classes.count()
    words = int(min(MOST_WORDS, max(2, (n / PER_CELL) ** 0.5)))
    widest = max(1, classes.agg(F.max("dim")).first()[0] or 1)
    most = min(SAMPLE, max(1000, SAMPLE_BYTES // (8 * widest)))
    picked = classes.orderBy(F.xxhash64("node"), "node").limit(most).select("embedding").toArrow().column(0)
    books = fit([_unit_rows(v.values.to_numpy(zero_copy_only=False)[None])[0] for v in picked], words)

    visits = cuts.cut(_visits(classes, books, least), "visits")
    cell = ["label", "dim", "cell"]
    sizes = visits.groupBy(*cell).agg(F.ceil(F.count_if(~F.col("visitor")) / BLOCK).cast("int").alias("sm"), F.ceil(F.count_if("visitor") / BLOCK).cast("int").alias("sp"))
    placed = visits.join(sizes.where("sm > 0"), cell)
    share = F.pmod(F.xxhash64("node"), F.when(F.col("visitor"), F.col("sp")).otherwise(F.col("sm"))).cast("int")
    placed = placed.withColumn("block", F.when(F.col("visitor"), F.col("sm") + share).otherwise(share))
    single = (F.col("sm") == 1) & (F.col("sp") <= 1)
    others = F.when(F.col("visitor"), F.sequence(F.lit(0), F.col("sm") - 1)).otherwise(F.sequence(F.lit(0), F.col("sm") + F.col("sp") - 1))
    tiled = placed.withColumn("other", F.explode(F.when(single, F.array(F.lit(-1))).otherwise(others)))
    tiled = tiled.withColumns({
        "t1": F.when(F.col("other") < 0, -1).otherwise(F.least("block", "other")), "t2": F.when(F.col("other") < 0, -1).otherwise(F.greatest("block", "other")),
        "mode": F.when(F.col("other") < 0, 0).when(F.col("other") == F.col("block"), 1).otherwise(2),
    })
    met = tiled.groupBy(*cell, "t1", "t2").applyInPandas(lambda rows: _tile(rows, least, "float32" if kind == "float" else "float64"), "node bigint, links bigint, root bigint")
    met = cuts.cut(met, "links")
    comps = components(met.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")), cuts)
    found = met.groupBy("node").agg(F.sum("links").alias("links")).join(comps, "node", "left")
    of_class = grouped.join(found, "node", "left").select(*key, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = keyed.select("vec_id", *key).join(of_class, key).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
