"""Hard-negative mining by a vector-approximation file.

Vectors become integers (``floor(scale * x)``) and are dealt into blocks. A block is its own approximation file: each
dimension is cut into ``CELLS`` cells of about equal numbers of rows, a row is the numbers of its cells (two to a
byte), and a cell is known by the least and the greatest component in it. For an anchor, the least and the greatest
product that a component of each cell can give are put into a table; a row's bounds are the sums of its table entries.

Two scans meet every block of anchors with every block of rows. The first finds each anchor's positives: rows of its label whose
upper bound reaches the k-th greatest lower bound are scored exactly. The second finds negatives: every positive opens a
window of scores, and only rows of other labels whose bounds overlap a window, and which the rows surely within it don't already outdo,
are scored exactly. A block gives its best rows; what is best in all blocks is taken by a ranking that Spark limits before it shuffles.
Results are exact: bounds only spare work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tsquorum.llm.common import Cuts

CELLS = 16
#: Rows of a block, and bytes of its components at eight a number; anchors of a block.
LEAST_ROWS, MOST_ROWS, BLOCK_BYTES = 2048, 1 << 16, 64 << 20
ANCHORS = 2048
#: Anchors whose bounds are looked up together.
TOGETHER = 16


class Approximation:
    """Rows (of one length) as cells, with the components that each cell spans."""

    def __init__(self, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.cells, self.low, self.high = cells, low, high

    @classmethod
    def of(cls, rows: np.ndarray) -> Approximation:
        n, dim = rows.shape
        wide = dim + dim % 2  # an odd last dimension is paired with one of zeros
        cells, low, high = np.zeros((wide, n), np.uint8), np.zeros((wide, CELLS), np.int64), np.zeros((wide, CELLS), np.int64)
        for d in range(dim):
            x = rows[:, d]
            marks = np.sort(x)[np.arange(1, CELLS) * n // CELLS]
            cells[d] = np.searchsorted(marks, x, side="right")
            order = np.argsort(cells[d], kind="stable")
            some, first = np.unique(cells[d][order], return_index=True)
            low[d, some], high[d, some] = np.minimum.reduceat(x[order], first), np.maximum.reduceat(x[order], first)
        return cls(cells[0::2] * np.uint8(CELLS) + cells[1::2], low, high)

    def bounds(self, anchors: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that each of ``rows`` can have with each anchor, (rows, anchors)."""
        q = np.zeros((len(anchors), len(self.low)), np.int64)
        q[:, : anchors.shape[1]] = anchors
        one, two = q[:, :, None] * self.low, q[:, :, None] * self.high
        cells = self.cells[:, rows]
        out = []
        for edge in (np.minimum(one, two), np.maximum(one, two)):
            table = (edge[:, 0::2, :, None] + edge[:, 1::2, None, :]).reshape(len(anchors), -1, CELLS * CELLS).transpose(1, 2, 0).copy()
            total = np.zeros((cells.shape[1], len(anchors)), np.int64)
            for entries, at in zip(table, cells, strict=True):
                total += entries[at]
            out.append(total)
        return out[0], out[1]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by falling score, then rising id."""
    return np.lexsort((ids, -scores))[:k]


def _positives(rows: dict, anchors: dict, k: int) -> dict[str, np.ndarray]:
    """Per anchor the ``k`` best rows of its label in a block, other than itself."""
    found: dict[str, list] = {"anchor": [], "other": [], "id": [], "score": []}
    for label in np.unique(anchors["label"]):
        here = slice(*np.searchsorted(rows["label"], [label, label], side="left") + [0, np.count_nonzero(rows["label"] == label)])
        if here.start == here.stop:
            continue
        uid, ids, vectors = rows["uid"][here], rows["id"][here], rows["vector"][here]
        asked = np.flatnonzero(anchors["label"] == label)
        for lo in range(0, len(asked), TOGETHER):
            some = asked[lo : lo + TOGETHER]
            low, high = rows["file"].bounds(anchors["vector"][some], here)
            for j, a in enumerate(some):
                other = uid != anchors["uid"][a]
                sure = low[other, j]
                need = np.partition(sure, -k)[-k] if len(sure) > k else None
                at = np.flatnonzero(other & (high[:, j] >= need) if need is not None else other)
                scores = vectors[at] @ anchors["vector"][a]
                top = _best(scores, ids[at], k)
                found["anchor"].append(np.full(len(top), anchors["uid"][a]))
                found["other"].append(uid[at][top])
                found["id"].append(ids[at][top])
                found["score"].append(scores[top])
    return {name: np.concatenate(parts) if parts else np.zeros(0, np.int64) for name, parts in found.items()}


def _negatives(rows: dict, anchors: dict, k: int, share: tuple[int, int]) -> dict[str, np.ndarray]:
    """Per anchor and positive the ``k`` best rows of other labels in a block whose score lies in the positive's window."""
    found: dict[str, list] = {"anchor": [], "place": [], "id": [], "score": []}
    for lo in range(0, len(anchors["uid"]), TOGETHER):
        some = np.arange(lo, min(lo + TOGETHER, len(anchors["uid"])))
        low, high = rows["file"].bounds(anchors["vector"][some], slice(None))
        for j, a in enumerate(some):
            other = np.flatnonzero(rows["label"] != anchors["label"][a])
            least, most = low[other, j], high[other, j]
            windows, wanted = [], np.zeros(len(other), bool)
            for place, score in enumerate(anchors["positives"][a]):
                first, last = -(-share[0] * score // 100), share[1] * score // 100
                if first > last:
                    continue
                possible = (most >= first) & (least <= last)
                sure = least[(least >= first) & (most <= last)]
                if len(sure) > k:
                    possible &= most >= np.partition(sure, -k)[-k]
                windows.append((place, first, last))
                wanted |= possible
            at = other[wanted]
            if not len(at):
                continue
            scores, ids = rows["vector"][at] @ anchors["vector"][a], rows["id"][at]
            for place, first, last in windows:
                within = np.flatnonzero((scores >= first) & (scores <= last))
                top = within[_best(scores[within], ids[within], k)]
                found["anchor"].append(np.full(len(top), anchors["uid"][a]))
                found["place"].append(np.full(len(top), place))
                found["id"].append(ids[top])
                found["score"].append(scores[top])
    return {name: np.concatenate(parts) if parts else np.zeros(0, np.int64) for name, parts in found.items()}


def _block(group: pa.Table, scale: float, approximate: bool) -> dict[str, bytes]:
    """A group's rows by label, their integers, and their approximation file."""
    n = group.num_rows
    raw = group.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vector = np.floor(scale * raw.reshape(n, -1))
    if n and vector.size and not np.square(np.abs(vector).max()) * vector.shape[1] < 2.0**62:
        raise ArithmeticError("scores of such vectors may not fit into 64 bits")
    order = np.lexsort((group.column("uid").to_numpy(), group.column("label").to_numpy()))
    vector = vector.astype(np.int64)[order]
    out = {c: group.column(c).to_numpy().astype("<i8")[order].tobytes() for c in ("uid", "id", "label")} | {"vector": _narrow(vector)}
    file = Approximation.of(vector) if approximate else None
    return out | ({"cells": file.cells.tobytes(), "low": file.low.astype("<i8").tobytes(), "high": file.high.astype("<i8").tobytes()} if file else dict.fromkeys(("cells", "low", "high"), b""))


def _narrow(vector: np.ndarray) -> bytes:
    kind = "<i2" if not vector.size or np.abs(vector).max() < 1 << 15 else "<i8"
    return kind[1:].encode() + vector.astype(kind).tobytes()


def _opened(row: dict) -> dict:
    """What ``_block`` wrote, as arrays."""
    out = {c: np.frombuffer(row[c], "<i8") for c in ("uid", "id", "label")}
    n, dim = len(out["uid"]), row["dim"]
    out["vector"] = np.frombuffer(row["vector"][2:], "<" + row["vector"][:2].decode()).astype(np.int64).reshape(n, dim)
    if row.get("cells") is not None:
        wide = dim + dim % 2
        out["file"] = Approximation(np.frombuffer(row["cells"], np.uint8).reshape(wide // 2, n), *(np.frombuffer(row[c], "<i8").reshape(wide, CELLS) for c in ("low", "high")))
    return out


def mine_negatives(
    vectors: DataFrame, anchors: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90), scale: float = 256.0,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchors`` holds.

    Scores are inner products of the integers ``floor(scale * x)``; higher ones come first, ties by smaller id. An anchor's
    positives are its first ``positives`` other rows of the same label; for each, the first ``negatives`` rows of other labels
    are returned whose score lies between the two percentages ``share`` of the positive's score, ranked from 1. Where that
    score is negative no window is open.

    Rows take no part whose id, label or vector is null, or with a null or non-finite component. Vectors of different
    lengths don't meet; empty ones score 0. Repeated rows are rows of their own, so an id may be anchor, positive or negative more than
    once. Labels that aren't integers are compared by a 64-bit hash; ids must be integers. Scores that might
    not fit into 64 bits raise ArithmeticError. Other columns aren't read, whatever their names, except in ``anchors``; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    cuts = Cuts(spark)
    label = F.col(label_col).cast("bigint") if isinstance(vectors.schema[label_col].dataType, IntegralType) else F.when(F.col(label_col).isNotNull(), F.xxhash64(label_col))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows = rows.where("id is not null and label is not null and embedding is not null").where(fine)
    rows = cuts.cut(rows.select(F.monotonically_increasing_id().alias("uid"), "id", "label", "asks", F.size("embedding").alias("dim"), "embedding"), "rows")

    n, n_anchors, widest = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.coalesce(F.max("dim"), F.lit(1))).first()
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(1, min(max(LEAST_ROWS, min(MOST_ROWS, n // tasks)), BLOCK_BYTES // (8 * max(1, widest))))
    n_rb, n_ab = -(-n // size) or 1, -(-n_anchors // ANCHORS) or 1

    def row_blocks(key: tuple, group: pa.Table) -> pa.Table:
        made = _block(group, scale, True)
        return pa.table({"rb": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([key[1].as_py()], pa.int32()), **{c: pa.array([v], pa.binary()) for c, v in made.items()}})

    def anchor_blocks(key: tuple, group: pa.Table) -> pa.Table:
        made = _block(group, scale, False)
        order = np.lexsort((group.column("uid").to_numpy(), group.column("label").to_numpy()))
        scores = group.column("scores").take(pa.array(order))
        return pa.table({"ab": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([key[1].as_py()], pa.int32()), **{f"a_{c}": pa.array([made[c]], pa.binary()) for c in ("uid", "id", "label", "vector")}, "a_scores": pa.array([scores.to_pylist()], pa.list_(pa.list_(pa.int64())))})

    whole = "uid binary, id binary, label binary, vector binary"
    dealt = rows.withColumn("rb", F.pmod(F.xxhash64("uid"), F.lit(n_rb)).cast("int"))
    blocks = cuts.cut(dealt.groupBy("rb", "dim").applyInArrow(row_blocks, f"rb int, dim int, {whole}, cells binary, low binary, high binary"), "blocks")

    def met(asking: DataFrame, scan, columns: list[str]) -> DataFrame:
        """Every block of anchors with every block of rows of its length."""
        asked = asking.withColumn("ab", F.pmod(F.xxhash64("uid"), F.lit(n_ab)).cast("int")).groupBy("ab", "dim").applyInArrow(
            anchor_blocks, "ab int, dim int, " + ", ".join(f"a_{c}" for c in whole.split(", ")) + ", a_scores array<array<bigint>>"
        )
        left = blocks.withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(n_ab - 1))))
        right = asked.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_rb - 1))))

        def tile(one: pa.Table, two: pa.Table) -> pa.Table:
            found = dict.fromkeys(columns, np.zeros(0, np.int64))
            if one.num_rows and two.num_rows:
                a = two.to_pylist()[0]
                own = _opened({c[2:]: v for c, v in a.items() if c[:2] == "a_"} | {"dim": a["dim"]}) | {"positives": a["a_scores"]}
                found = scan(_opened(one.to_pylist()[0]), own)
            return pa.table({c: pa.array(found[c], pa.int64()) for c in columns})

        key = ["ab", "rb", "dim"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(tile, ", ".join(f"{c} bigint" for c in columns))

    def first(found: DataFrame, by: list[str], k: int, ties: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", *ties)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asking = rows.where("asks").select("uid", "id", "label", "dim", "embedding")
    bare = asking.withColumn("scores", F.array().cast("array<bigint>"))
    near = cuts.cut(first(met(bare, lambda r, a: _positives(r, a, positives), ["anchor", "other", "id", "score"]), ["anchor"], positives, ["other"]), "positives")
    taken = near.groupBy(F.col("anchor").alias("uid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("scores"))
    hard = met(asking.join(taken, "uid"), lambda r, a: _negatives(r, a, negatives, share), ["anchor", "place", "id", "score"])
    hard = first(hard, ["anchor", "place"], negatives, []).select("anchor", (F.col("place") + 1).cast("int").alias("of"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.select("anchor", F.col("rank").alias("of"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(asking.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return pairs.join(hard, ["anchor", "of"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
