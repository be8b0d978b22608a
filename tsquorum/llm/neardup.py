"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

Each document's shingle set gets ``TREES`` sequences of ``DEPTH`` MinHash values. A tree is the list of all
documents sorted by its sequence. Neighbours in a list share the longest prefixes there are around, so the depth
at which documents meet adapts to the region: long prefixes where many are alike, short ones elsewhere, down to
``LEAST_PREFIX`` values. Documents meet their ``REACH`` next neighbours and the first of their region. A sketch of
the MinHash values drops pairs that can't be similar; all others are confirmed on the full sets, except where
confirmed links already connect both ends. Then all pairs of a region that neither met nor are connected are
compared in tiles, so that a crowd of unlike documents between two alike ones hides no link.

Documents with equal sets are one node from the start, so copies meet once. Lists are dealt by ranges of the
whole sequence: a region of any size spreads over many tasks. Hot classes of copies and hot centres of regions are
split where rows are joined with them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from tsquorum.llm.common import Cuts, join_hot, released
from tsquorum.llm.graph import components

SHINGLE = 5
PERCENT = 75
TREES, DEPTH, LEAST_PREFIX, REACH = 16, 6, 2, 4
#: Estimated similarity below which a pair isn't looked at; the estimate's standard deviation is about 0.045.
FLOOR = 0.5
#: Estimated similarity from which a document takes its smallest partner to be confirmed first.
LIKELY = 0.82
#: Estimated similarity that a document needs with members of a component that it met without a link.
ALLOWED = 0.58
#: Rows of a block when components are compared.
BLOCK = 2048
#: Rows of a side of a tile when the pairs of a region are compared.
TILE = 1024
#: Shingles of a block or of a side of a tile; long texts make more, smaller ones.
SHINGLES = 1 << 21

_rng = np.random.default_rng(20240613)
_ODD = _rng.integers(0, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(0, 2**31, TREES * DEPTH, np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, TREES * DEPTH, np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingles, as sorted 64-bit hashes, of the text's words, A-Z lower-cased; of fewer words, one of all; none without words."""
    words = (text or b"").lower().split()  # bytes: both know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return _mixed(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64))
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    many = len(one) - size + 1
    mixed = np.zeros(many, np.uint64)
    for i in range(size):
        mixed += one[i : i + many] * _ODD[i]
    return np.unique(_mixed(mixed))


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES * DEPTH MinHash values of a non-empty set."""
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    out = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, ((low[at : at + 512, None] ^ _B) * _A).min(axis=0), out=out)
    return out


def _described(texts: list[bytes | None]) -> tuple[list, list, list, list]:
    sizes, prints, sigs, sketches = [], [], [], []
    for text in texts:
        s = shingle_set(text)
        sizes.append(len(s))
        if not len(s):
            prints.append(None), sigs.append(None), sketches.append(None)
            continue
        prints.append(np.array([s.sum(), np.bitwise_xor.reduce(_mixed(s ^ _ODD[0])), len(s)], np.uint64).tobytes())
        sig = signature(s)
        sigs.append(sig.astype(">u4").tobytes())
        nibbles = (sig >> np.uint32(4)).astype(np.uint8) & np.uint8(15)
        sketches.append((nibbles[::2] | nibbles[1::2] << np.uint8(4)).tobytes())
    return sizes, prints, sigs, sketches


def described(slim: DataFrame) -> DataFrame:
    """(doc_id, h, n_shingles, print, sig, sketch) per row of (doc_id, h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                sizes, prints, sigs, sketches = _described(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *[pa.array(x, pa.binary()) for x in (prints, sigs, sketches)]], ["doc_id", "h", "n_shingles", "print", "sig", "sketch"])

    return slim.select("doc_id", "h", "text").mapInArrow(released(run), "doc_id bigint, h bigint, n_shingles bigint, print binary, sig binary, sketch binary")


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity from two sketches of 4-bit values."""
    x = a ^ b
    same = ((x & 15) == 0).sum(axis=1) + ((x >> 4) == 0).sum(axis=1)
    return (same / (TREES * DEPTH) - 1 / 16) * 16 / 15


def neighbours(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs from rows (tree, sig, node, sketch) in sorted order; keeps ``REACH`` + 1 rows in memory.

    The first and the last region, which may go on in other partitions, come as rows (tree, prefix, -1).
    """
    held, ends = None, []
    for batch in rows:
        if not batch.num_rows:
            continue
        tree = batch.column("tree").to_numpy().astype(np.int64)
        prefix = np.ascontiguousarray(_fixed(batch.column("sig"), 4 * DEPTH)[:, : 4 * LEAST_PREFIX])
        key = np.stack([tree, prefix.view(">u8").ravel().astype(np.int64)], axis=1)
        node, sketch = batch.column("node").to_numpy(), _fixed(batch.column("sketch"), TREES * DEPTH // 2)
        old = 0
        if held is None:
            ends.append(key[0])
        else:
            old = len(held[1])
            key, node, sketch = (np.concatenate(x) for x in zip(held, (key, node, sketch), strict=True))
        n = len(node)
        first = np.ones(n, bool)
        first[1:] = (key[1:] != key[:-1]).any(axis=1)
        centre = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        left, right = [], []
        for w in range(1, min(REACH, n - 1) + 1):
            at = np.arange(max(old, w), n)
            at = at[centre[at] <= at - w]
            left.append(at - w), right.append(at)
        at = np.arange(old, n)
        at = at[at - centre[at] > REACH]
        left, right = np.concatenate([*left, centre[at]]), np.concatenate([*right, at])
        like = np.concatenate([_alike(sketch[left[i : i + 65536]], sketch[right[i : i + 65536]]) for i in range(0, len(left), 65536)] or [np.zeros(0)])
        good = (like >= FLOOR) & (node[left] != node[right])
        a, b = node[left[good]], node[right[good]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(like[good])], ["a", "b", "alike"])
        keep = np.unique(np.concatenate([[centre[-1]], np.arange(max(centre[-1], n - REACH), n)]))
        held = key[keep], node[keep], sketch[keep]
    if held is not None:
        ends.append(held[0][-1])
        yield pa.RecordBatch.from_arrays([pa.array([int(k[i]) for k in ends], pa.int64()) for i in (0, 1)] + [pa.array([-1.0] * 2)], ["a", "b", "alike"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are similar enough; ``texts`` has node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                ok = []
                for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    if last is None or ta != last:
                        last, last_set = ta, shingle_set(ta)
                    other = shingle_set(tb)
                    both = len(np.intersect1d(last_set, other, assume_unique=True))
                    ok.append(100 * both >= PERCENT * (len(last_set) + len(other) - both))
                yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    # Merge joins at every size: texts are dealt once per side, whatever the number of pairs. The centre of a region has many.
    n = pairs.count()
    for end in ("b", "a"):
        partners = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("_n"))
        side = texts.select(F.col("node").alias(end), F.col("text").alias(f"t{end}")).hint("merge").join(partners, end)
        joined = join_hot(pairs if end == "b" else joined, side, end, "_n", n)
    return joined.sortWithinPartitions("a").select("a", "b", "ta", "tb").mapInArrow(released(run), "a bigint, b bigint")


def _crossing(candidates: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs (a, b, ..) whose ends aren't connected yet, with the ends' components."""
    one = comps.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    two = comps.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    joined = candidates.join(one, "a", "left").join(two, "b", "left")
    return joined.select(*candidates.columns, F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")


def _leftovers(meetings: DataFrame, comps: DataFrame, nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) between components that met without one, if there are any; ``meetings`` (a, b, met) counts candidates by the
    components that their ends were in at an earlier time, each named by a node of it.

    A document may link with few members of a large region only, and those needn't be among its neighbours in any
    list. So the smaller of two such components is compared with the whole larger one, in blocks of both sides:
    by sketch, then on full sets, until a link joins the two.
    """
    node = nodes.select("node", "n_shingles", "sketch").join(comps, "node", "left").select("node", "n_shingles", "sketch", F.coalesce("component", "node").alias("component"))
    size = node.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / SHINGLES)).cast("int").alias("blocks"))
    met = _crossing(meetings, comps).groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.sum("met").alias("met"))
    sized = met.join(size.select(F.col("component").alias("x"), F.col("n").alias("nx"), F.col("blocks").alias("bx")), "x").join(size.select(F.col("component").alias("y"), F.col("n").alias("ny"), F.col("blocks").alias("by")), "y")
    smaller = F.col("nx") < F.col("ny")
    sides = sized.where(F.col("nx") * F.col("ny") > F.col("met")).select(F.when(smaller, F.col("x")).otherwise(F.col("y")).alias("small"), F.when(smaller, F.col("y")).otherwise(F.col("x")).alias("large"), F.when(smaller, F.col("by")).otherwise(F.col("bx")).alias("blocks"))
    sides = Cuts(comps.sparkSession).cut(sides, "sides")
    if sides.isEmpty():
        return comps.sparkSession.createDataFrame([], "a bigint, b bigint")
    asking = sides.join(node.withColumnRenamed("component", "small"), "small").select("large", "small", "node", "n_shingles", "sketch")
    askers = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / SHINGLES)).cast("int")
    grid = sides.select("large", "blocks").distinct().join(asking.groupBy("large").agg(askers.alias("askers")), "large")
    own, other = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("node"), F.col("askers")).cast("int")
    rows = node.withColumnRenamed("component", "large").join(grid, "large").select("large", own.alias("p"), F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("q"), "node", "sketch", F.lit(None).cast("bigint").alias("small"))
    ask = asking.join(grid, "large").select("large", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("p"), other.alias("q"), "node", "sketch", "small")

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        asks = tile["small"].notna().to_numpy()
        ids, text, small = tile["node"].to_numpy(), tile["text"].to_numpy(), tile["small"].to_numpy()
        sketch = np.frombuffer(b"".join(tile["sketch"]), np.uint8).reshape(len(tile), -1)
        ours = np.flatnonzero(~asks)
        sets: dict[int, np.ndarray] = {}
        joined, found = set(), []
        for i in np.flatnonzero(asks):
            if small[i] in joined:
                continue
            mine, like = shingle_set(text[i]), _alike(sketch[ours], sketch[i])
            for j in ours[np.argsort(-like, kind="stable")[: int((like >= ALLOWED).sum())]]:
                if j not in sets:
                    sets[j] = shingle_set(text[j])
                both = len(np.intersect1d(mine, sets[j], assume_unique=True))
                if 100 * both >= PERCENT * (len(mine) + len(sets[j]) - both) and ids[i] != ids[j]:
                    joined.add(small[i])
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    break
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    placed = rows.unionByName(ask)
    tiles = placed.hint("merge").join(texts_of(placed.select("node").distinct()), "node")  # also nodes that no list paired
    return tiles.groupBy("large", "p", "q").applyInPandas(compare, "a bigint, b bigint")


def _tiles(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The tiles of rows that come sorted by their first four columns."""
    parts, last = [], None
    for batch in rows:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if parts and tuple(key[lo]) != last:
                yield pa.Table.from_batches(parts)
                parts = []
            parts.append(batch.slice(lo, hi - lo))
            last = tuple(key[lo])
    if parts:
        yield pa.Table.from_batches(parts)


def _tile_pairs(tile: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a tile, each with those of the other side that may be similar, are in another component, and share no earlier tree's region."""
    tree, _, p, q = (tile.column(i)[0].as_py() for i in range(4))
    left, component = tile.column("left").to_numpy(), tile.column("component").to_numpy()
    sketch = _fixed(tile.column("sketch"), TREES * DEPTH // 2)
    keys = _fixed(tile.column("prefixes"), TREES * 4 * LEAST_PREFIX).view(">u8")[:, :tree]
    right = np.flatnonzero(~left) if p != q else np.arange(len(left))
    for i in np.flatnonzero(left) if p != q else right:
        others = right if p != q else right[i + 1 :]
        others = others[component[others] != component[i]]
        others = others[_alike(sketch[others], sketch[i]) >= FLOOR]
        others = others[~(keys[others] == keys[i]).any(axis=1)]
        if len(others):
            yield i, others


def _tile_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each tile that are in any of its pairs."""
    for tile in _tiles(rows):
        used = np.zeros(tile.num_rows, bool)
        for i, others in _tile_pairs(tile):
            used[i] = used[others] = True
        yield from tile.filter(pa.array(used)).to_batches()


def _tile_links(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect all components of each tile which any pair of it links, on full sets."""
    for tile in _tiles(rows):
        node, component, sets = tile.column("node").to_numpy(), tile.column("component").to_pylist(), [shingle_set(t) for t in tile.column("text").to_pylist()]
        size = np.array([len(s) for s in sets])
        words, place = np.unique(np.concatenate(sets), return_inverse=True)
        sets = np.split(place, np.cumsum(size)[:-1])
        has, above, found = np.zeros(len(words), bool), {c: c for c in component}, []

        def root(x: int, above=above) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for i, others in _tile_pairs(tile):
            others = np.array([j for j in others if size[j] and root(component[j]) != root(component[i])], np.int64)
            if not size[i] or not len(others):
                continue
            has[sets[i]] = True
            both = np.add.reduceat(has[np.concatenate([sets[j] for j in others])], np.cumsum(size[others]) - size[others], dtype=np.int64)
            has[sets[i]] = False
            for j in others[100 * both >= PERCENT * (size[i] + size[others] - both)]:
                x, y = root(component[i]), root(component[j])
                if x != y:
                    above[max(x, y)] = min(x, y)
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _unmet(nodes: DataFrame, comps: DataFrame, ends: DataFrame, texts_of: Callable[[DataFrame], DataFrame], cuts: Cuts) -> DataFrame:
    """Links (a, b) between components within the regions where not all pairs have met.

    Those are regions of more than ``REACH`` + 1 documents, and regions at the ends of partitions. They are compared
    in square tiles, by sketch, then on full sets; a pair only in the first tree where it shares a region.
    """
    width, key = 4 * DEPTH, ["tree", "prefix", "p", "q"]
    prefixes = F.concat(*[F.substring("sig", t * width + 1, 4 * LEAST_PREFIX) for t in range(TREES)])
    inner = nodes.join(comps, "node", "left").select("node", "n_shingles", F.coalesce("component", "node").alias("component"), "sketch", prefixes.alias("prefixes"))
    prefix = F.expr(f"cast(conv(hex(substring(prefixes, tree * {4 * LEAST_PREFIX} + 1, {4 * LEAST_PREFIX})), 16, -10) as bigint)")
    every = inner.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(TREES - 1).cast("bigint"))).alias("tree"), "*").withColumn("prefix", prefix)
    sized = every.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    ends = ends.select(F.col("a").alias("tree"), F.col("b").alias("prefix"), F.lit(True).alias("end")).distinct()
    regions = cuts.cut(sized.join(ends, ["tree", "prefix"], "left").where(F.col("end") | (F.col("n") > REACH + 1)).select("tree", "prefix", F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("shingles") / SHINGLES)).alias("blocks")), "regions")
    nothing = cuts.spark.createDataFrame([], "a bigint, b bigint")
    if regions.isEmpty():
        return nothing
    rows = every.join(regions, ["tree", "prefix"]).dropDuplicates(["tree", "prefix", "node"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rows = rows.select("tree", "prefix", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") <= F.col("other")).alias("left"), "node", "component", "sketch", "prefixes")
    tiled = rows.repartition(*key).sortWithinPartitions(*key)
    active = cuts.cut(tiled.mapInArrow(released(_tile_rows), rows.schema), "active")
    if active.isEmpty():
        return nothing
    texts = texts_of(active.select("node").distinct())
    return active.hint("merge").join(texts, "node").select(*rows.columns, "text").repartition(*key).sortWithinPartitions(*key).mapInArrow(released(_tile_links), "a bigint, b bigint")


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, text): h tells the texts of one id apart."""
    text = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _linked(slim: DataFrame, cuts: Cuts) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows as ``described``; classes of equal sets (print, node, n, first); links between classes (node, component).

    ``first`` is the class's smallest (doc_id, h).
    """
    rows = cuts.cut(described(slim), "described")
    usable = rows.where("doc_id is not null and print is not null")
    classes = usable.groupBy("print").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "h")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"),
    )
    # Nodes are numbered in the order of their first ids, so a group of copies links up with its oldest text first.
    ordered = classes.repartitionByRange("first").sortWithinPartitions("first")
    classes = cuts.cut(ordered.withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = classes.select("node", "n_shingles", "sig", "sketch")
    width = 4 * DEPTH
    trees = nodes.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "node", "sig", "sketch").select(
        "tree", F.expr(f"substring(sig, tree * {width} + 1, {width})").alias("sig"), "node", "sketch")
    lists = trees.repartitionByRange("tree", "sig", "node").sortWithinPartitions("tree", "sig", "node")
    found = lists.mapInArrow(released(neighbours), "a bigint, b bigint, alike double")
    found = cuts.cut(found.groupBy("a", "b", (F.col("alike") < 0).alias("end")).agg(F.max("alike").alias("alike")), "candidates")
    candidates, ends = found.where("not end").drop("end"), found.where("end")

    def texts_of(wanted: DataFrame) -> DataFrame:
        firsts = classes.select("node", "first.*").join(wanted, "node", "left_semi")
        found = slim.hint("merge").join(firsts, ["doc_id", "h"])
        return found.groupBy("doc_id", "h", "node").agg(F.first("text").alias("text")).select("node", "text")  # repeated rows have one text

    involved = candidates.select(F.col("a").alias("node")).union(candidates.select("b")).distinct()
    texts = cuts.cut(texts_of(involved), "texts")

    first = candidates.groupBy("b").agg(F.coalesce(F.min(F.when(F.col("alike") >= LIKELY, F.col("a"))), F.max_by("a", "alike")).alias("a")).select("a", "b")
    links = cuts.cut(confirmed(cuts.cut(first, "pairs"), texts), "links")
    comps = components(links, cuts, "first")
    crossing = cuts.cut(_crossing(candidates.select("a", "b"), comps), "crossing")  # what is connected stays so
    meetings = crossing.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.count(F.lit(1)).alias("met"))
    rest = crossing.select("a", "b").join(first, ["a", "b"], "left_anti")
    links = links.unionByName(cuts.cut(confirmed(cuts.cut(rest, "pairs"), texts), "links"))
    comps = components(links, cuts, "second")
    unmet = cuts.cut(_unmet(nodes, comps, ends, texts_of, cuts), "links")
    if not unmet.isEmpty():
        links = links.unionByName(unmet)
        comps = components(links, cuts, "regions")
    more = cuts.cut(_leftovers(meetings, comps, nodes, texts_of), "links")
    if not more.isEmpty():
        comps = components(links.unionByName(more), cuts, "third")
    return rows, classes.select("print", "node", "n", "first"), comps


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``; ids must be integers.

    component_id is the smallest id reachable by confirmed links, kept says that it is the row's own. Texts
    that are null, empty or without words have n_shingles 0 and link with nothing. Rows with a null id link with
    nothing: component_id null, kept true. Each text of an id finds its own links, and an id's texts are connected
    by their id; repeated rows are all returned. Long texts are compared whole, in smaller tiles. Other columns
    aren't read; an empty table gives none.
    """
    cuts = Cuts(docs.sparkSession)
    rows, classes, comps = _linked(_slim(docs, id_col, text_col), cuts)
    usable = rows.where("doc_id is not null and print is not null").select("doc_id", "n_shingles", "print")
    placed = cuts.cut(classes.join(comps, "node", "left").select("print", "n", F.col("first.doc_id").alias("least"), F.coalesce("component", "node").alias("root")), "placed")
    several = usable.groupBy("doc_id").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).where("lo <> hi").select("doc_id")
    same_id = usable.join(several, "doc_id", "left_semi").select("doc_id", "print").distinct().join(placed, "print")
    same_id = same_id.join(same_id.groupBy("doc_id").agg(F.min("root").alias("a")), "doc_id").select("a", F.col("root").alias("b")).where("a <> b")
    by_id = components(cuts.cut(same_id, "same-id"), cuts, "by-id").withColumnRenamed("node", "root")
    placed = placed.join(by_id, "root", "left").select("print", "n", "least", F.coalesce("component", "root").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = cuts.cut(placed.join(smallest, "root").select("print", "n", "component_id"), "of-class")
    joined = join_hot(usable, of_class, "print", "n", rows.count()).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("print is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    every = joined.unionByName(alone).select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    every = cuts.cut(every, "near-duplicates")
    cuts.drop_all(but="near-duplicates")
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _orderable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_orderable(f.dataType) for f in kind)
    return _orderable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def without_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicate texts: of the smallest id, then of the smallest text hash.

    Rows with a null id and texts that are null, empty or without words all stay, and so do unlike texts that share
    an id. Of rows that repeat the id and the text, the smallest by its other columns (those that have an order) stays.
    Columns may have any names and types; an empty table gives none.
    """
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no column can clash with those in use here
    new = dict(zip(docs.columns, named.columns, strict=True))
    cuts = Cuts(docs.sparkSession)
    rows, classes, comps = _linked(_slim(named, new[id_col], new[text_col]), cuts)
    usable = rows.where("doc_id is not null and print is not null").groupBy("doc_id", "h", "print").agg(F.count(F.lit(1)).alias("times"))
    placed = classes.join(comps, "node", "left").select("print", "n", "first", F.coalesce("component", "node").alias("root"))
    stays = placed.groupBy("root").agg(F.min("first").alias("stays"))
    of_class = cuts.cut(placed.join(stays, "root").select("print", "n", "stays"), "of-class")
    judged = join_hot(usable, of_class, "print", "n", rows.count()).select("doc_id", "h", "times", (F.struct("doc_id", "h") == F.col("stays")).alias("stays"))
    judged = cuts.cut(judged.where("not stays or times > 1"), "judged")
    cuts.drop_all(but="judged")
    keyed = named.select("*", F.col(new[id_col]).cast("bigint").alias("doc_id"), F.xxhash64(F.col(new[text_col]).cast("binary")).alias("h"))
    once = keyed.join(judged, ["doc_id", "h"], "left_anti").select(*named.columns)
    again = keyed.join(judged.where("stays"), ["doc_id", "h"], "left_semi")
    order = F.struct(*[c for c in named.columns if _orderable(named.schema[c].dataType)])
    again = again.groupBy("doc_id", "h").agg(F.min_by(F.struct(*named.columns), order).alias("row"))
    return once.unionByName(again.select("row.*")).toDF(*docs.columns)
