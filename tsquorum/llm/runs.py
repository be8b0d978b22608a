"""Periodic runs of words by Crochemore's partition refinement.

Positions of a document are kept in classes of equal factors of one length, longer by one word a step. Two positions stay together
exactly if those after them were together before; so a class splits by the classes of the next positions. Only
subclasses other than the largest of each class that split need be looked at in the next step (smaller half), which bounds the work by n log n.
Each position knows the next one in its class. Where that lies as far off as the factors are long, a square begins; squares at
consecutive positions are one run.

Many documents are refined at once, apart from each other, by numpy: a step works on what has to move in all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsquorum.llm.common import released

LEAST_WORDS, LEAST_EXPONENT = 24, 3
#: Words that are refined together; a longer document is alone.
TOGETHER = 500_000


class Partition:
    """Classes of positions by equal factors, and the next position of each class member.

    ``events`` are (position, distance to the next in its class or 0, length of the factors from which on that holds).
    """

    def __init__(self, keys: np.ndarray, first: np.ndarray) -> None:
        """``keys``: equal where factors of length 1 are; ``first``: whether a position begins a document."""
        n = len(keys)
        order = np.argsort(keys, kind="stable")
        new = np.ones(n, bool)
        new[1:] = keys[order[1:]] != keys[order[:-1]]
        number = np.cumsum(new) - 1
        self.cls = np.empty(n, np.int64)
        self.cls[order] = number
        self.classes = int(number[-1]) + 1 if n else 0
        self.size = np.zeros(n + 1, np.int64)
        self.size[: self.classes] = np.bincount(number, minlength=self.classes)
        self.head = np.full(n + 1, -1, np.int64)
        self.head[: self.classes] = order[new]
        self.next, self.prev = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self._link(order, new)
        self.first = first
        self.length = 1
        self.events = [self._event(order)]
        self.splitters = np.arange(n)

    def _link(self, order: np.ndarray, new: np.ndarray) -> None:
        """Members in ``order`` follow each other up to the next that is ``new``."""
        same = ~new[1:]
        self.next[order] = -1
        self.prev[order] = -1
        self.next[order[:-1][same]] = order[1:][same]
        self.prev[order[1:][same]] = order[:-1][same]

    def _event(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        after = self.next[at]
        return at, np.where(after >= 0, after - at, 0), np.full(len(at), self.length)

    def _members(self, classes: np.ndarray) -> np.ndarray:
        """All positions of some classes, walking their lists side by side."""
        found, at = [], self.head[classes]
        while len(at):
            found.append(at)
            at = self.next[at]
            at = at[at >= 0]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def refine(self) -> bool:
        """Goes on to factors longer by one word; False if nothing can split any more."""
        after = self.splitters[~self.first[self.splitters]]
        at = after - 1
        some = self.size[self.cls[at]] > 1
        at, after = at[some], after[some]
        self.length += 1
        if not len(at):
            self.splitters = at
            return False
        old, by = self.cls[at], self.cls[after]
        order = np.lexsort((at, by, old))
        at, old, by = at[order], old[order], by[order]
        begins = np.ones(len(at), bool)
        begins[1:] = (old[1:] != old[:-1]) | (by[1:] != by[:-1])
        group = np.cumsum(begins) - 1
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(at)))
        of = old[starts]
        # By split class: where all members were looked at, the largest group stays; else those not looked at do.
        opens = np.ones(len(of), bool)
        opens[1:] = of[1:] != of[:-1]
        at_class = np.cumsum(opens) - 1
        heads = np.flatnonzero(opens)
        asked = np.add.reduceat(sizes, heads)
        rest = self.size[of[heads]] - asked
        by_size = np.lexsort((sizes, at_class))
        largest = by_size[np.append(heads[1:], len(of)) - 1]
        stays = np.zeros(len(of), bool)
        stays[largest[rest == 0]] = True
        kept = np.where(rest == 0, sizes[largest], rest)
        moves = ~stays[group]
        if not moves.any():
            self.splitters = at[:0]
            return False
        moved, moved_group = at[moves], group[moves]
        # Take the moved ones out of their lists: those next to each other there at once.
        out = moved[np.lexsort((moved, old[moves]))]
        follows = self.next[out[:-1]] == out[1:]
        front, back = out[np.append(True, ~follows)], out[np.append(~follows, True)]
        before, beyond = self.prev[front], self.next[back]
        self.head[self.cls[front[before < 0]]] = beyond[before < 0]
        self.next[before[before >= 0]] = beyond[before >= 0]
        self.prev[beyond[beyond >= 0]] = before[beyond >= 0]
        # Then make them classes of their own.
        new = np.ones(len(moved), bool)
        new[1:] = moved_group[1:] != moved_group[:-1]
        number = self.classes + np.cumsum(new) - 1
        self.size[of[heads]] = kept
        self.cls[moved] = number
        gone = ~stays
        self.size[self.classes : self.classes + int(gone.sum())] = sizes[gone]
        self.head[number[new]] = moved[new]
        self.classes += int(gone.sum())
        self._link(moved, new)
        self.events += [self._event(before[before >= 0]), self._event(moved)]
        # Smaller half: of each class that split, all parts but the largest.
        best = np.zeros(len(heads), np.int64)
        np.maximum.at(best, at_class[gone], sizes[gone])
        lower = (kept < best) & (best > 0)
        top = by_size[np.append(heads[1:], len(of)) - 1]
        skipped = np.zeros(len(of), bool)
        skipped[top[lower]] = True
        self.splitters = np.concatenate([moved[~skipped[moved_group]], self._members(of[heads][lower])])
        return True

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, period) of all squares with primitive root found so far, by period, then position."""
        at, gap, since = (np.concatenate([e[k] for e in self.events]) for k in range(3))
        order = np.argsort(at, kind="stable")  # events of a position are in the order of lengths
        at, gap, since = at[order], gap[order], since[order]
        until = np.full(len(at), np.iinfo(np.int64).max)
        until[:-1][at[1:] == at[:-1]] = since[1:][at[1:] == at[:-1]]
        held = (gap > 0) & (since <= gap) & (gap < until) & (gap <= self.length)
        at, gap = at[held], gap[held]
        order = np.lexsort((at, gap))
        return at[order], gap[order]


def word_runs(documents: list[list], least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """Per document (a list of words) its runs (start, length, period), by start, then period.

    A run is a stretch whose smallest period is ``period``, that no neighbouring word extends, with at least ``least``
    words and ``exponent`` periods (2 at least).
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    taken = [k for k, words in enumerate(documents) if len(words) >= least]
    if not taken:
        return found
    codes: dict = {}
    lengths = np.array([len(documents[k]) for k in taken])
    begin = np.cumsum(lengths + 1) - (lengths + 1)  # a position after each document is a class of its own
    keys = np.empty(int((lengths + 1).sum()), np.int64)
    for d, (k, lo) in enumerate(zip(taken, begin.tolist(), strict=True)):
        words = documents[k]
        keys[lo : lo + len(words)] = [codes.setdefault(w, len(codes)) for w in words]
        keys[lo + len(words)] = -1
    of = np.repeat(np.arange(len(taken)), lengths + 1)
    first = np.zeros(len(keys), bool)
    first[begin] = True
    part = Partition(of * (len(codes) + 1) + keys + 1, first)
    longest = int(lengths.max()) // exponent
    while part.length < longest and part.refine():
        pass
    part.length = max(part.length, longest)  # nothing splits any more
    at, period = part.squares()
    if not len(at):
        return found
    new = np.ones(len(at), bool)
    new[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(at)) - 1
    q = period[starts]
    length = at[ends] - at[starts] + 2 * q
    good = length >= np.maximum(least, exponent * q)
    for start, n, p in zip(at[starts][good].tolist(), length[good].tolist(), q[good].tolist(), strict=True):
        d = int(of[start])
        found[taken[d]].append((start - int(begin[d]), n, p))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()]


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def find_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT,
    prepare: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row: periodic runs of the text's words, and the text without repetitions.

    ``runs`` holds start (word number from 0), length and period, by start, then period; ``collapsed`` the words kept, joined by one blank.
    Words are what blanks, tabs and line ends part, compared as they are. ``prepare`` may change a row's words first.
    Null and empty texts have no words and no runs. A text of any length is worked on whole, in one task. Repeated rows, and
    rows with a null id, give a row each; other columns aren't read; an empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    schema = pa.schema([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.binary())])

    def worked(ids: pa.Array, rows: list[list[bytes]]) -> pa.RecordBatch:
        runs = word_runs(rows, least, exponent)
        short = [b" ".join(collapsed(words, found)) for words, found in zip(rows, runs, strict=True)]
        listed = [[{"start": s, "length": n, "period": p} for s, n, p in found] for found in runs]
        columns = [pa.array(x, f.type) for x, f in zip(([len(words) for words in rows], listed, short), schema, strict=True)]
        return pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, n, lo = [], 0, 0
            for k in range(batch.num_rows):
                words = (batch.column(1)[k].as_py() or b"").split()  # white space of ASCII
                rows.append(prepare(batch.column(0)[k].as_py(), words) if prepare else words)
                n += len(words)
                if n >= TOGETHER:
                    yield worked(batch.column(0).slice(lo, len(rows)), rows)
                    lo, rows, n = k + 1, [], 0
            if rows:
                yield worked(batch.column(0).slice(lo, len(rows)), rows)

    kind = slim.schema["doc_id"].dataType.simpleString()
    found = slim.mapInArrow(released(run), f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs):
    """The run with most periods, by exact fractions; ties by start, then period. Null if there is none."""

    def order(a, b):
        one, two = a["length"] * b["period"], b["length"] * a["period"]
        return (
            F.when(one > two, -1).when(one < two, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
            .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)
        )

    return F.get(F.array_sort(runs, order), F.lit(0))
