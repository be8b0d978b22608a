"""Kernels over many series at a time: rows of whole series, in order, as Arrow tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of short series that a kernel takes at once; a longer series comes whole.
MOST_ROWS = 150_000


def by_batches(points: DataFrame, by: list[str], run: Callable[[pa.Table, np.ndarray], pa.Table | Iterator[pa.Table]], schema: str, most: int = MOST_ROWS) -> DataFrame:
    """What ``run`` makes, at once or in parts, of tables of whole series, rows sorted by ``by`` and t, and the places where the series begin.

    The window deals and sorts the rows, without a shuffle where they are dealt that way already; its place, from 1, tells where a series
    begins, and that it is whole.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy("t"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            begins = np.flatnonzero(batch.column("_place").to_numpy() == 1) if n >= most else ()
            if len(begins):
                head, held = [*held[:-1], batch.slice(0, begins[-1])], [batch.slice(begins[-1])]
                n = held[0].num_rows
                yield from one(head)
        yield from one(held)

    def one(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if any(p.num_rows for p in parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            places = table.column("_place").to_numpy()
            begins = np.flatnonzero(places == 1)
            if not np.array_equal(places - 1, np.arange(len(places)) - np.repeat(begins, np.diff(np.append(begins, len(places))))):
                raise ValueError("a series in parts")
            made = run(table.drop_columns("_place"), begins)
            for out in [made] if isinstance(made, pa.Table) else made:
                yield from out.to_batches()

    return points.withColumn("_place", place).mapInArrow(whole, schema)
