"""Groups as runs of sorted rows: for many small groups, far cheaper than one pandas frame per group.

Rows are hash-partitioned by a digest of the key and sorted inside their partition (which spills); the function gets one
group at a time as a list of tuples.  Use it only where the size of a group is bounded.

The digest is a column made here, so no earlier shuffle has it: a repartition by the key itself would be dropped where a
join below has that partitioning already, and a join that turns into a broadcast at run time then loses it, since
``mapInArrow`` demands no distribution of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

_PLACE = "__place"


def sorted_groups(df: DataFrame, keys: list[str], order: list[str], handle: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows ``handle`` gives for each group; the group's rows have the key columns first, then all others in order."""
    rest = [c for c in df.columns if c not in keys]
    width = len(keys)
    out_type = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(out_type)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in batch.columns[:-1]]):
                if group and group[0][:width] != row[:width]:
                    out.extend(handle(group))
                    group = []
                group.append(row)
            yield emit(out)
        if group:
            yield emit(list(handle(group)))

    placed = df.select(*keys, *rest, F.xxhash64(*keys).alias(_PLACE)).repartition(_PLACE).sortWithinPartitions(_PLACE, *keys, *order)
    return placed.mapInArrow(run, out_type)
