"""First rows of groups, kept in each partition before anything is shuffled.

Spark limits a ranked window before its shuffle only up to a thousand rows a group. Here every partition keeps the first ``cap`` rows of each
group as it reads, in Arrow tables that are cut back whenever they have doubled: mergeable lists, as the first rows of a union are among the first rows of its parts.
So at most cap x partitions rows of a group are shuffled, however large it is, and one ranked window merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a partition holds beyond those that it must before it cuts back.
SLACK = 20_000


def first_of_groups(table: pa.Table, order: list[str]) -> pa.Table:
    """The rows within their group's ``_cap``, sorted by ``_group`` and ``order``."""
    table = table.sort_by([(c, "ascending") for c in ("_group", *order)]).combine_chunks()
    if not len(table):
        return table
    group = table.column("_group").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    place, new = np.arange(len(group)), np.concatenate([[True], group[1:] != group[:-1]])
    place = place - np.maximum.accumulate(np.where(new, place, 0))
    return table.filter(pa.array(place < table.column("_cap").to_numpy()))


def keep_first(rows: DataFrame, by: str, order: list[Column], cap: int | Column) -> DataFrame:
    """``rows`` without those that can't be among the first ``cap`` of their group ``by``. ``order``: ascending columns of
    strings or numbers without nulls; rows that tie in all of them may stand in for each other. A null group is a group."""
    names, keys = rows.columns, [f"_o{i}" for i in range(len(order))]
    cap = F.lit(cap) if isinstance(cap, int) else cap
    keyed = rows.withColumns({"_group": F.col(by).cast("string"), "_cap": F.coalesce(cap, F.lit(0)).cast("long"), **dict(zip(keys, order, strict=True))})

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, limit = [], 0, SLACK
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size > limit:
                table = first_of_groups(pa.Table.from_batches(held), keys)
                held, size = table.to_batches(), len(table)
                limit = 2 * size + SLACK
        if held:
            yield from first_of_groups(pa.Table.from_batches(held), keys).to_batches(max_chunksize=10_000)

    return keyed.mapInArrow(thin, keyed.schema).select(*names)


def first_rows(rows: DataFrame, by: str, order: list[Column], cap: int | Column, name: str = "rn") -> DataFrame:
    """The first ``cap`` rows of each group, with their place from 1 on."""
    placed = keep_first(rows, by, order, cap).withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))
    return placed.where(F.col(name) <= cap)
