"""Running sums over an order of all rows, where neither a group nor the whole is one task's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, written


def running(df: DataFrame, order: list[str], values: list[str], within: str | None = None, deal_by: list | None = None, keep: list[str] | None = None) -> DataFrame:
    """df (of its columns those in `keep`, by default all) with `<value>_before` and `<value>_upto` for each of the long columns `values`: the sum over the rows ahead, without and with
    the row itself, in ascending `order`, wrapping at 64 bits; nulls count as zero.

    within: the first column of the order, a long without nulls; sums begin anew at each of its values. Rows are dealt by range over
    `deal_by` (columns in which the order is coarser or equal; by default `order`) and summed where they are. What is added to them
    is a row for each task, so a hot value of `within` takes as many tasks as its rows need. Equal rows of the order may come in
    any order. The sorted rows are written once, so that both passes see the same deal.
    """
    spark = df.sparkSession
    pid, nth, lead = fresh("pid", "nth", "lead")
    sums = [f"{v}_{x}" for v in values for x in ("before", "upto")]
    columns = keep or df.columns
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, group, first = TaskContext.get().partitionId(), 0, None, True
        total, base = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(within).to_numpy() if within else np.zeros(b.num_rows, np.int64)
            new = np.concatenate([[group is not None and g[0] != group], g[1:] != g[:-1]])
            group, starts = g[-1], np.flatnonzero(new)
            which = np.cumsum(new)  # 0: the group that the batch before ended with
            out = []
            for k, v in enumerate(values):
                x = b.column(v).fill_null(0).to_numpy().astype(np.int64)
                before = total[k] + np.cumsum(x) - x
                bases = np.concatenate([base[k : k + 1], before[starts]])
                out += [before - bases[which], before - bases[which] + x]
                total[k : k + 1], base[k] = before[-1:] + x[-1:], bases[-1]
            head = (which == 0) & first
            first = first and not len(starts)
            place = np.arange(n, n + b.num_rows)
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, out), pa.array(np.full(b.num_rows, task, np.int64)), pa.array(place), pa.array(head)], names=[*b.schema.names, *sums, pid, nth, lead])

    dealt = df.repartitionByRange(*(deal_by or order)).sortWithinPartitions(*order).select(*columns)
    at = written(dealt.mapInArrow(local, f"{types}, {', '.join(f'`{s}` long' for s in sums)}, `{pid}` long, `{nth}` long, `{lead}` boolean"), "sums")
    # A row for each task: its first and last group, and the sums at its end.
    ends = at.groupBy(pid).agg(F.max_by(F.struct(F.col(within) if within else F.lit(0).alias("g"), *[f"{v}_upto" for v in values]), nth).alias("end"), F.min_by(F.struct(F.col(within) if within else F.lit(0).alias("g")), nth).alias("start"))
    carried, group, tail = {}, None, np.zeros(len(values), np.int64)
    for r in sorted(ends.collect(), key=lambda r: r[pid]):
        ahead = tail if group == r["start"][0] else np.zeros(len(values), np.int64)
        carried[r[pid]] = ahead
        own = np.array(list(r["end"])[1:], np.int64)
        group, tail = r["end"][0], own + ahead if r["end"][0] == r["start"][0] else own
    offsets = spark.sparkContext.broadcast(carried)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            tasks, head = b.column(pid).to_numpy(), b.column(lead).to_numpy(zero_copy_only=False)
            task, which = np.unique(tasks, return_inverse=True)
            add = np.stack([offsets.value[t] for t in task.tolist()])[which] * head[:, None]
            out = [pa.array(b.column(s).to_numpy() + add[:, k // 2]) for k, s in enumerate(sums)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *out], names=[*columns, *sums])

    return at.mapInArrow(whole, f"{types}, {', '.join(f'`{s}` long' for s in sums)}")
