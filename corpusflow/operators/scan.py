"""Running values over ordered rows of a key, where one key may hold any share of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.steps import materialize


def _carried(firsts: list[tuple], totals: tuple[str, ...], lasts: tuple[str, ...]) -> Iterator[tuple]:
    """(part, key, values) that each part takes over: firsts has (part, its first key, its last key, values at its end) in order.
    A key that fills a part passes on what it took over with what it found."""
    before, state = None, None
    for part, first, last, *values in firsts:
        taken = state if before == (first,) else None
        if taken is not None:
            yield part, first, *taken
        own = dict(zip((*totals, *lasts), values))
        if first == last and taken is not None:
            old = dict(zip((*totals, *lasts), taken))
            state = [old[c] + own[c] for c in totals] + [own[c] if own[c] is not None else old[c] for c in lasts]
        else:
            state = values
        before = (last,)


def segmented_scan(rows: DataFrame, key: str, order: list[str | Column], totals: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """rows with running values within each key, in the order of the columns `order`: for each of totals the sum (long) of a whole number,
    for each of lasts the last value (string) that is not null, the row itself included. Rows of equal order come in any.

    Rows are dealt by range of key and order, so that a key of any size is many tasks, and scanned where they are in one pass that holds one batch. What a
    partition ends with is one row, its key and values; these are folded in order on the driver, one row a partition, and
    sent to the partitions that go on with the key. Null keys are one key. The scanned rows are written once, which keeps
    partitions and their numbers fixed when executors are lost.
    """
    totals, lasts = totals or {}, lasts or {}
    names, n, m = (*totals, *lasts), len(totals), len(lasts)
    given = rows.withColumns({f"_s{i}": c.cast("long") for i, c in enumerate(totals.values())} | {f"_s{n + i}": c.cast("string") for i, c in enumerate(lasts.values())})
    dealt = given.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    columns = rows.columns
    at = columns.index(key)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = (), [0] * n + [None] * m
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(at).dictionary_encode(null_encoding="encode")
            number, known = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary
            new = np.concatenate([[True], number[1:] != number[:-1]])
            starts = np.flatnonzero(new)
            going_on = current == (known[int(number[0])].as_py(),)
            segment = np.cumsum(new) - 1
            out = []
            for i in range(n):
                x = np.asarray(batch.column(len(columns) + i).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
                sums = np.cumsum(x)
                base = (sums[starts] - x[starts])[segment]
                sums = sums - base
                if going_on:
                    sums = sums + np.where(segment == 0, state[i], 0)
                out.append(pa.array(sums, pa.int64()))
                state[i] = int(sums[-1])
            for i in range(n, n + m):
                column = batch.column(len(columns) + i)
                have = column.is_valid().to_numpy(zero_copy_only=False)
                # the place of the last value so far, if it lies in the row's own segment
                place = np.maximum.accumulate(np.where(have, np.arange(len(have)), -1))
                place = np.where(place >= starts[segment], place, -1)
                taken = column.take(pa.array(place, mask=place < 0))
                if going_on and state[i] is not None:
                    taken = pa.compute.if_else(pa.array((place < 0) & (segment == 0)), pa.scalar(state[i], pa.string()), taken)
                out.append(taken)
                state[i] = taken[len(taken) - 1].as_py()
            current = (known[int(number[-1])].as_py(),)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), *out], [*columns, *names])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"`{c}` bigint" for c in totals), *(f"`{c}` string" for c in lasts)])
    scanned = materialize(dealt.mapInArrow(scan, kinds).withColumn("_place", F.monotonically_increasing_id()), "scanned")
    part = F.shiftright("_place", 33)
    ends = scanned.groupBy(part.alias("part")).agg(F.min_by(F.struct(key), "_place").alias("first"), F.max_by(F.struct(key, *names), "_place").alias("last"))
    ends = sorted(((r["part"], r["first"][0], *r["last"]) for r in ends.collect()), key=lambda r: r[0])  # one row a partition
    carried = list(_carried(ends, tuple(totals), tuple(lasts)))
    if not carried:
        return scanned.drop("_place")
    kind = dict(rows.dtypes)[key]
    schema = f"_part bigint, _key {kind}" + "".join(f", _c{i} {'bigint' if i < n else 'string'}" for i in range(len(names)))
    over = F.broadcast(rows.sparkSession.createDataFrame(carried, schema))
    joined = scanned.join(over, (part == F.col("_part")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    final = {c: F.col(c) + F.coalesce(f"_c{i}", F.lit(0)) if i < n else F.coalesce(c, f"_c{i}") for i, c in enumerate(names)}
    return joined.withColumns(final).select(*columns, *names)
