"""Filters of traces that are too long for a task: a trace is dealt by segments, and no task has to hold one.

A segment is a column that never falls along the order (say, a range of frame numbers).  Rows are numbered along their trace segment by
segment: windows run within segments, and each segment tells one row, its number of samples.  By these numbers a trace is cut into
blocks of BLOCK samples, however short or uneven its segments are, and each block is filtered alone:

* `haloed`: with copies of the samples beside it, continued at the ends of the trace.  Blocks pass through a task one after the other, many
  short ones in a batch, so neither a long trace nor many short ones cost more than their rows;
* `recursive`: with the states in which the filter enters it forward and backward.  A filter is linear, so a block turns a state s into
  A^n s + f; these maps, a row for each block, are composed along the trace, and the backward pass over the forward output is linear in the same s.

Samples are the known values (null and NaN are passed over and stay unknown).  Null keys are a trace of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import kernels
from .running import beside
from .traces import known

BLOCK = 1 << 14  # samples of a trace that are filtered at once

_LISTS = pa.list_(pa.float64())


def _numbered(df: DataFrame, keys: list[str], frame: str, value: str, segment: Column, compact: bool) -> DataFrame:
    """df with known values (others null), `_row`, the samples of the trace before each row, `_n`, those of the trace, and `_spread`, its range.  Samples
    are the known values if compact, else all rows."""
    own = df.select(*[c for c in df.columns if c != value], known(value).alias(value), segment.alias("_segment"))
    one = (F.when(F.col(value).isNotNull(), 1).otherwise(0) if compact else F.lit(1)).cast("long")
    before = lambda w, o: w.orderBy(F.col(o).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    each = own.groupBy(*keys, "_segment").agg(F.sum(one).alias("_of"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    trace = Window.partitionBy(*keys)  # a row for each segment
    told = each.select(*keys, "_segment", F.coalesce(F.sum("_of").over(before(trace, "_segment")), F.lit(0)).alias("_before"), F.sum("_of").over(trace).alias("_n"), (F.max("_high").over(trace) - F.min("_low").over(trace)).alias("_spread"))
    here = own.withColumn("_at", F.coalesce(F.sum(one).over(before(Window.partitionBy(*keys, "_segment"), frame)), F.lit(0)))
    return beside(here, told, [*keys, "_segment"]).withColumn("_row", F.col("_before") + F.col("_at")).drop("_segment", "_before", "_at")


def _samples(table: pa.Table, frame: str, value: str) -> tuple[pa.Table, np.ndarray]:
    """The segment in order, and its values; NaN is unknown."""
    table = table.sort_by(frame)
    return table, table.column(value).to_numpy()


def _row(table: pa.Table, keys: list[str], **values) -> pa.Table:
    head = {k: table.column(k).slice(0, 1) for k in [*keys, "_segment"]}
    kind = lambda v: _LISTS if isinstance(v, np.ndarray) else pa.int64() if isinstance(v, int) else pa.float64()
    return pa.table(head | {k: pa.array([v], kind(v)) for k, v in values.items()})


def _schema(own: DataFrame, keys: list[str], more: str) -> StructType:
    return StructType([*[own.schema[c] for c in [*keys, "_segment"]], *StructType.fromDDL(more).fields])


def _lists(table: pa.Table, column: str) -> list[np.ndarray]:
    return [np.array(v, float) for v in table.column(column).to_pylist()]


def _joined_up(own: DataFrame, keys: list[str], told: DataFrame, carry: Callable, finish: Callable) -> DataFrame:
    """carry(rows of a trace) gives each segment its row; finish(segment, its row) the result."""
    carried = told.groupBy(*keys).applyInArrow(*carry)
    by = [*keys, "_segment"]
    return own.groupBy(*by).cogroup(carried.groupBy(*by)).applyInArrow(finish, own.schema).drop("_segment")


def haloed(df: DataFrame, keys: list[str], frame: str, value: str, segment: Column, halo: int, kernel: Callable[[np.ndarray, int, int, bool, float | None], np.ndarray], *, extend: Callable[[np.ndarray, int], np.ndarray] | None = None, small: int = 0, compact: bool = True) -> DataFrame:
    """value replaced by kernel(samples with those beside them, how many stand before, how many are its own, whether that is the whole trace, its range).

    extend(first samples, halo) continues the ends of a trace to the left; without it the kernel sees where they end.  Traces of up to
    `small` samples come whole.  compact=False: unknown values are samples too, NaN.
    """
    small = max(small, halo + 1) if extend is not None else small
    size = max(BLOCK, halo, small)
    rows = _numbered(df, keys, frame, value, segment, compact)
    names = [c for c in rows.columns if c not in ("_n", "_spread", "_row")]
    block, place, sample = F.floor(F.col("_row") / size), F.col("_row") % size, F.col(value).isNotNull() if compact else F.lit(True)
    left, right = sample & (place < halo) & (block > 0), sample & (place >= size - halo) & ((block + 1) * size < F.col("_n"))
    to = F.array(F.when(sample, block).otherwise(-1 - block), F.when(left, block - 1), F.when(right, block + 1))  # no sample: a block without any
    dealt = rows.select(*names, "_row", "_spread", (F.col("_n") <= small).alias("_whole"), block.alias("_block"), F.explode(F.array_compact(to)).alias("_to"))
    first = F.row_number().over(Window.partitionBy(*keys, "_to").orderBy("_row")) == 1  # leaves a block's rows in order, side by side
    blocks = dealt.select(*names, "_spread", "_whole", ((F.col("_to") == F.col("_block")) | (F.col("_to") < 0)).alias("_mine"), first.alias("_first"))

    def wide(x: np.ndarray, before: int, n: int) -> tuple[np.ndarray, int]:
        """A block's samples, continued where less than a halo is beside its own: there the trace ends."""
        after = len(x) - before - n
        parts = [x]
        if before < halo:
            parts.insert(0, extend(x, halo)[before:])
        if after < halo:
            parts.append(extend(x[::-1], halo)[::-1][: halo - after])
        return np.concatenate(parts), max(before, halo)

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        x, mine, whole, spread = (table.column(c).to_numpy() for c in (value, "_mine", "_whole", "_spread"))
        begins = np.flatnonzero(table.column("_first").to_numpy())
        out = np.full(len(x), np.nan)
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(x)]):
            before, n = int(mine[a:b].argmax()), int(mine[a:b].sum())
            held_, ahead = (x[a:b], before) if whole[a] or extend is None else wide(x[a:b], before, n)
            out[a + before : a + before + n] = kernel(held_, ahead, n, bool(whole[a]), None if np.isnan(spread[a]) else float(spread[a]))
        table = table.select(names).set_column(names.index(value), value, pa.array(out, mask=np.isnan(out)))
        yield from table.filter(pa.array(mine)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if compact:
                there = pc.is_valid(batch.column(value))
                yield batch.filter(pc.invert(there)).select(names)
                batch = batch.filter(there)
            begins = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
            if len(begins):
                last = int(begins[-1])
                yield from done([*held, batch.slice(0, last)])
                held = [batch.slice(last)]
            elif batch.num_rows:
                held.append(batch)
        if held:
            yield from done(held)

    return blocks.mapInArrow(run, rows.select(names).schema)


def mirrored_ends(first: np.ndarray, n: int) -> np.ndarray:
    """Samples before the first, mirrored with the edge sample repeated."""
    return first[n - 1 :: -1] if n else first[:0]


def odd_ends(first: np.ndarray, n: int) -> np.ndarray:
    """Samples before the first, reflected at its value."""
    return 2 * first[0] - first[n:0:-1]


def recursive(df: DataFrame, keys: list[str], frame: str, value: str, segment: Column, b: np.ndarray, a: np.ndarray) -> DataFrame:
    """value replaced by what kernels.zero_phase(b, a, the whole trace) gives."""
    system = kernels.recursion(b, a)
    order, edge = len(system[1]), 3 * max(len(a), len(b))
    rows = _numbered(df, keys, frame, value, segment, False)
    own = rows.withColumn("_segment", F.floor(F.col("_row") / BLOCK)).drop("_n", "_spread", "_row")

    def tell(table: pa.Table) -> pa.Table:
        table, x = _samples(table, frame, value)
        x = x[~np.isnan(x)]
        nought = np.zeros(order)
        y, end = kernels.driven(system, x, nought)
        _, back = kernels.driven(system, y[::-1], nought)
        return _row(table, keys, n=len(x), head=x[: edge + 1], tail=x[max(0, len(x) - edge - 1) :], state=np.concatenate([end, back, kernels.echo(system, len(x)).ravel()]))

    def carry(table: pa.Table) -> pa.Table:
        table = table.sort_by("_segment")
        n = table.column("n").to_pylist()
        heads, tails = np.concatenate(_lists(table, "head")), np.concatenate(_lists(table, "tail"))
        states = [(s[:order], s[order : 2 * order], s[2 * order :].reshape(order, order)) for s in _lists(table, "state")]
        pad = min(edge, sum(n) - 1)
        forward, backward = [None] * len(n), [None] * len(n)
        if pad >= 1:
            left, right = odd_ends(heads, pad), odd_ends(tails[::-1], pad)[::-1]
            powers = {m: np.linalg.matrix_power(system[0], m) for m in set(n)}
            _, s = kernels.driven(system, left, kernels.steady(system) * left[0])
            for k in range(len(n)):
                forward[k] = s
                s = powers[n[k]] @ s + states[k][0]
            y, _ = kernels.driven(system, right, s)
            _, s = kernels.driven(system, y[::-1], kernels.steady(system) * y[-1])
            for k in range(len(n) - 1, -1, -1):
                backward[k] = s
                s = powers[n[k]] @ s + states[k][1] + states[k][2] @ forward[k]
        out = {c: table.column(c) for c in [*keys, "_segment"]}
        return pa.table(out | {"forward": pa.array(forward, _LISTS), "backward": pa.array(backward, _LISTS)})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        left, x = _samples(left, frame, value)
        there = ~np.isnan(x)
        states = [right.column(c)[0].as_py() for c in ("forward", "backward")]
        if states[0] is not None:
            y, _ = kernels.driven(system, x[there], np.array(states[0]))
            z, _ = kernels.driven(system, y[::-1], np.array(states[1]))
            x = x.copy()
            x[there] = z[::-1]
        return left.set_column(left.schema.get_field_index(value), value, pa.array(x, mask=~there))

    told = own.groupBy(*keys, "_segment").applyInArrow(tell, _schema(own, keys, "n long,head array<double>,tail array<double>,state array<double>"))
    return _joined_up(own, keys, told, (carry, _schema(own, keys, "forward array<double>,backward array<double>")), finish)
