"""Prediction by partial matching over bytes, with frozen statistics.

A text is read as `order` start marks, its UTF-8 bytes and an end mark (byte 255, which UTF-8 lacks).  The
context tree is the set of (order + 1)-byte grams with their counts; shorter contexts are its margins.  A
symbol's probability: in the longest context that was seen, its count against total and escape; the escape
weight is the number of distinct symbols (method C); after an escape, the next shorter context is taken
without the symbols of the longer one (symbol exclusion); behind the empty context every byte never
seen is equally likely.  As statistics are frozen, a symbol's code length depends on its gram alone: it is
computed once per gram that occurs and the texts are sums over a lookup.

The counting is a Spark aggregation over all training texts.  Of trees of more than `most` grams only the
most frequent grams are broadcast; the other grams of the texts are joined with the counts by shuffle.  The
order is the same at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import most_frequent, runs, starts, unused, written

MARK = 255
MOST = 3_000_000
SPLIT = 1 << 20  # grams of one context of two bytes that a task takes


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every symbol (end marks too) of a block of texts, and where each text's begin."""
    n = len(offsets) - 1
    pad = order + 1
    row = np.full(len(data) + n * pad, MARK, np.uint8)
    row[np.arange(len(data)) + np.repeat(np.arange(n) * pad + order, np.diff(offsets))] = data
    key = np.zeros(len(row), np.uint64)
    for j in range(order + 1):
        key[order:] |= row[order - j : len(row) - j].astype(np.uint64) << np.uint64(8 * j)
    size = np.diff(offsets) + 1
    keep = np.arange(int(size.sum())) + np.repeat(np.arange(1, n + 1) * order, size)
    return key[keep], np.append(0, np.cumsum(size))


class Model:
    """Code lengths (log10 probabilities) of grams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, short: tuple[np.ndarray, np.ndarray] | None = None, middle: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """short: grams of two bytes of all texts, where keys are only those of some contexts of two bytes; middle: grams of three bytes, where
        keys are only those of some contexts of three."""
        by = np.argsort(keys)
        keys, counts = keys[by], counts[by].astype(np.float64)
        self.order = order
        self.levels = []
        for k in range(order, -1, -1):
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            if k == 2 and middle is not None:
                keys, counts = middle[0], middle[1].astype(np.float64)
            if k == 1 and short is not None:
                keys, counts = short[0], short[1].astype(np.float64)
            g, at = np.unique(keys & mask, return_inverse=True)
            c = np.bincount(at, counts, len(g))
            context, first = np.unique(g >> np.uint64(8), return_index=True)
            total = np.add.reduceat(c, first) if len(g) else np.zeros(0)
            distinct = np.diff(np.append(first, len(g))).astype(np.float64)
            self.levels.append((mask, g, c, context, total, distinct))
        # mass that a context's symbols have in the next shorter one
        self.excluded = [None]
        for k in range(1, len(self.levels)):
            _, g, _, context, _, _ = self.levels[k - 1]
            mask, short, c, _, _, _ = self.levels[k]
            mass = c[np.searchsorted(short, g & mask)]
            self.excluded.append(np.bincount(np.searchsorted(context, g >> np.uint64(8)), mass, len(context)))

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last symbol behind its others."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        gone_mass = np.zeros(len(keys))
        gone = np.zeros(len(keys))
        for k, (mask, g, c, context, total, distinct) in enumerate(self.levels):
            if not len(todo):
                break
            if not len(g):
                continue
            own = keys[todo] & mask
            at = np.minimum(np.searchsorted(context, own >> np.uint64(8)), len(context) - 1)
            seen = context[at] == own >> np.uint64(8)
            mass = np.where(seen, total[at] - gone_mass[todo], 0)
            kinds = np.where(seen, distinct[at] - gone[todo], 0)
            place = np.minimum(np.searchsorted(g, own), len(g) - 1)
            hit = seen & (g[place] == own)
            whole = mass + kinds
            out[todo[hit]] += np.log10(c[place[hit]] / whole[hit])
            left = seen & ~hit & (kinds > 0)
            out[todo[left]] += np.log10(kinds[left] / whole[left])
            if k + 1 < len(self.levels):
                gone_mass[todo] = np.where(seen, self.excluded[k + 1][at], gone_mass[todo])
                gone[todo] = np.where(seen, distinct[at], gone[todo])
            todo = todo[~hit]
        if len(todo):
            out[todo] -= np.log10(256 - len(self.levels[-1][1]) if len(self.levels[-1][1]) < 256 else 1)
        return out


class Tables:
    """Models side by side, with one lookup for the grams that any of them has seen."""

    def __init__(self, trees: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> None:
        self.order, self.names = order, sorted(trees)
        self.models = [Model(*trees[n], order) for n in self.names]
        self.keys = np.unique(np.concatenate([trees[n][0] for n in self.names])) if trees else np.zeros(0, np.uint64)
        self.values = np.array([m.score(self.keys).astype(np.float64) for m in self.models])

    def block(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each text under each model."""
        keys, first = grams(data, offsets, self.order)
        out = np.zeros((len(self.models), len(offsets) - 1))
        if not len(self.keys) or not len(keys):
            return out
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        odd = np.flatnonzero(self.keys[at] != keys)
        for m, model in enumerate(self.models):
            value = self.values[m][at]
            if len(odd):
                value[odd] = model.score(keys[odd])
            out[m] = np.add.reduceat(value, first[:-1])
        return out

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
        """As Head.parts, with no grams left over."""
        return self.block(data, offsets), pa.array([[]] * (len(offsets) - 1), pa.list_(pa.int64()))


def count_grams(texts: DataFrame, order: int) -> DataFrame:
    """Counts (name, gram, n) over all texts of a DataFrame (name string, text binary)."""
    from .text import blocks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").unique().to_pylist():
                own = batch.filter(pa.compute.equal(batch.column("name"), name))
                for _, data, offsets in blocks(own, "text", 8 << 20):
                    g, n = np.unique(grams(data, offsets, order)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["name", "gram", "n"])

    return texts.mapInArrow(count, "name string, gram long, n long").groupBy("name", "gram").agg(F.sum("n").alias("n"))


class Head:
    """Code lengths of the most frequent grams under all models; the other grams of a text are handed back."""

    def __init__(self, names: list[str], order: int, keys: np.ndarray, values: np.ndarray) -> None:
        by = np.argsort(keys)
        self.names, self.order, self.keys, self.values = names, order, keys[by], values[:, by]

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
        """log10 probability of each text's frequent grams under each model, and its other grams."""
        keys, first = grams(data, offsets, self.order)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        hit = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        out = np.array([np.bincount(text[hit], v[at[hit]], len(offsets) - 1) for v in self.values])
        before = np.append(0, np.cumsum(np.bincount(text[~hit], minlength=len(offsets) - 1)))
        return out, pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(keys[~hit].astype(np.int64)))


def gram_values(table: DataFrame, wanted: DataFrame, order: int, names: list[str]) -> DataFrame:
    """(gram, v): log10 probability of each wanted gram under each model.

    Grams of one last two context bytes meet: the contexts of two bytes or more are among them, and the
    shorter ones (65,536 grams a model at most) are broadcast.  Contexts of more than SPLIT grams are dealt by a third byte; what they
    share, the grams of three bytes behind them, is broadcast: 256 a model for each such context.
    """
    context = F.expr("shiftright(gram, 8) & 65535")
    margin = lambda t, bits: t.groupBy("name", F.col("gram").bitwiseAND(F.lit((1 << bits) - 1).cast("long")).alias("gram")).agg(F.sum("n").alias("n")).toArrow()

    def arrays(rows: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        own, keys, counts = rows.column("name").to_numpy(), rows.column("gram").to_numpy().astype(np.uint64), rows.column("n").to_numpy()
        by = np.argsort(keys)
        own, keys, counts = own[by], keys[by], counts[by]
        return [(keys[own == n], counts[own == n]) for n in names]

    who = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name")).cast("int")
    both = table.select("gram", who.alias("who"), "n").unionByName(wanted.select("gram", F.lit(0).alias("who"), F.lit(0).cast("long").alias("n")))
    hot = [r.c for r in both.groupBy(context.alias("c")).agg(F.count("*").alias("m")).where(F.col("m") > SPLIT).collect()] if order >= 3 else []
    middle = arrays(margin(table.where(context.isin(hot)), 24)) if hot else None
    shared = table.sparkSession.sparkContext.broadcast((arrays(margin(table, 16)), middle, frozenset(hot)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, middle, hot = shared.value
        for t in runs(batches, ["context"]):
            first = np.append(starts(t, ["context"]), t.num_rows)
            dealt = t.column("context").to_numpy()[first[:-1]]
            split = np.array([c >> 16 > 0 for c in dealt.tolist()], bool)
            cuts = [np.repeat(~split, np.diff(first))] + [np.repeat(np.arange(len(dealt)) == k, np.diff(first)) for k in np.flatnonzero(split)]
            for mask, c in zip(cuts, [None, *dealt[split].tolist()]):
                g, who, n = (t.column(x).to_numpy()[mask] for x in ("gram", "who", "n"))
                g = g.astype(np.uint64)
                asked = g[who == 0]
                if not len(asked):
                    continue
                near = [None] * len(short) if c is None else [(k[at], m[at]) for k, m in middle for at in [np.flatnonzero(k >> np.uint64(8) == np.uint64(c & 65535))]]
                v = np.array([Model(g[who == k + 1], n[who == k + 1], order, s, near[k]).score(asked) for k, s in enumerate(short)])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(asked) + 1) * len(v), pa.int32()), pa.array(v.T.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(asked.astype(np.int64)), lists], names=["gram", "v"])

    third = F.expr("shiftleft((shiftright(gram, 24) & 255) + 1, 16)")
    dealt = both.withColumn("context", F.when(context.isin(hot), context + third).otherwise(context) if hot else context)
    return dealt.repartition("context").sortWithinPartitions("context").mapInArrow(run, "gram long, v array<double>")


def train(texts: DataFrame, order: int, most: int | None = None) -> tuple[Tables | Head, DataFrame]:
    """Models by name from all texts, and the grams' counts; of more than `most` grams only the most frequent are held."""
    most = MOST if most is None else most
    table = written(count_grams(texts, order))
    if order < 2 or table.count() <= most:
        rows = table.toArrow()
        names = rows.column("name").to_numpy()
        keys, counts = rows.column("gram").to_numpy().astype(np.uint64), rows.column("n").to_numpy()
        return Tables({n: (keys[names == n], counts[names == n]) for n in sorted(set(names.tolist()))}, order), table
    names = sorted(r.name for r in table.select("name").distinct().collect())
    total = written(table.groupBy("gram").agg(F.sum("n").alias("n")))
    rows = gram_values(table, total.where(most_frequent(total, "n", most // len(names))), order, names).toArrow()
    values = rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, len(names)).T
    return Head(names, order, rows.column("gram").to_numpy().astype(np.uint64), values), table


def finished(scored: DataFrame, tables: Tables | Head, table: DataFrame) -> DataFrame:
    """scored with `lengths` completed by the code lengths of its `grams`, which are dropped."""
    if isinstance(tables, Tables):
        return scored.drop("grams")
    row, add = unused(["row of grams", "length of grams"], scored.columns)
    scored = written(scored.withColumn(row, F.monotonically_increasing_id()))
    rest = written(scored.select(row, F.explode("grams").alias("gram")).groupBy(row, "gram").agg(F.count("*").alias("n")))
    values = gram_values(table, rest.select("gram").distinct(), tables.order, tables.names)
    more = F.array(*[F.sum(F.col("n") * F.col("v")[k]) for k in range(len(tables.names))])
    more = rest.join(values, "gram").groupBy(row).agg(more.alias(add))
    whole = F.when(F.col(add).isNull(), F.col("lengths")).otherwise(F.zip_with("lengths", add, lambda a, b: a + b))
    return scored.join(more, row, "left").withColumn("lengths", whole).drop(row, add, "grams")


def lengths_array(lengths: np.ndarray) -> pa.ListArray:
    """(models, texts) as a list for each text."""
    return pa.ListArray.from_arrays(pa.array(np.arange(lengths.shape[1] + 1) * lengths.shape[0], pa.int32()), pa.array(lengths.T.ravel(), pa.float64()))
