"""Sums of products of a panel's series, as products of matrices in blocks.

The panel (series x dates) is cut into blocks of BLOCK series and CHUNK dates. Pairs or triples of blocks of series are
dealt over tasks; a task gets their dates a chunk at a time, in order, and adds to its sums. So no row, task or shuffle
key holds a panel: memory is that of the sums of one pair or triple, whatever the number of series and dates. A sum is
over the dates on which all of its own series have a value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.core import col
from panelforge.sources.tables import stored

#: Series of a block of triples and of pairs, and dates of a chunk: sums of 15 x 64^3 numbers, rows of up to 3 MB.
BLOCK, PAIR_BLOCK, CHUNK = 64, 256, 512
#: The block under which the market's values travel.
MARKET = -1
#: What is left of a regressor, relative to its own square, under which it counts as a combination of the others.
COLLINEAR = 1e-12


@dataclass(frozen=True)
class Blocked:
    """cells: (keys, block, chunk, cells: array of (i, v) with i = date of the chunk * width + series of the block)."""

    cells: DataFrame
    names: DataFrame
    count: int
    width: int
    keys: tuple[str, ...]

    @property
    def blocks(self) -> int:
        return -(-self.count // self.width)


def blocked(df: DataFrame, value: str, series: str = "series", keys: Sequence[str] = (), market: str | None = None, width: int = BLOCK) -> Blocked:
    """Cut a panel (keys, series, dt, value) into blocks; it is read once. Series are numbered in the order of their
    names. With a market, series and dates without any value of it take no part."""
    keys = tuple(keys)
    rows = df.where(col(value).isNotNull()).select(*keys, F.col(series).cast("string").alias("__s"), "dt", F.col(value).cast("double").alias("__v"), *([F.col(market).cast("double").alias("__m")] if market else []))
    rows = stored(rows, "panel")
    seen = rows.where("__m is not null") if market else rows
    # one row per series and per date of a study
    place = lambda d, c, to: stored(d.select(c).distinct().select(c, (F.row_number().over(Window.orderBy(c)) - 1).alias(to)), "places")
    names, dates = place(seen, "__s", "sid"), place(seen, "dt", "pos")
    at = rows.join(names, "__s").join(dates, "dt")
    chunk, within = F.floor(F.col("pos") / CHUNK).cast("int").alias("chunk"), F.col("pos") % CHUNK
    cell = lambda i, v: F.collect_list(F.struct(i.cast("int").alias("i"), F.col(v).alias("v"))).alias("cells")
    cells = at.groupBy(*keys, F.floor(F.col("sid") / width).cast("int").alias("block"), chunk).agg(cell(within * width + F.col("sid") % width, "__v"))
    if market:
        days = seen.groupBy(*keys, "dt").agg(F.max("__m").alias("__m")).join(dates, "dt")
        cells = cells.unionByName(days.groupBy(*keys, F.lit(MARKET).alias("block"), chunk).agg(cell(within, "__m")))
    return Blocked(cells, names.withColumnRenamed("__s", "name"), names.count(), width, keys)


def _over_groups(held: Blocked, size: int, start: Callable, add: Callable, finish: Callable, schema: str) -> DataFrame:
    """Run start(sizes), add(sums, blocks of a chunk), finish(group, sums) over all non-decreasing pairs of blocks, and all
    third blocks if size is 3."""
    spark, n, width, count, keys = held.cells.sparkSession, held.blocks, held.width, held.count, held.keys
    names = [f"b{i}" for i in range(size)]
    groups = spark.range(n**size).select(*[(F.floor(F.col("id") / n**i) % n).cast("int").alias(f"b{i}") for i in range(size)]).where("b0 <= b1")
    parts = groups.select(*names, F.explode(F.array_distinct(F.array(F.lit(MARKET), *names))).alias("block"))
    dealt = held.cells.join(parts, "block").select(*keys, *names, "chunk", "block", "cells")
    dealt = dealt.repartition(*keys, *names).sortWithinPartitions(*keys, *names, "chunk", "block")
    # the types of the keys, as they come out again
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in held.cells.select(*keys).schema)
    sizes = lambda group: [min(width, count - b * width) for b in group[len(keys) :]]

    def dense(i: np.ndarray, v: np.ndarray, wide: int, used: int) -> np.ndarray:
        out = np.full(CHUNK * wide, np.nan)
        out[i] = v
        return out.reshape(CHUNK, wide)[:, :used]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = chunk = sums = None
        types: list[pa.DataType] = []
        here: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def settle() -> None:
            if not here:
                return
            market = dense(*here[MARKET], 1, 1)[:, 0] if MARKET in here else None
            wanted = group[len(keys) :]
            if all(b in here for b in wanted):
                add(sums, market, *[dense(*here[b], width, m) for b, m in zip(wanted, sizes(group), strict=True)])
            here.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for batch in finish(group[len(keys) :], sums):
                at = [pa.array([k] * batch.num_rows, t) for k, t in zip(group[: len(keys)], types, strict=True)]
                yield pa.RecordBatch.from_arrays([*at, *batch.columns], names=[*keys, *batch.schema.names])

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            lists = batch.column("cells")
            ends, flat = lists.offsets.to_numpy(), lists.values
            i, v = (flat.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            rows = zip(*[batch.column(c).to_pylist() for c in (*keys, *names, "chunk", "block")], strict=True)
            for r, row in enumerate(rows):
                if row[:-2] != group:
                    settle()
                    if group is not None:
                        yield from out()
                    group, chunk = row[:-2], row[-2]
                    sums = start(sizes(group))
                elif row[-2] != chunk:
                    settle()
                    chunk = row[-2]
                here[row[-1]] = i[ends[r] : ends[r + 1]], v[ends[r] : ends[r + 1]]
        settle()
        if group is not None:
            yield from out()

    return dealt.mapInArrow(run, kinds + schema)


# ---- triples: regressions on the market and two series


def _add_triples(sums: dict[str, np.ndarray], market: np.ndarray | None, x1: np.ndarray, x2: np.ndarray, y: np.ndarray) -> None:
    on = ~np.isnan(market) if market is not None else np.zeros(len(y), bool)
    if not on.any():
        return
    m, x1, x2, y = market[on], x1[on], x2[on], y[on]
    w1, w2, wy = (np.isfinite(x).astype(float) for x in (x1, x2, y))
    x1, x2, y = (np.nan_to_num(x) for x in (x1, x2, y))
    # products of a first and a second column, one row a date; then of those with the third
    both = lambda a, b, c=None: ((a[:, :, None] * b[:, None, :]).reshape(len(m), -1)) * (1.0 if c is None else c[:, None])
    for left, out in (
        (both(w1, w2), (("n", wy), ("y", y), ("yy", y * y))), (both(w1, w2, m), (("m", wy), ("my", y))), (both(w1, w2, m * m), (("mm", wy),)), (both(x1, w2), (("1", wy), ("1y", y))),
        (both(x1 * x1, w2), (("11", wy),)), (both(x1, w2, m), (("m1", wy),)), (both(w1, x2), (("2", wy), ("2y", y))), (both(w1, x2 * x2), (("22", wy),)), (both(w1, x2, m), (("m2", wy),)), (both(x1, x2), (("12", wy),)),
    ):
        for name, right in out:
            sums[name] += left.T @ right


_TRIPLES = ("n", "y", "yy", "m", "my", "mm", "1", "1y", "11", "m1", "2", "2y", "22", "m2", "12")


def _alpha_t(s: dict[str, np.ndarray]) -> np.ndarray:
    """t of the constant in each regression of y on market, two series and a constant; NaN where it can't be fitted.

    Elimination in that order: what is left of the constant is its own, and with it its t."""
    names = ("m", "1", "2", "")
    a = {(i, j): s["".join((names[i], names[j])) or "n"].copy() for i in range(4) for j in range(i, 4)}
    b = [s[f"{c}y"].copy() for c in names]
    diagonal = [a[i, i].copy() for i in range(4)]
    rss, sound = s["yy"].copy(), s["n"] > 4
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(4):
            sound &= a[k, k] > COLLINEAR * diagonal[k]
            p = np.where(sound, a[k, k], 1.0)
            rss -= b[k] ** 2 / p
            for i in range(k + 1, 4):
                f = a[k, i] / p
                b[i] -= f * b[k]
                for j in range(i, 4):
                    a[i, j] -= f * a[k, j]
        t = b[3] / np.sqrt(a[3, 3] * np.maximum(rss, 0.0) / (s["n"] - 4))
    t[~(sound & np.isfinite(t))] = np.nan
    return t


def triple_alphas(held: Blocked, counted: float | None = None) -> DataFrame:
    """(keys, f1, f2, asset, t), as numbers of series, of the alphas of all models of the market and two series; with
    `counted`, a hurdle, (keys, f1, f2, matched, assets) instead, counted where the regressions are."""
    width, total = held.width, held.count

    def finish(group: tuple[int, ...], sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids = [np.arange(b * width, min((b + 1) * width, total)) for b in group]
        t = _alpha_t(sums).reshape([len(x) for x in ids])
        f1, f2, asset = np.meshgrid(*ids, indexing="ij")
        real = (f1 < f2) & (asset != f1) & (asset != f2)
        if counted is None:
            for i in range(len(ids[0])):  # a first factor at a time
                on = real[i]
                if on.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[i][on].astype(np.int32)) for x in (f1, f2, asset)] + [pa.array(t[i][on], from_pandas=True)], names=["f1", "f2", "asset", "t"])
        else:
            with np.errstate(invalid="ignore"):
                matched, assets = ((np.abs(t) < counted) & real).sum(axis=2), real.sum(axis=2)
            on = assets > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (f1[:, :, 0].astype(np.int32), f2[:, :, 0].astype(np.int32), matched, assets)], names=["f1", "f2", "matched", "assets"])

    start = lambda sizes: {c: np.zeros((sizes[0] * sizes[1], sizes[2])) for c in _TRIPLES}
    schema = "f1 int, f2 int, asset int, t double" if counted is None else "f1 int, f2 int, matched long, assets long"
    return _over_groups(held, 3, start, _add_triples, finish, schema)


# ---- pairs


def _add_pairs(sums: dict[str, np.ndarray], market: np.ndarray | None, x: np.ndarray, y: np.ndarray) -> None:
    wx, wy = np.isfinite(x).astype(float), np.isfinite(y).astype(float)
    x, y = np.nan_to_num(x), np.nan_to_num(y)
    for name, left, right in (("n", wx, wy), ("sa", x, wy), ("sb", wx, y), ("p", x, y)):
        sums[name] += left.T @ right


_pairs = lambda sizes: {c: np.zeros(tuple(sizes)) for c in ("n", "sa", "sb", "p")}


def covariance_blocks(held: Blocked) -> DataFrame:
    """(b0, b1, cov, trace): covariances of the series of two blocks, row by row, over the dates that a pair shares (0 where
    those are fewer than two); both ways round."""

    def finish(group: tuple[int, ...], s: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        c = np.where(s["n"] > 1, (s["p"] - s["sa"] * s["sb"] / np.maximum(s["n"], 1)) / np.maximum(s["n"] - 1, 1), 0.0)
        same = group[0] == group[1]
        ways = [(group[0], group[1], c.tobytes(), float(np.trace(c)) if same else 0.0)] + ([] if same else [(group[1], group[0], np.ascontiguousarray(c.T).tobytes(), 0.0)])
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*ways, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.float64()), strict=True)], names=["b0", "b1", "cov", "trace"])

    return _over_groups(held, 2, _pairs, _add_pairs, finish, "b0 int, b1 int, cov binary, trace double")


def pair_sums(held: Blocked) -> DataFrame:
    """(a, b, n, sa, sb, p) per pair of series, both ways round: shared dates, the sum of each series and of the products."""
    width = held.width

    def finish(group: tuple[int, ...], s: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for flip in (False, True)[: 1 + (group[0] != group[1])]:
            one = (lambda x: x.T) if flip else (lambda x: x)
            n, sa, sb, p = (np.ascontiguousarray(one(s[c])) for c in (("n", "sb", "sa", "p") if flip else ("n", "sa", "sb", "p")))
            i, j = np.nonzero(n)
            a, b = (group[1], group[0]) if flip else group
            columns = [pa.array((i + a * width).astype(np.int32)), pa.array((j + b * width).astype(np.int32)), pa.array(n[i, j].astype(np.int64)), *[pa.array(x[i, j]) for x in (sa, sb, p)]]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n", "sa", "sb", "p"])

    out = _over_groups(held, 2, _pairs, _add_pairs, finish, "a int, b int, n long, sa double, sb double, p double")
    return named(held, out, "a", "b")


def named(held: Blocked, df: DataFrame, *columns: str) -> DataFrame:
    """Numbers of series back to their names."""
    for c in columns:
        df = df.join(held.names.select(F.col("sid").alias(c), F.col("name").alias(f"__{c}")), c).drop(c)
    return df.withColumnsRenamed({f"__{c}": c for c in columns})


def leading(cov: DataFrame, count: int, width: int, k: int, tolerance: float = 1e-11, steps: int = 200, most: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors (columns) of a symmetric matrix in blocks (b0, b1, cov).

    A subspace grows by what the matrix makes of its best vectors, orthogonalised, until those are vectors of the matrix
    to `tolerance`. Each step is one distributed product of the blocks with a thin matrix; the driver holds that one:
    `count` rows and at most `most` times k + 4 columns, never a block."""
    spark, p = cov.sparkSession, min(count, k + 4)

    def times(v: np.ndarray) -> np.ndarray:
        thin = spark.sparkContext.broadcast(v)
        wide = v.shape[1]

        def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b0, b1, c in zip(*[batch.column(x).to_pylist() for x in ("b0", "b1", "cov")], strict=True):
                    x = thin.value[b1 * width : (b1 + 1) * width]
                    y = np.frombuffer(c).reshape(-1, len(x)) @ x
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(y), dtype=np.int32) + b0 * width), *[pa.array(col) for col in y.T]], names=["sid", *[f"y{i}" for i in range(wide)]])

        parts = cov.select("b0", "b1", "cov").mapInArrow(product, "sid int, " + ", ".join(f"y{i} double" for i in range(wide)))
        got = parts.groupBy("sid").agg(*[F.sum(f"y{i}") for i in range(wide)]).toArrow()
        out = np.zeros(v.shape)
        out[got.column(0).to_numpy()] = np.column_stack([got.column(i + 1).to_numpy() for i in range(wide)])
        thin.destroy()
        return out

    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(count, p)))[0]
    image = times(basis)
    for _ in range(steps):
        h = basis.T @ image
        value, y = np.linalg.eigh((h + h.T) / 2)
        value, y = value[::-1][:p], y[:, ::-1][:, :p]
        left = image @ y - basis @ y * value
        if np.abs(left[:, :k]).max() <= tolerance * max(abs(value[0]), 1e-300) or basis.shape[1] >= count:
            break
        if basis.shape[1] + p > most * p:  # begin again from the best vectors
            basis, image = basis @ y, image @ y
        for _ in range(2):
            left -= basis @ (basis.T @ left)
        u, size, _ = np.linalg.svd(left, full_matrices=False)
        new = u[:, size > 1e-14 * max(abs(value[0]), 1e-300)]
        if not new.shape[1]:
            break
        new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
        new = new[:, : count - basis.shape[1]]
        basis, image = np.column_stack([basis, new]), np.column_stack([image, times(new)])
    return value[:k], (basis @ y)[:, :k]
