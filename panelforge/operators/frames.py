"""Long entities and long frames: time blocks with a halo, and frames that cost the same whatever their length.

A window keyed by an entity is one task's work, however long the entity. Here rows are numbered within their entity by
ranges (no entity is one task), cut into blocks of ROWS rows, and each block gets the last rows of the one before as a
halo. An operator that looks back at most that far gives the same values with (entity, block) as the entity. Running
products and maxima get what the blocks before them make as a carry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelforge.functions.core import col, ratio
from panelforge.sources.tables import stored

#: Rows of a block of time; at least FOLD times the halo, so that the halo adds a fourth at most.
ROWS, FOLD = 1 << 16, 4


def numbered(df: DataFrame, *keys: str, order: str = "dt", name: str = "__n") -> DataFrame:
    """df with the number of each row in its entity, from 0, in time order: sorted by ranges of (keys, order), counted
    within a range, and counted on over an entity's ranges. The rows are stored once, so that the ranges stay."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *keys, order).sortWithinPartitions(*keys, order).withColumn("__id", F.monotonically_increasing_id())
    rows = rows.withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id")
    rows = stored(rows, "numbered")
    # one row per entity and range that it is in
    first = rows.groupBy(*keys, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.withColumn("__base", before - F.col("__first")).drop("__c", "__first").withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)}).withColumnRenamed("__part", "__p")
    on = rows["__part"] == first["__p"]
    for i, k in enumerate(keys):
        on &= rows[k].eqNullSafe(first[f"__k{i}"])
    return rows.join(first, on).withColumn(name, F.col("__base") + F.col("__at")).drop("__part", "__p", "__at", "__base", *[f"__k{i}" for i in range(len(keys))])


def over_blocks(df: DataFrame, reach: int, operate: Callable[[DataFrame], DataFrame], entity: str = "entity", order: str = "dt", rows: int = ROWS) -> DataFrame:
    """operate(df), for an operator of an entity's rows in time order that looks at most `reach` rows back, over blocks of
    time. operate sees the column `entity` as (entity, block) and must keep the columns that it is given."""
    size = max(rows, FOLD * reach, 1)
    block = F.floor(F.col("__n") / size)
    ahead = F.floor((F.col("__n") + reach) / size)  # a row in the halo of the block ahead
    own = numbered(df, entity, order=order).withColumn("__b", F.explode(F.array_distinct(F.array(block, ahead)))).withColumn("__own", F.col("__b") == block)
    out = operate(own.withColumn(entity, F.struct(F.col(entity).alias("id"), F.col("__b").alias("block"))))
    return out.where("__own").withColumn(entity, F.col(entity)["id"]).drop("__n", "__b", "__own")


def nav_and_drawdown(df: DataFrame, ret: str, entity: str = "entity", order: str = "dt", rows: int = ROWS) -> DataFrame:
    """Adds nav, the running product of 1 + ret (missing: 0), and drawdown, nav over its running maximum less one. Within
    blocks by windows; what a block hands on is one row: its product and the highest point on its way."""
    own = numbered(df, entity, order=order).withColumn("__b", F.floor(F.col("__n") / rows))
    upto = Window.partitionBy(entity, "__b").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("__v", F.product(1 + F.coalesce(col(ret), F.lit(0.0))).over(upto))
    ends = own.groupBy(entity, "__b").agg(F.max_by("__v", "__n").alias("__p"), F.max("__v").alias("__m"), F.min("__v").alias("__l"))
    before = Window.partitionBy(entity).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__start", F.coalesce(F.product("__p").over(before), F.lit(1.0)))
    ends = ends.withColumn("__top", F.max(F.greatest(F.col("__start") * F.col("__m"), F.col("__start") * F.col("__l"))).over(before)).select(F.col(entity).alias("__e"), F.col("__b").alias("__k"), "__start", "__top")
    out = own.join(ends, own[entity].eqNullSafe(ends["__e"]) & (own["__b"] == ends["__k"])).withColumn("nav", F.col("__start") * F.col("__v"))
    top = F.greatest(F.max("nav").over(upto), "__top")
    return out.withColumn("drawdown", ratio("nav", top) - 1).drop("__n", "__b", "__v", "__e", "__k", "__start", "__top")


# ---- frames in Arrow batches


def framed(df: DataFrame, x: str, n: int, kernel: Callable[[np.ndarray, int], dict[str, np.ndarray]], outputs: dict[str, str], *keys: str, order: str = "dt") -> DataFrame:
    """Adds the outputs of a kernel (values with NaN for null, n) to each row, over its trailing frame of n rows. A task
    holds a batch and the n - 1 rows before it; NaN outputs are null."""
    names, columns, rows = list(outputs), df.columns, df.repartition(*keys).sortWithinPartitions(*keys, order)
    # the key as one number a row tells where an entity ends, whatever its type
    rows = rows.withColumns({"__key": F.xxhash64(*keys), "__x": col(x).cast("double")})
    schema = StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in outputs.items())).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tail = None, np.empty(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("__key").to_numpy()
            value = batch.column("__x").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
            parts: dict[str, list[np.ndarray]] = {c: [] for c in names}
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                tail = tail if key[i] == last else np.empty(0)
                seen = np.r_[tail, value[i:j]]
                for c, v in kernel(seen, n).items():
                    parts[c].append(v[len(tail) :])
                last, tail = key[i], seen[len(seen) - min(n - 1, len(seen)) :]
            new = [pa.array(np.concatenate(parts[c]), from_pandas=True) for c in names]
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=[*columns, *names])

    return rows.mapInArrow(run, schema)


def _window_counts(present: np.ndarray, n: int) -> np.ndarray:
    total = np.r_[0, np.cumsum(present)]
    i = np.arange(1, len(present) + 1)
    return total[i] - total[np.maximum(i - n, 0)]


def counted_below(rank: np.ndarray, start: np.ndarray, stop: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many of rank[start[i]:stop[i]] are below limit[i]: a wavelet matrix, one bit of the ranks a level, all queries at
    once. The cost grows with the rows and the bits of their number, not with the length of the frames."""
    out, order = np.zeros(len(start), np.int64), rank
    top = max(int(rank.max(initial=0)), int(limit.max(initial=0)))
    for bit in range(top.bit_length() - 1, -1, -1):
        zero = (order >> bit) & 1 == 0
        zeros = np.r_[0, np.cumsum(zero)]
        s, e, high = zeros[start], zeros[stop], (limit >> bit) & 1 == 1
        out += np.where(high, e - s, 0)
        # ones follow all zeros on the next level
        start, stop = np.where(high, zeros[-1] + start - s, s), np.where(high, zeros[-1] + stop - e, e)
        order = np.r_[order[zero], order[~zero]]
    return out


def rank_kernel(x: np.ndarray, n: int) -> dict[str, np.ndarray]:
    present = ~np.isnan(x)
    rank = np.zeros(len(x), np.int64)
    rank[present] = np.unique(x[present], return_inverse=True)[1]
    stop = np.arange(1, len(x) + 1)
    start = np.maximum(stop - n, 0)
    full = _window_counts(present, n) >= n
    start, stop, at = start[full], stop[full], rank[full]
    below = counted_below(rank, start, stop, at)
    same = counted_below(rank, start, stop, at + 1) - below
    out = np.full(len(x), np.nan)
    out[full] = (below + (same + 1) / 2) / n
    return {"rank": out}


def _then(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Two stretches of returns, one after the other: (growth, highest and lowest point on the way, deepest fall)."""
    return a[0] * b[0], np.maximum(a[1], a[0] * b[1]), np.minimum(a[2], a[0] * b[2]), np.minimum(np.minimum(a[3], b[3]), a[0] * b[2] / a[1] - 1)


def _fall(returns: np.ndarray) -> float:
    v, top, out = 1.0, 1.0, 0.0
    for r in returns:
        v *= 1 + r
        top = max(top, v)
        out = min(out, v / top - 1)
    return out


def rating_kernel(x: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """count, total (compound growth less one), fall (the deepest, from the frame's start on), mean and deviation of the
    values of each frame. Stretches of 1, 2, 4, ... rows are put together, so a frame of n takes the bits of n."""
    present, size = ~np.isnan(x), len(x)
    r = np.where(present, x, 0.0)
    g = np.r_[np.ones(n - 1), 1 + r]  # nothing happens before the first row
    # stretches of 2**k rows that end at each row; and what the frame's newest rows make so far
    stretch = (g, np.maximum(g, 1.0), np.minimum(g, 1.0), np.minimum(g - 1, 0.0))
    frame, taken, length = None, 0, 1
    while True:
        if n & length:
            part = tuple(np.r_[np.ones(min(taken, len(g))), c[: len(g) - taken]] if i < 3 else np.r_[np.zeros(min(taken, len(g))), c[: len(g) - taken]] for i, c in enumerate(stretch))
            frame = part if frame is None else _then(part, frame)
            taken += length
        if taken == n:
            break
        back = tuple(np.r_[np.full(min(length, len(g)), float(i < 3)), c[: max(len(g) - length, 0)]] for i, c in enumerate(stretch))
        stretch, length = _then(back, stretch), 2 * length
    growth, fall = frame[0][n - 1 :], frame[3][n - 1 :]
    for i in np.flatnonzero(_window_counts(1 + r < 0, n)):  # a loss of more than all: points change their sign
        fall[i] = _fall(r[max(0, i + 1 - n) : i + 1])
    count = _window_counts(present, n)
    centre = x[present].mean() if present.any() else 0.0
    c = np.where(present, x - centre, 0.0)
    s, ss = (np.r_[0.0, np.cumsum(v)] for v in (c, c * c))
    i = np.arange(1, size + 1)
    s, ss = s[i] - s[np.maximum(i - n, 0)], ss[i] - ss[np.maximum(i - n, 0)]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = s / count + centre
        deviation = np.sqrt(np.maximum(ss - s * s / count, 0) / (count - 1))
    deviation[deviation <= 1e-9 * np.abs(x[present]).max(initial=0)] = 0.0
    return {"count": count.astype(float), "total": growth - 1, "fall": fall, "mean": mean, "deviation": np.where(count > 1, deviation, np.nan)}
