"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its documents: whole copies plus one
fraction. The fractions, times the documents' words, are masses that sum to what the source still needs. Two documents
of a source that both have a fraction meet, and mass moves from one to the other, in a random direction, until one of
them holds all of its words or none; the expected copies of each stay as they were, and the source's sum stays exactly.
A tree does this: each of FIRST parts of a source leaves one document with a fraction, the parts of a group of FAN leave
one between them, and so on up to one for the source. That last one has no partner: it is taken in part ("cut": its
first words, so that the source meets its target to a word), or decided by a draw ("coin": whole copies only).

Defined results: a null text has no words and none are taken of it; a null source is a source of its own, the last;
null or repeated doc_ids are rows like any other, and rows that repeat take part one by one; a source without words has
target 0; an empty table gives an empty result; other columns are ignored. Ties in the order of a part are rows that
are equal in id, text and source, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import drop, mix, ranked, read, text_of, written

#: Weights of the sources in turn, most copies of a document, runs of bytes that are words.
WEIGHTS = (5, 2, 1)
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Parts of a source in which the tree begins, and how many of them meet at a node.
FIRST, FAN = 4096, 64


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), order of each row."""
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64("doc_id", text_of()).alias("order"),
    )


def targets(rows: DataFrame, scratch: list[str], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, sid (its place by code point, null last), source_size, target, from a table in the shared folder.

    With W the weight of the sources below their bound and R what the bounded ones leave of all words, a target is the
    lesser of its bound and R * weight / W. Bounds only join while R / W grows, so a few sums settle who is bounded; the
    driver sees three numbers a round."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    held = ranked(sums, F.col("source").asc_nulls_last(), name="mixing-sources", rank="sid", scratch=scratch)
    held = held.withColumn("w", F.array(*map(F.lit, weights))[F.pmod("sid", F.lit(len(weights))).cast("int")])
    every = held.agg(F.sum("source_size"), F.sum("w")).first()
    total, rest, weight, bounded = every[0] or 0, every[0] or 0, every[1] or 1, 0
    while True:
        share = F.lit(float(rest)) * F.col("w") / F.lit(float(weight))
        over = share >= most * F.col("source_size")
        now = held.where(over).agg(F.count("*"), F.sum("source_size"), F.sum("w")).first()
        if now[0] <= bounded:
            break
        bounded, rest, left = now[0], total - most * now[1], every[1] - now[2]
        if left <= 0:
            break
        weight = left
    target = F.when(over, (most * F.col("source_size")).cast("double")).otherwise(share)
    return written(held.select("source", "sid", "source_size", target.alias("target")), "mixing-targets", scratch)


def _draw(a: int, b: int, level: int, seed: int) -> float:
    with np.errstate(over="ignore"):
        x = mix(np.array([a, b], dtype=np.int64).view(np.uint64) + np.uint64(seed * 64 + level))
        return float(mix(x[:1] * np.uint64(3) ^ x[1:])[0] >> np.uint64(11)) / (1 << 53)


def meet(a: tuple[int, float, int], b: tuple[int, float, int], u: float) -> tuple[float, float]:
    """New masses of two documents (size, mass, order) with 0 < mass < size: one of them is 0 or its size, the sum stays."""
    up, down = min(a[0] - a[1], b[1]), min(a[1], b[0] - b[1])  # what can move to a, and from a
    if u * (up + down) < down:
        return (float(a[0]), b[1] - up) if up == a[0] - a[1] else (a[1] + up, 0.0)
    return (0.0, b[1] + down) if down == a[1] else (a[1] - down, float(b[0]))


def _settle(level: int, seed: int):
    """Rows in order of their node to rows with `extra`, the words taken beyond whole copies; null for the one row of a
    node that keeps a fraction. One row is held between batches, so memory doesn't grow."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row with a fraction: a table of one row, its node, (size, mass, order)
        for batch in batches:
            names = batch.schema.names
            rows = pa.Table.from_batches([*([held[0]] if held else []), batch])
            sid, node, size, order, mass = (rows[c].to_pylist() for c in ("sid", "node", "size", "order", "mass"))
            extra: list[int | None] = [None] * len(sid)
            carry, at = None, None  # place and node of the row that keeps a fraction
            for i in range(len(sid)):
                if at != (sid[i], node[i]):
                    carry, at = None, (sid[i], node[i])
                if 0 < mass[i] < size[i] and carry is not None:
                    j = carry
                    mass[j], mass[i] = meet((size[j], mass[j], order[j]), (size[i], mass[i], order[i]), _draw(order[j], order[i], level, seed))
                    for k in (j, i):
                        if not 0 < mass[k] < size[k]:
                            extra[k] = round(mass[k])
                    carry = next((k for k in (j, i) if 0 < mass[k] < size[k]), None)
                elif 0 < mass[i] < size[i]:
                    carry = i
                else:
                    extra[i] = round(mass[i])
            rows = rows.set_column(names.index("mass"), "mass", pa.array(mass, pa.float64()))
            rows = rows.set_column(names.index("extra"), "extra", pa.array(extra, pa.int64()))
            keep = np.ones(len(sid), bool)
            held = None
            if carry is not None:
                keep[carry] = False
                held = (rows.slice(carry, 1).combine_chunks().to_batches()[0],)
            yield from rows.filter(pa.array(keep)).to_batches()
        if held:
            yield held[0]

    return settle


def mix_sources(docs: DataFrame, seed: int = 11, last: str = "cut", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, scratch: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (whole ones), taken (words, repeats counted) of each row."""
    if last not in ("cut", "coin"):
        raise ValueError(f"last must be cut or coin, not {last}")
    mine: list[str] = []
    rows = written(sized(docs), "mixing-rows", mine)
    to = targets(rows, mine, weights, most)
    # few sources are sent to the rows, many are shuffled: their table's size decides
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.join(to.withColumnRenamed("source", "of").withColumn("rate", rate), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("copies", F.floor("rate").cast("long")).withColumn("mass", (F.col("rate") - F.floor("rate")) * F.col("size"))
    rows = rows.withColumns({"extra": F.lit(None).cast("long"), "node": F.pmod("order", F.lit(FIRST))}).drop("rate")
    done, level, nodes = [], 0, FIRST
    while True:
        dealt = rows.repartition("sid", "node").sortWithinPartitions("sid", "node", "order", "doc_id", "size")
        out = written(dealt.mapInArrow(_settle(level, seed), dealt.schema), f"mixing-level{level}", mine)
        done.append(out.where("extra is not null"))
        rows = out.where("extra is null")
        if nodes == 1:
            break
        nodes, level = -(-nodes // FAN), level + 1
        rows = rows.withColumn("node", F.floor(F.col("node") / FAN).cast("long"))
    part = F.round("mass") if last == "cut" else F.when(F.pmod(F.xxhash64("order", F.lit(seed)), F.lit(1 << 30)) < F.col("mass") / F.col("size") * (1 << 30), F.col("size")).otherwise(0)
    out = rows.withColumn("extra", part.cast("long"))
    for d in done:
        out = out.unionByName(d)
    out = out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size") + F.col("extra")).alias("taken"))
    if scratch is not None:  # the caller deletes them when it has used the rows
        scratch += mine
        return out
    kept = written(out, "mixing")
    drop(docs.sparkSession, mine)
    return kept


def op11_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
