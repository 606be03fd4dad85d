"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's slot is a hash of its text modulo a few thousand, so equal texts share a slot and with it a shard. Only a
group of equal texts that alone holds more bytes than a shard's whole share, and so can't be in one shard of near equal
size, is cut: into parts of at most half a share, each of them in a slot of its own; such groups number fewer than the
shards, so their keys are a bounded broadcast. Bytes are added up per slot. The slot-to-shard map is the only state: a
table in the shared folder with one version per edit. The first version deals the slots round; rebalancing reads the
newest version, moves slots from the fullest to the emptiest shards, and stores the edit as the next version.

Defined results: a null text has no bytes; every row counts its UTF-8 bytes plus OVERHEAD; null or repeated doc_ids
are rows like any other; positions within a shard are gapless; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import exists, new_path, read, text_key, text_of, written

SLOTS, SHARDS, OVERHEAD = 4096, 40, 16
#: Rows of a slot are numbered in so many parts, so that no slot is one task's work.
DEALS = 16


@dataclass(frozen=True)
class SlotMap:
    """version, number of shards, and the shard of each slot."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @staticmethod
    def even(slots: int, shards: int) -> SlotMap:
        """The first version: slots dealt round, before any weight is known."""
        return SlotMap(1, shards, tuple(i % shards for i in range(slots)))

    @staticmethod
    def balanced(weight: list[int], shards: int) -> SlotMap:
        """A first version for weights that are known."""
        return SlotMap(1, shards, SlotMap.even(len(weight), shards).rebalanced(weight).shard_of)

    def loads(self, weight: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, s in enumerate(self.shard_of):
            out[s] += weight[slot]
        return out

    def grown(self, weight: list[int]) -> SlotMap:
        """One more shard, which takes slots from the fullest shards until it holds its share; nothing else moves."""
        shard_of, loads = list(self.shard_of), [*self.loads(weight), 0]
        target, new = sum(weight) / (self.shards + 1), self.shards
        own: list[list[int]] = [[] for _ in range(new)]
        for slot in sorted(range(len(weight)), key=lambda i: (weight[i], i)):
            own[shard_of[slot]].append(slot)
        while any(own):
            s = max((s for s in range(new) if own[s]), key=lambda s: (loads[s], -s))
            slot = own[s].pop()
            if loads[new] + weight[slot] > target and weight[slot]:
                continue
            shard_of[slot] = new
            loads[s] -= weight[slot]
            loads[new] += weight[slot]
        return SlotMap(self.version + 1, self.shards + 1, tuple(shard_of))

    def rebalanced(self, weight: list[int], tolerance: float = 0.001) -> SlotMap:
        """The same shards for new weights: the next version, in which slots move from the fullest to the emptiest shard
        while that brings the two closer; this version itself where nothing moves."""
        shard_of, loads = list(self.shard_of), self.loads(weight)
        mean, own = sum(weight) / self.shards, [[] for _ in range(self.shards)]
        for slot in sorted(range(len(weight)), key=lambda i: (weight[i], i)):
            if weight[slot]:
                own[shard_of[slot]].append(slot)
        stuck: set[int] = set()
        while len(stuck) < self.shards:
            a = max((s for s in range(self.shards) if s not in stuck), key=lambda s: (loads[s], -s))
            b = min(range(self.shards), key=lambda s: (loads[s], s))
            gap = loads[a] - loads[b]
            fits = [i for i in own[a] if weight[i] < gap] if loads[a] > mean * (1 + tolerance) else []
            if not fits:
                stuck.add(a)
                continue
            # the move that leaves the two most alike
            slot = min(fits, key=lambda i: (abs(gap - 2 * weight[i]), i))
            own[a].remove(slot)
            own[b].append(slot)
            shard_of[slot] = b
            loads[a] -= weight[slot]
            loads[b] += weight[slot]
            stuck.discard(b)
        return self if tuple(shard_of) == self.shard_of else SlotMap(self.version + 1, self.shards, tuple(shard_of))

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to a table; versions that are there stay, and one that is there already is an error, so that of
        two writers of one version the second fails and has to read the first one's map."""
        rows = [(self.shards, i, s) for i, s in enumerate(self.shard_of)]
        spark.createDataFrame(rows, "shards int, slot int, shard int").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A version of the map, the newest one by default."""
        table = spark.read.parquet(path)
        v = table.agg(F.max("version")).first()[0] if version is None else version
        rows = sorted(table.where(F.col("version") == v).select("slot", "shard", "shards").collect())
        if [r["slot"] for r in rows] != list(range(len(rows))):
            raise ValueError(f"version {v} of {path} isn't whole")
        return SlotMap(v, rows[0]["shards"], tuple(r["shard"] for r in rows))


def slotted(docs: DataFrame, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """doc_id, tk, size, text_crc32, deal, virtual_slot of each row, from a table in the shared folder."""
    rows = docs.select(
        F.col("doc_id"), text_key().alias("tk"), (F.octet_length(text_of()) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text_of()).alias("text_crc32"), (F.monotonically_increasing_id() % DEALS).cast("int").alias("deal"),
    )
    rows = written(rows, "sharding-rows")
    share = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    hot = rows.groupBy("tk").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("bytes") > share))
    rows = rows.join(F.broadcast(hot.select("tk", F.ceil(2 * F.col("bytes") / F.lit(share or 1.0)).alias("parts"))), "tk", "left")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id", "deal"), F.col("parts")))
    slot = F.pmod(F.when(part.isNull(), F.xxhash64("tk")).otherwise(F.xxhash64("tk", part)), F.lit(slots))
    return rows.withColumn("virtual_slot", slot.cast("int")).drop("parts")


def slot_counts(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[list[int]]]:
    """(bytes of each slot, rows of each slot's parts): so many numbers however long the table."""
    weight, count = [0] * slots, [[0] * DEALS for _ in range(slots)]
    for r in rows.groupBy("virtual_slot", "deal").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        weight[r["virtual_slot"]] += r["b"]
        count[r["virtual_slot"]][r["deal"]] = r["n"]
    return weight, count


def current_map(spark: SparkSession, path: str, weight: list[int], shards: int = SHARDS) -> SlotMap:
    """The stored map, made if there is none and edited if the weights ask for it, as read back from its table."""
    if not exists(spark, path):
        SlotMap.even(len(weight), shards).save(spark, path)
    held = SlotMap.load(spark, path)
    edited = held.rebalanced(weight)
    if edited.version != held.version:
        edited.save(spark, path)
    return SlotMap.load(spark, path)


def shard_rows(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """(rows with shard and their gapless place in it, the map used). path is the table of the map's versions; a table
    of its own in the shared folder if none is given."""
    rows = slotted(docs, slots, shards)
    weight, count = slot_counts(rows, slots)
    table = current_map(docs.sparkSession, path or new_path(docs.sparkSession, "slot-map"), weight, shards)
    base, seen = [], [0] * table.shards
    for slot, s in enumerate(table.shard_of):
        for deal, n in enumerate(count[slot]):
            if n:
                base.append((slot, deal, s, seen[s]))
            seen[s] += n
    places = docs.sparkSession.createDataFrame(base, "virtual_slot int, deal int, shard int, base long")
    w = Window.partitionBy("virtual_slot", "deal").orderBy("doc_id", "tk")
    out = rows.withColumn("k", F.row_number().over(w)).join(F.broadcast(places), ["virtual_slot", "deal"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("k") - 1).alias("slot"), "virtual_slot"), table


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, table = shard_rows(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(table.version).alias("map_version"))
