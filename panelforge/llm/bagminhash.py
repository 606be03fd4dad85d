"""Near-duplicate documents by BagMinHash: weighted-Jaccard signatures of five-word shingles, banding, verification.

The weight of a shingle is its number of occurrences. Weight levels are discretised as 0, 1, 2, 4, ...: level j is an
independent Poisson process over (2**(j-1), 2**j] with that width as its rate. A shingle of weight w takes the points
of its levels at heights up to w; each point has a time and a register, and a register keeps its least time. Two
signatures agree in a register with a probability of exactly the weighted Jaccard similarity. Only points up to a time
by which all registers are filled are ever drawn.

Defined results: texts without words (null, empty, blank) are near nothing, but equal texts always form one class;
texts of fewer than five words are a single shingle; rows that repeat, or have a null doc_id, take part; class_id is
the least doc_id of the class (null if it has none); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import SIMILARITY, drop, mix, read, shingle_hashes, small_batches, text_key, text_of, word_hashes, written
from panelforge.llm.components import components

#: 28 bands of 5 registers miss a pair of similarity 0.8 with odds of 1.5e-5.
BANDS, ROWS = 28, 5
REGISTERS = BANDS * ROWS
#: Pairs of a bucket whose ends are not yet in one class are verified if so many registers agree: at a similarity of
#: 0.8 the expected count is 112 with a deviation of 4.7; 91 lies more than four deviations below (odds of 2e-5).
LEAST_AGREE = 91

#: A task keeps the bags of texts that it has seen until they hold so many shingles (16 bytes each).
HELD_WORDS = 4_000_000
#: Members of a bucket are met across classes in so many at a time; a larger bucket is dealt over several tasks.
SALT_ROWS = 1000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ONE = 1.0 / (1 << 53)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a whole text in order, and their counts."""
    return np.unique(shingle_hashes(word_hashes(text)), return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of the counts; 0 if either bag is empty."""
    (x, m), (y, n) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    hit = y[at] == x
    both = int(np.minimum(m[hit], n[at[hit]]).sum())
    return both / (int(m.sum()) + int(n.sum()) - both)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * _ONE


def _draw(out: np.ndarray, doc: np.ndarray, item: np.ndarray, weight: np.ndarray, until: np.ndarray) -> None:
    """Lower the registers of each document by all points of its items up to its time limit."""
    size = out.shape[1]
    flat = out.reshape(-1)
    level = 0
    while len(item):
        low = 0 if level == 0 else 1 << (level - 1)
        width = 1 if level == 0 else low
        state = mix(item + np.uint64((level + 1) * int(_GOLD) % 2**64))
        at, top, docs = np.zeros(len(item)), weight, doc
        while len(state):
            state = mix(state + _GOLD)
            at = at - np.log(_uniform(state)) / width
            keep = at <= until[docs]
            state, at, top, docs = state[keep], at[keep], top[keep], docs[keep]
            register = (mix(state ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(size)).astype(np.int64)
            if level:
                height = low + _uniform(mix(state ^ np.uint64(0x14057B7EF767814F))) * width
                inside = height <= top
                np.minimum.at(flat, docs[inside] * size + register[inside], at[inside])
            else:
                np.minimum.at(flat, docs * size + register, at)
        level += 1
        more = weight > (1 << (level - 1))
        doc, item, weight = doc[more], item[more], weight[more]


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """One row of register times per bag, which must not be empty."""
    out = np.full((len(bags), registers), np.inf)
    total = np.array([float(c.sum()) for _, c in bags])
    until = registers * (np.log(registers) + 6) / total if len(bags) else total
    todo = np.arange(len(bags))
    while len(todo):
        doc = np.repeat(todo, [len(bags[i][0]) for i in todo])
        out[todo] = np.inf
        _draw(out, doc, np.concatenate([bags[i][0] for i in todo]), np.concatenate([bags[i][1] for i in todo]), until)
        todo = np.flatnonzero(np.isinf(out).any(axis=1))
        until[todo] *= 2
    return out


def _band_keys(sig: np.ndarray) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        key = mix(key * _GOLD + bits[:, :, r])
    return key


SKETCH = "tk bigint, size bigint, bands array<bigint>, registers binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("tk", pa.int64()), ("size", pa.int64()), ("bands", pa.list_(pa.int64())), ("registers", pa.binary())])
    for batch in batches:
        keys, bags = [], []
        for tk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            b = bag(text)
            if len(b[0]):
                keys.append(tk)
                bags.append(b)
        if not bags:
            continue
        sig = signatures(bags)
        bands = _band_keys(sig).view(np.int64)
        short = (mix(sig.view(np.uint64)) & np.uint64(0xFFFF)).astype("<u2")
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([int(c.sum()) for _, c in bags], pa.int64()),
             pa.ListArray.from_arrays(pa.array(np.arange(0, len(bags) * BANDS + 1, BANDS), pa.int32()), pa.array(bands.reshape(-1))),
             pa.array([x.tobytes() for x in short], pa.binary())], schema=kinds)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text_a, text_b) to those whose exact weighted Jaccard similarity is high enough."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    room = HELD_WORDS

    def bag_of(tk: int, text: str) -> tuple[np.ndarray, np.ndarray]:
        nonlocal room
        if tk not in held:
            found = bag(text)
            room -= len(found[0])
            if room < 0:
                held.clear()
                room = HELD_WORDS - len(found[0])
            held[tk] = found
        return held[tk]

    for batch in batches:
        a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
        found = []
        for i in range(len(a)):
            j = weighted_jaccard(bag_of(a[i], ta[i]), bag_of(b[i], tb[i]))
            if j >= SIMILARITY:
                found.append((a[i], b[i], j))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.float64())], names=["a", "b", "similarity"])


def _verified(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """Verified links of pairs(a, b); AQE splits the side of a text that occurs in many pairs."""
    rows = pairs.join(texts.select(F.col("tk").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("tk").alias("a"), F.col("text").alias("text_a")), "a")
    links = rows.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a bigint, b bigint, similarity double")
    return written(links, f"{name}-links")


def _rooted(buckets: DataFrame, links: DataFrame, scratch: list[str]) -> DataFrame:
    """(tk, key, root) of the members of buckets that are still in several classes."""
    roots = components(links.select("a", "b"), "bagminhash-roots", scratch)
    at = buckets.drop("root").join(roots.withColumnRenamed("node", "tk"), "tk", "left").withColumn("root", F.coalesce("root", "tk"))
    return _several(at)


def _several(at: DataFrame) -> DataFrame:
    several = at.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return at.join(several, "key")


def _shingle_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tk, text) to one row (shingle, lo, hi, n) per distinct shingle of a batch: its least and greatest text, its count."""
    for batch in batches:
        bags = [bag(x) for x in batch.column(1).to_pylist()]
        if not bags:
            continue
        items, counts = np.concatenate([x for x, _ in bags]), np.concatenate([n for _, n in bags])
        owner = np.repeat(np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64), [len(x) for x, _ in bags])
        if not len(items):
            continue
        order = np.lexsort((owner, items))
        items, counts, owner = items[order], counts[order], owner[order]
        first = np.flatnonzero(np.append(True, items[1:] != items[:-1]))
        last = np.append(first[1:], len(items)) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(items[first].view(np.int64)), pa.array(owner[first]), pa.array(owner[last]), pa.array(np.add.reduceat(counts, first).astype(np.int64))],
            names=["shingle", "lo", "hi", "n"])


def _within_reach(at: DataFrame, sketch: DataFrame, texts: DataFrame, scratch: list[str]) -> DataFrame:
    """Rows (tk, key, root, size, reach) of at without those that can't have a link to another text of their bucket.

    reach is what a text shares at most with any other: its size without the shingles that no other text of at holds.
    With a text of size m it has a similarity of at most reach / (size + m - reach), and m is at least reach and at
    least the least size in the bucket. The bound is exact, and takes one grouping of the shingles instead of pairs.
    """
    nodes = at.select("tk").distinct()
    owners = texts.join(nodes.hint("merge"), "tk", "left_semi").select("tk", "text").mapInArrow(_shingle_owners, "shingle bigint, lo bigint, hi bigint, n bigint")
    single = owners.groupBy("shingle").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).where("lo = hi")
    alone = single.groupBy(F.col("lo").alias("tk")).agg(F.sum("n").alias("alone"))
    sizes = sketch.select("tk", "size").join(nodes, "tk").join(alone, "tk", "left")
    sizes = written(sizes.select("tk", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("reach")), "bagminhash-reach", scratch)
    rows = at.join(sizes, "tk")
    least = rows.groupBy("key").agg(F.min("size").alias("least"))
    near = F.col("reach") >= SIMILARITY * (F.col("size") + F.greatest("least", "reach") - F.col("reach"))
    return _several(rows.join(least, "key").where(near).drop("least"))


def _star(at: DataFrame, order: Column) -> DataFrame:
    """Each member of a bucket with that one of its members that is first in an order."""
    heads = at.groupBy("key").agg(F.min_by(F.struct("tk", "root"), order).alias("h"))
    return at.join(heads, "key").where("root <> h.root").select(F.col("tk").alias("x"), F.col("h.tk").alias("y"))


def _any_first() -> Column:
    """Another member in every bucket."""
    return F.xxhash64("key", "tk")


def _plainest_first() -> Column:
    """The text with the fewest shingles of its own, which is most like what its group has in common."""
    return F.struct(F.col("size") - F.col("reach"), F.xxhash64("tk"))


def _across(at: DataFrame, sketch: DataFrame) -> DataFrame:
    """All pairs (a, b) of a bucket across classes that agree in enough registers and may reach the similarity. Of each
    bucket, the class of most members is only met by the others, never by itself; those others are dealt over as many
    salts as the bucket's size asks for, each of which meets the whole bucket. A pair is made in its first common band:
    a text that is not in that bucket any more has no link there."""
    most = at.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.sum("n").alias("n"))
    most = most.select("key", "most", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))
    rows = at.join(sketch.select("tk", "bands", "registers"), "tk").join(most, "key")
    x = rows.where("root <> most").withColumn("salt", F.pmod(F.xxhash64("tk"), F.col("salts")).cast("int")).alias("x")
    y = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("y")
    once = F.expr("y.root = x.most or x.tk < y.tk") & (F.expr("array_position(transform(x.bands, (k, i) -> k = y.bands[i]), true)") == F.expr("array_position(x.bands, x.key)"))
    agree = F.expr(f"size(filter(sequence(0, {REGISTERS - 1}), i -> substring(x.registers, 2 * i + 1, 2) = substring(y.registers, 2 * i + 1, 2)))")
    both = F.least("x.reach", "y.reach", "x.size", "y.size")
    close = (F.col("x.root") != F.col("y.root")) & (both >= SIMILARITY * (F.col("x.size") + F.col("y.size") - both))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.salt") == F.col("y.salt")) & close & (agree >= LEAST_AGREE) & once)
    return pairs.select(F.least("x.tk", "y.tk").alias("a"), F.greatest("x.tk", "y.tk").alias("b"))


def near_duplicate_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, tk, root, class_id per row of docs; links: a, b, similarity between the keys of different texts).

    root is the class itself, a text key. class_id is its least doc_id: null where all ids are, and the same for two
    classes where one id has different texts, so it names a class in results but doesn't tell classes apart.

    Equal texts are one node, so groups of copies never meet as pairs. Texts that can't resemble any other of their
    buckets, by an exact bound, are settled first. The others are verified against two members of each of their buckets.
    What the buckets then still hold in different classes is verified in all pairs across classes that agree in enough
    registers and may reach the similarity, so no link that could join two classes is left out.
    """
    spark, scratch = docs.sparkSession, []
    small_batches(spark)
    texts = docs.select(F.col("doc_id"), text_key().alias("tk"), text_of().alias("text"))
    nodes = texts.groupBy("tk").agg(F.min("doc_id").alias("doc_id"))
    sketch = written(texts.select("tk", "text").mapInArrow(_sketch, SKETCH).dropDuplicates(["tk"]), "bagminhash-sketch", scratch)
    bands = sketch.select("tk", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = written(bands.join(shared, "key"), "bagminhash-buckets", scratch)
    # one way of joining at every size: the texts that share a bucket are moved once, then read from this table
    plain = texts.select("tk", "text").join(buckets.select("tk").distinct().hint("merge"), "tk", "left_semi").dropDuplicates(["tk"])
    plain = written(plain, "bagminhash-texts", scratch)
    near = written(_within_reach(buckets.withColumn("root", F.col("tk")), sketch, plain, scratch), "bagminhash-near", scratch)
    pairs = _star(near, _any_first()).unionByName(_star(near, _plainest_first()))
    done = written(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "bagminhash-pairs", scratch)
    links = _verified(done, plain, "bagminhash")

    across = _across(written(_rooted(near, links, scratch), "bagminhash-open", scratch), sketch)
    across = written(across.join(done, ["a", "b"], "left_anti"), "bagminhash-across", scratch)
    links = links.unionByName(_verified(across, plain, "bagminhash-across"))
    roots = components(links.select("a", "b"), "bagminhash-roots", scratch)
    classed = nodes.join(roots.withColumnRenamed("node", "tk"), "tk", "left").withColumn("root", F.coalesce("root", "tk"))
    classed = written(classed, "bagminhash-classed")
    drop(spark, scratch)
    least = classed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    classes = classed.join(least, "root").select("tk", "root", "class_id")
    return texts.select("doc_id", "tk").join(classes, "tk").select("doc_id", "tk", "root", "class_id"), links


def keepers(members: DataFrame) -> DataFrame:
    """The (tk, doc_id) of one row per class: its least doc_id, then the least text key."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk"))
    return members.groupBy("root").agg(first.alias("k")).select("k.tk", "k.doc_id")


def op2_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = near_duplicate_classes(read(spark, sf_dir, "documents"))
    return members.select("doc_id", "class_id")


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, text, list_filter(string_split_regex(lower(text), '[\x00-\x20]+'), lambda x: x <> '') AS w FROM documents),
r AS (SELECT text, min(doc_id) AS id, any_value(w) AS w FROM w GROUP BY text),
s AS (SELECT id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM r WHERE len(w) > 0),
c AS (SELECT id, s, count(*) AS n FROM s GROUP BY id, s),
t AS (SELECT id, sum(n) AS n FROM c GROUP BY id),
o AS (SELECT x.id AS a, y.id AS b, sum(least(x.n, y.n)) AS n FROM c x JOIN c y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN t p ON p.id = a JOIN t q ON q.id = b WHERE o.n >= 0.8 * (p.n + q.n - o.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
k AS (SELECT id AS node, id AS root FROM r UNION SELECT e.b, k.root FROM k JOIN e ON e.a = k.node)
SELECT w.doc_id, m.class_id FROM w JOIN r ON r.text = w.text JOIN (SELECT node, min(root) AS class_id FROM k GROUP BY node) m ON m.node = r.id
"""
