"""Benchmark items inside documents, by size-partitioned MinHash containment search; DataFrame functions alone.

The distinct five-word shingles of an item are hashed, and the least hashes are its MinHash sample. Items are parted
by size (powers of two of their shingle count); a part fixes how many hashes are sampled and how many a document must
hold to become a candidate, so that an item contained to 0.8 is missed with odds below one in ten thousand. The search
joins the distinct shingle hashes of every whole document with the samples, counts hits per (document, item), and
verifies candidates exactly: shared distinct shingles over the item's distinct shingles is at least 0.8.

Words are runs of letters and digits in lower case. Defined results: items of fewer than five words have no shingle
and are never found; null texts, null items and documents without five words match nothing; an item id that repeats
with other words is found by either; rows that repeat a document id are searched one by one, and the best of them
counts; documents with a null id are searched and reported as null; empty tables give empty results; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import SHINGLE, SIMILARITY, let, read, text_of

#: Samples, and the shingles of the items, are broadcast up to so many bytes; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
SAMPLE = 16


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(w: Column, make) -> Column:
    """make(word, word, ...) for each run of words; an empty array where there are too few."""
    none = F.array().cast("array<int>")

    def body(x: Column) -> Column:
        n = F.size(x) - SHINGLE + 1
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)
        return F.transform(at, lambda i: make(*(F.get(x, i + k) for k in range(SHINGLE))))

    return let(w, body)


def shingle_keys(w: Column) -> Column:
    return F.array_distinct(_runs(w, F.xxhash64))


def shingles(w: Column) -> Column:
    return F.array_distinct(_runs(w, lambda *x: F.concat_ws(" ", *x)))


def sampled(size: Column) -> Column:
    """Hashes that an item of this many shingles is sampled by: all of a small one."""
    return F.least(size, F.lit(SAMPLE))


def size_part(size: Column) -> Column:
    """The part of an item by its number of shingles: 0 for 1, 1 for 2 and 3, 2 for 4 to 7 and so on."""
    return F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int")


def needed(part: Column, sample: Column) -> Column:
    """Hits that make a candidate, by size part. A contained item's hits are hypergeometric with a mean of 0.8 of the
    sample; smaller parts have less spread and need a larger share."""
    return F.ceil(sample * F.when(part <= 3, 0.5).when(part == 4, 0.4).otherwise(0.3)).cast("int")


def find_contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, shared, of, containment) of every item contained to at least 0.8."""
    bench = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), words(text_of()).alias("w"))
    bench = bench.select("item", shingles(F.col("w")).alias("shingles"), F.array_sort(shingle_keys(F.col("w"))).alias("keys")).where(F.size("keys") > 0)
    # rows that repeat an item id with other words stay items of their own
    bench = bench.distinct().withColumns({"variant": F.xxhash64("keys"), "part": size_part(F.size("keys"))})
    size = sampled(F.size("keys"))
    # xxhash64 orders shingles at random, so the first keys in order are a MinHash sample
    sample = bench.select("item", "variant", needed(F.col("part"), size).alias("need"), F.explode(F.slice("keys", F.lit(1), size)).alias("key"))
    rows, bytes_ = items.agg(F.count("*"), F.sum(F.octet_length(text_of()))).first()
    # a sampled key is a row of 32 bytes; each word is in five shingles
    small = F.broadcast if 32 * SAMPLE * rows <= BROADCAST_BYTES else lambda d: d
    light = F.broadcast if 64 * rows + 6 * (bytes_ or 0) <= BROADCAST_BYTES else lambda d: d
    texts = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(doc_id, text_of()).alias("k"), text_of().alias("text"))
    keys = texts.select("k", F.explode(shingle_keys(words(F.col("text")))).alias("key"))
    # the keys of a document are distinct, so a row is a hit of its own
    hits = keys.join(small(sample), "key").groupBy("k", "item", "variant").agg(F.count("*").alias("hits"), F.max("need").alias("need"))
    candidates = hits.where("hits >= need").select("k", "item", "variant")
    rows = texts.join(candidates, "k").join(light(bench.select("item", "variant", "shingles")), ["item", "variant"])
    shared = F.size(F.array_intersect(F.col("shingles"), shingles(words(F.col("text")))))
    rows = rows.select("doc", "item", shared.alias("shared"), F.size("shingles").alias("of")).where(F.col("shared") >= SIMILARITY * F.col("of"))
    best = rows.groupBy("doc", "item").agg(F.max(F.struct((F.col("shared") / F.col("of")).alias("containment"), "shared", "of")).alias("m"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.col("m.shared").cast("long").alias("shared"), F.col("m.of").cast("long").alias("of"), F.col("m.containment").alias("containment"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("shared").alias("shared_shingles"), F.col("of").alias("item_shingles"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM d),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM b),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
o AS (SELECT doc_id, item_id, count(*) AS k FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, CAST(k AS BIGINT) AS shared_shingles, CAST(n AS BIGINT) AS item_shingles FROM o JOIN n USING (item_id) WHERE k >= 0.8 * n
"""
