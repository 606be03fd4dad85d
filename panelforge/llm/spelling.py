"""Spelling variant grouping by a dictionary of pairs of trie nodes.

The words are put into two tries, one forward and one of the reversed words, and the nodes of each are numbered. A word
that is broken at a place is a pair of numbers: the node of what stands before and the node of what stands after. With
one code point skipped between the two, words that differ by one replaced code point have the same pair; a word's pair
with nothing skipped is that of a longer word with one code point skipped, which is one inserted or deleted code point.
Joining equal pairs therefore finds exactly the words at one edit. A pair is shared by at most one word for each letter
there is, and one more, so no group grows with the table; nor are its pairs of words spelled out: each of its words
takes the number of the others and the best of them.

The tries are numbered from the sorted words, range by range: a word adds as many nodes as it is longer than its common
prefix with the word before. One word a range goes to the driver, which says where the next range goes on.

Defined results: a null text has no words, a null doc_id is written as no digits; rows that repeat count one by one; an
empty table gives an empty result; other columns are ignored; texts and words of any length are read whole. Among near
words of equal count the smallest in code-point order is the form.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import drop, ranked, read, small_batches, text_of, written
from panelforge.llm.runs import CHUNK, LOWER, Runs, chunks, joined

LONG, OFTEN, EVERY, RATIO = 5, 3, 97, 2
#: Words of more bytes are hashed one by one.
SHORT = 64
_LETTER = np.zeros(256, bool)
_LETTER[list(range(97, 123)) + [0xC3]] = True


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, np.uint32(0xEDB88320) ^ (x >> 1), x >> 1)
    return x


_CRC = _crc_table()


def crc_after(state: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """CRC-32 of what each state has seen, followed by the bytes data[at[i]:at[i + 1]]; all words a byte at a time."""
    length = np.diff(at)
    out = state.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-np.minimum(length, SHORT + 1).astype(np.int16), kind="stable")
    order = order[length[order] <= SHORT]
    at_most = np.sort(length[order])
    for k in range(int(at_most[-1]) if len(at_most) else 0):
        live = order[: len(order) - np.searchsorted(at_most, k, side="right")]
        out[live] = _CRC[(out[live] ^ data[at[live] + k]) & 0xFF] ^ (out[live] >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > SHORT):
        out[i] = zlib.crc32(data[at[i] : at[i + 1]].tobytes(), int(state[i]))
    return out


def _counts(ids: pa.ChunkedArray, text: pa.ChunkedArray, every: int, least: int) -> tuple[pa.Array, np.ndarray]:
    """(words, counts) of some texts, with one code point deleted where the hash of id and run says so."""
    b, ends = joined(text)
    b = LOWER[b] if len(b) else b
    two = b == 0xC3
    marked = _LETTER[b] if len(b) else np.empty(0, bool)
    marked[1:] |= two[:-1]  # 0xC3 and the byte after it are one letter
    runs = Runs.of(b, ends, marked)
    points = runs.length - np.add.reduceat((runs.data == 0xC3).astype(np.int64), runs.at[:-1]) if len(runs.start) else np.empty(0, np.int64)
    seen = np.array([zlib.crc32(f"{i}:".encode()) for i in ids.to_pylist()], dtype=np.uint32)
    h = crc_after(seen[runs.text], runs.data, runs.at) if len(runs.start) else np.empty(0, np.uint32)
    hit = (h % every == 0) if every else np.zeros(len(h), bool)
    made: Counter[str] = Counter()
    for i in np.flatnonzero(hit & (points > least)):
        run = runs.data[runs.at[i] : runs.at[i + 1]].tobytes().decode()
        k = int(h[i]) % len(run)
        made[run[:k] + run[k + 1 :]] += 1
    words = pc.dictionary_encode(runs.strings(~hit & (points >= least)))
    count = np.bincount(words.indices.to_numpy(zero_copy_only=False), minlength=len(words.dictionary))
    return pa.concat_arrays([words.dictionary.cast(pa.string()), pa.array(list(made), pa.string())]), np.r_[count, np.array(list(made.values()), np.int64)]


def vocabulary(docs: DataFrame, every: int = EVERY, long: int = LONG, often: int = OFTEN) -> DataFrame:
    """word, n: lower-cased runs of letters (A-Z, a-z and U+00C0 to U+00FF) of `long` code points and `often` occurrences.
    Where `every` (0: never) divides the CRC-32 of `<doc_id>:<run>`, the run loses one code point first."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, CHUNK):
            words, n = _counts(table["id"], table["text"], every, long)
            yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], names=["word", "n"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text_of().alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        m = (low + high) // 2
        low, high = (m, high) if a[:m] == b[:m] else (low, m)
    return low


def trie_nodes(words: DataFrame, column: str, name: str, scratch: list[str]) -> DataFrame:
    """words with `nodes`: the numbers of the trie's nodes on the way of the word in `column`, its root (0) first. Each
    prefix of the words has one number, counted on from 1 in their order. The words are unique."""
    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = words.repartitionByRange(parts, column).sortWithinPartitions(column).withColumn("part", F.spark_partition_id())
    schema = pa.schema([("nodes", pa.list_(pa.int64())), ("new", pa.int64())])
    names = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, path, top = "", [0], 0
        for batch in batches:
            nodes, new = [], []
            for word in batch.column(column).to_pylist():
                keep = common_prefix(before, word)
                more = len(word) - keep
                path = path[: keep + 1] + list(range(top + 1, top + more + 1))
                top, before = top + more, word
                nodes.append(path)
                new.append(top)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, schema.field("nodes").type), pa.array(new, pa.int64())], names=[*names, "nodes", "new"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    held = written(rows.mapInArrow(number, f"{kinds}, nodes array<long>, new long"), name, scratch)
    # where a range goes on: its first word shares nodes with the last word of the range before
    ends = held.groupBy("part").agg(F.min(column).alias("first"), F.max(F.struct(F.col(column).alias("word"), "nodes", "new")).alias("last")).orderBy("part").collect()
    goes, total, word, path = [], 0, "", [0]
    for r in ends:
        shared = common_prefix(word, r["first"])
        carry = path[1 : shared + 1]
        goes.append((r["part"], carry, total - shared))
        path = [0] + [carry[x - 1] if x <= shared else total - shared + x for x in r["last"]["nodes"][1:]]
        word, total = r["last"]["word"], total - shared + r["last"]["new"]
    goes = spark.createDataFrame(goes, "part int, carry array<long>, base long")
    # local numbers up to size(carry) are those of the shared prefix
    at = lambda x: F.when(x == 0, F.lit(0).cast("long")).when(x <= F.size("carry"), F.get("carry", (x - 1).cast("int"))).otherwise(F.col("base") + x)
    return held.join(F.broadcast(goes), "part").withColumn("nodes", F.transform("nodes", at)).drop("part", "carry", "base", "new")


def near_words(words: DataFrame, scratch: list[str]) -> DataFrame:
    """id, n_near, best of each word that has a near word: their number, and the least id among them. words has word and
    id, which is its place in the order of preference."""
    fore = trie_nodes(words.select("word", "id"), "word", "spelling-forward", scratch)
    back = trie_nodes(words.select(F.reverse("word").alias("drow"), "id"), "drow", "spelling-backward", scratch)
    both = fore.select("id", "word", F.col("nodes").alias("p")).join(back.select("id", F.col("nodes").alias("s")), "id")
    size = F.size("p") - 1
    pair = lambda i, skip, **more: F.struct(F.get("p", i).alias("p"), F.get("s", size - i - skip).alias("s"), *[v.alias(k) for k, v in more.items()])
    letters = F.split("word", "")
    # of equal letters in a row, skipping the last one stands for all: the shorter word is the same
    last = lambda i: (i == size - 1) | (F.get("c", i) != F.get("c", i + 1))
    skipped = F.transform(F.sequence(F.lit(0), size - 1), lambda i: pair(i, 1, kind=F.when(last(i), 1).otherwise(2)))
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: pair(i, 0, kind=F.lit(0)))
    rows = both.withColumn("c", letters).select("id", F.inline(F.concat(skipped, whole)))
    group = Window.partitionBy("p", "s")
    of = lambda test, agg: agg(F.when(test, F.col("id"))).over(group)
    skip, end, kind = F.col("kind") > 0, F.col("kind") == 1, F.col("kind")
    rows = rows.withColumns({"skips": of(skip, F.count), "ends": of(end, F.count), "best": of(skip, F.min), "best_end": of(end, F.min), "base": of(kind == 0, F.min)})
    rows = rows.where((F.col("skips") > 1) | (F.col("base").isNotNull() & (F.col("ends") > 0)))
    rows = rows.withColumn("second", of(skip & (F.col("id") > F.col("best")), F.min))
    other = F.when(F.col("id") == F.col("best"), F.col("second")).otherwise(F.col("best"))
    n_near = F.when(skip, F.col("skips") - 1 + F.when(end & F.col("base").isNotNull(), 1).otherwise(0)).otherwise(F.col("ends"))
    best = F.when(end, F.least(other, "base")).when(skip, other).otherwise(F.col("best_end"))
    return rows.select("id", n_near.alias("n_near"), best.alias("best")).groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")).where("n_near > 0")


def roots(links: DataFrame, scratch: list[str]) -> DataFrame:
    """links (id, form) to (id, root), the end of the way from id: each round doubles how far a word sees, and a form has
    at least twice the count, so there are at most six rounds."""
    far = links.select("id", F.col("form").alias("root"))
    while True:
        step = far.join(far.select(F.col("id").alias("root"), F.col("root").alias("on")), "root", "left")
        new: list[str] = []
        far = written(step.select("id", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "spelling-roots", new)
        scratch += new
        if not far.where("moved").limit(1).count():
            return far.select("id", "root")
        far = far.select("id", "root")


def spelling_forms(words: DataFrame, ratio: int = RATIO, scratch: list[str] | None = None) -> DataFrame:
    """word, n to word, n, form, root, n_near, form_n. Words are unique and not null."""
    mine: list[str] = []
    held = ranked(words.select("word", "n"), F.col("n").desc(), F.col("word"), name="spelling-words", rank="id", scratch=mine)
    near = written(near_words(held, mine), "spelling-near", mine)
    name = held.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    near = held.join(near, "id", "left").join(name, "best", "left")
    is_form = F.col("form_n") >= ratio * F.col("n")
    near = written(near.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(is_form, F.col(c)).alias(c) for c in ("best", "form", "form_n")]), "spelling-forms", mine)
    ends = roots(near.where("best is not null").select("id", F.col("best").alias("form")), mine)
    ends = ends.join(held.select(F.col("id").alias("root"), F.col("word").alias("end")), "root").select("id", "end")
    out = near.join(ends, "id", "left").select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")
    if scratch is not None:
        scratch += mine
        return out
    kept = written(out, "spelling")
    drop(words.sparkSession, mine)
    return kept


def op13_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine: list[str] = []
    words = written(vocabulary(read(spark, sf_dir, "documents")), "spelling-vocabulary", mine)
    out = spelling_forms(words)
    drop(spark, mine)
    return out


#: CRC-32 a byte at a time over a table that SQL builds; near words by the texts that are left when one place is taken out.
OP13_SQL = r"""
WITH RECURSIVE bits(i, k, x) AS (
  SELECT range, 0, range::UBIGINT FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN x & 1 = 1 THEN xor(3988292384::UBIGINT, x >> 1) ELSE x >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(x ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents WHERE text IS NOT NULL),
counted AS (SELECT id, run, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY id, run),
-- the state after each byte, a byte a step
steps(id, run, c, k, s) AS (
  SELECT id, run, c, 0, 4294967295::UBIGINT FROM counted
  UNION ALL
  SELECT id, run, c, k + 1, xor(crc.t[(xor(s, b) & 255)::BIGINT + 1], s >> 8)
  FROM (SELECT *, CASE WHEN k < octet_length(encode(id || ':' || run)) THEN ('0x' || hex(encode(id || ':' || run))[2 * k + 1 : 2 * k + 2])::UBIGINT END AS b FROM steps) q, crc
  WHERE b IS NOT NULL),
hashed AS (SELECT id, run, any_value(c) AS c, xor(arg_max(s, k), 4294967295::UBIGINT) AS h FROM steps GROUP BY id, run),
made AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM hashed),
v AS (SELECT word, sum(c)::BIGINT AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM v, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_max(struct_pack(w := other, n := n), struct_pack(n := n, o := -r)) AS b FROM (SELECT near.*, row_number() OVER (ORDER BY other) AS r FROM near) GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 2 * v.n THEN b.w END AS form, CASE WHEN b.n >= 2 * v.n THEN b.n END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
way(word, far) AS (SELECT word, word FROM forms UNION ALL SELECT way.word, forms.form FROM way JOIN forms ON forms.word = way.far WHERE forms.form IS NOT NULL),
ends AS (SELECT way.word, way.far AS root FROM way JOIN forms ON forms.word = way.far WHERE forms.form IS NULL)
SELECT forms.word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms JOIN ends ON ends.word = forms.word
"""
