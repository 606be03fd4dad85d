"""Phrase collocation mining by dynamic itemset counting.

Texts are dealt into SHARDS shards that are scanned in a cycle. Words are counted from the first step. At each shard
boundary, words and word pairs whose count has reached the threshold are noted with the step; a pair is counted from the
step by which both of its words have reached it, a triple from the step by which both of its pairs have, and each phrase
for exactly one full cycle, so that its count is exact. Lengths are interleaved: one scan of a shard counts words, pairs
and triples of whatever is active.

What the tasks must know is when a word or a pair reached the threshold. That is a table of 2**BITS bytes, addressed by
a hash of the phrase, whatever the corpus. Phrases that share a place share the earlier step: some are counted that need
not be, none is counted in part, since a place keeps its first step. Counts are keyed by the phrase itself.

Most pairs of frequent words are rare, and would fill the table of counts. So the first cycle also adds up the pairs by
hash alone, in 2**BUCKET_BITS places, and a pair waits until its place has reached the threshold, too: its own count
can't have before. All places are added up when the first cycle ends, so no pair that reaches the threshold is missed.

Defined results: a null text is empty, a null lang is `und`; documents without words add nothing; rows that repeat count
one by one; ties are broken as stated at `collocations`; an empty table gives an empty result; other columns are
ignored. A text of any length is worked on in blocks that share two words, so that no phrase is lost or counted twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import drop, mix, new_path, powers, read, small_batches, text_of, written
from panelforge.llm.runs import LOWER, Runs, chunks, joined

SHARDS, LEAST, SHARE, TOP, BITS, BUCKET_BITS = 3, 10, 50, 2000, 24, 25
#: Places of a row of added-up pairs.
ROW = 1 << 16
NEVER = 255
#: Bytes of text that a task works on at a time; its arrays take some twenty times as much.
CHUNK = 4 << 20
#: Words that are hashed at a time, and phrases of a batch: what is made of them is larger than what stays.
SLICE = 1 << 15
#: Bytes that end a piece, and bytes that end a word.
PIECE_ENDS, WORD_ENDS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(WORD_ENDS)] = 1
_KIND[list(PIECE_ENDS)] = 2
_GRAMS = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("slot", pa.int32()), ("start", pa.int32()), ("f", pa.int64()), ("places", pa.binary()), ("counts", pa.binary())])
#: Rows of phrases, and (words = PLACES, slot = row of places) of pairs by place.
GRAMS, SCANNED, PLACES = "lang string, words int, phrase string, slot int, start int, f long", ", places binary, counts binary", -1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def blocks(b: np.ndarray, ends: np.ndarray, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, ends, text of each block, words of it that the block before has counted): texts of more than `size` bytes
    are cut between words, and each further block begins with the last two words of the one before."""
    if not len(ends) > 1 or int(np.diff(ends).max()) <= size:
        n = len(ends) - 1
        return b, ends, np.arange(n), np.zeros(n, np.int64)
    parts, text, seen = [], [], []
    for i in range(len(ends) - 1):
        at, stop, lead = int(ends[i]), int(ends[i + 1]), 0
        cut = at
        while True:
            cut = min(cut + size, stop)  # so many new bytes, however long the two words before them are
            while cut < stop and not (gap := np.flatnonzero(_KIND[b[cut : cut + 4096]])).size:
                cut = min(cut + 4096, stop)
            cut += int(gap[0]) if cut < stop else 0
            parts.append(b[at:cut])
            text.append(i)
            seen.append(lead)
            if cut == stop:
                break
            part = parts[-1]
            first = np.flatnonzero((_KIND[part] == 0) & np.r_[True, _KIND[part[:-1]] != 0])[-2:]
            lead = len(first)
            at = at + int(first[0]) if lead else cut
    return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])], np.array(text), np.array(seen)


@dataclass(frozen=True)
class Scan:
    """One step: which it is, and when the words, the pairs, and all pairs of a place reached the threshold."""

    step: int
    shards: int
    word_step: np.ndarray
    pair_step: np.ndarray
    bucket_step: np.ndarray
    size: int = CHUNK

    def _live(self, start: np.ndarray) -> np.ndarray:
        return (start <= self.step) & (self.step < start + self.shards)

    def grams(self, lang: pa.ChunkedArray, text: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
        """Phrases that are active at this step, with their counts in these texts; a row of no words has all words of a
        language in its count."""
        whole, ends = joined(text)
        b, ends, of, lead = blocks(LOWER[whole], ends, self.size)
        kind = _KIND[b] if len(b) else np.empty(0, np.uint8)
        runs = Runs.of(b, ends, kind == 0)
        n = len(runs.start)
        if not n:
            return
        # words that follow one another in a piece, and words that the block before hasn't counted
        piece = np.searchsorted(np.flatnonzero(kind == 2), runs.start).astype(np.int32)
        follows = np.zeros(n, bool)
        follows[1:] = (runs.text[1:] == runs.text[:-1]) & (piece[1:] == piece[:-1])
        del b, kind, piece
        fresh = np.arange(n) - np.searchsorted(runs.text, np.arange(len(lead)))[runs.text] >= lead[runs.text]
        langs = pc.dictionary_encode(lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang)
        code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int32)[of][runs.text]
        salt = mix(np.array([hash_bytes(x) for x in langs.dictionary.to_pylist()], dtype=np.uint64))
        h = mix(_hashes(runs) ^ salt[code])
        at = lambda x, table: (x >> np.uint64(64 - int(np.log2(len(table))))).astype(np.int64)
        # a phrase is named by its last word
        reached = self.word_step[at(h, self.word_step)].astype(np.int16)
        pair_start = np.full(n, NEVER, np.int16)
        pair_hash = np.zeros(n, np.uint64)
        pair_hash[1:] = mix(h[:-1] * _ODD + h[1:])
        bucket = at(pair_hash, self.bucket_step)
        pair_start[1:] = np.where(follows[1:], np.maximum(np.maximum(reached[1:], reached[:-1]), self.bucket_step[bucket[1:]]), NEVER)
        reached = np.where(follows, self.pair_step[at(pair_hash, self.pair_step)].astype(np.int16), NEVER)
        triple_start = np.full(n, NEVER, np.int16)
        triple_start[2:] = np.where(follows[2:] & follows[1:-1], np.maximum(reached[2:], reached[1:-1]), NEVER)
        pair, triple = np.flatnonzero(self._live(pair_start) & fresh), np.flatnonzero(self._live(triple_start) & fresh)
        counts_words = self.step < self.shards
        if counts_words:
            yield self._places(bucket[follows & fresh])
        del bucket, reached
        need = np.full(n, counts_words)
        for back in (0, 1):
            need[pair - back] = True
        for back in (0, 1, 2):
            need[triple - back] = True
        words = pc.dictionary_encode(runs.strings(need))
        del runs
        m = max(len(words.dictionary), 1)
        # (language, word) as one number, exact
        name, word = np.unique(code[need] * np.int64(m) + words.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        of_word = np.full(n, -1, np.int32)
        of_word[need] = word
        spelled = words.dictionary.take(pa.array(name % m)).cast(pa.string())
        spoken = langs.dictionary.take(pa.array(name // m)).cast(pa.string())
        u = np.int64(max(len(name), 1))
        del need, words, name, word

        def rows(size: int, last: np.ndarray, key: np.ndarray, start: np.ndarray, hashes: np.ndarray | None, table: np.ndarray) -> Iterator[pa.RecordBatch]:
            _, first, count = np.unique(key, return_index=True, return_counts=True)
            found = last[first]
            del key, last, first
            for i in range(0, len(found), SLICE):
                last = found[i : i + SLICE]
                parts = [spelled.take(pa.array(of_word[last - back])) for back in range(size - 1, -1, -1)]
                phrase = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
                slot = at(hashes[last], table) if hashes is not None else np.zeros(len(last), np.int64)
                yield _rows(spoken.take(pa.array(of_word[last])), size, phrase, slot, start[last], count[i : i + SLICE])

        if counts_words:
            new = np.flatnonzero(fresh)
            total = np.bincount(code[new], minlength=len(langs.dictionary))
            yield _rows(langs.dictionary.cast(pa.string()), 0, pa.array([""] * len(total)), np.zeros(len(total)), np.zeros(len(total)), total)
            yield from rows(1, new, of_word[new], np.zeros(n, np.int16), h, self.word_step)
            del new
        del h, code, fresh, follows
        if len(pair):
            yield from rows(2, pair, of_word[pair - 1] * u + of_word[pair], pair_start, pair_hash, self.pair_step)
        if len(triple):
            _, head = np.unique(of_word[triple - 2] * u + of_word[triple - 1], return_inverse=True)
            yield from rows(3, triple, head * u + of_word[triple], triple_start, None, self.pair_step)

    def _places(self, bucket: np.ndarray) -> pa.RecordBatch:
        """How often each place of a pair was met, by rows of places."""
        place, count = np.unique(bucket, return_counts=True)
        row, first = np.unique(place // ROW, return_index=True)
        ends = np.r_[first[1:], len(place)]
        place, count = (place % ROW).astype(np.uint16), np.minimum(count, 255).astype(np.uint8)
        cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary())
        empty = pa.nulls(len(row), pa.string())
        return _rows(empty, PLACES, empty, row, np.zeros(len(row)), np.zeros(len(row)), cut(place), cut(count))


def _hashes(runs: Runs) -> np.ndarray:
    """A number of each word from its bytes."""
    out, table = np.empty(len(runs.start), np.uint64), powers(int(runs.length.max()) + 1)
    for i in range(0, len(out), SLICE):
        at = runs.at[i : i + SLICE + 1]
        first = at[:-1] - at[0]
        value = table[np.arange(at[-1] - at[0]) - np.repeat(first, runs.length[i : i + SLICE])]
        value *= runs.data[at[0] : at[-1]] + np.uint64(1)
        out[i : i + SLICE] = np.add.reduceat(value, first)
    return out


def _rows(lang: pa.Array, words: int, phrase: pa.Array, slot: np.ndarray, start: np.ndarray, f: np.ndarray, places: pa.Array | None = None, counts: pa.Array | None = None) -> pa.RecordBatch:
    n = len(lang)
    more = [places or pa.nulls(n, pa.binary()), counts or pa.nulls(n, pa.binary())]
    numbers = [pa.array(np.asarray(x).astype(t)) for x, t in ((slot, np.int32), (start, np.int32), (f, np.int64))]
    return pa.RecordBatch.from_arrays([lang, pa.array(np.full(n, words, np.int32)), phrase, *numbers, *more], schema=_GRAMS)


def hash_bytes(text: str) -> int:
    """64-bit number of a language's name."""
    out = 1469598103934665603
    for c in text.encode():
        out = (out ^ c) * 1099511628211 % (1 << 64)
    return out


def _noted(table: np.ndarray, rows: DataFrame, step: int) -> int:
    """Write `step` at the places of rows that have none; the driver gets at most one bit a place. How many were met."""
    place = F.col("slot") + 1
    maps = rows.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect()
    for r in maps:
        bits = np.unpackbits(np.frombuffer(bytes(r["m"]), np.uint8), bitorder="little")
        at = (r["b"] - 1) * 32768 + np.flatnonzero(bits)
        table[at[table[at] == NEVER]] = step
    return len(maps)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by place, in order of their rows, to one row of counts each (255 stands for all above)."""
    at, total = None, np.zeros(ROW, np.int64)
    row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.minimum(total, 255).astype(np.uint8).tobytes()])], names=["slot", "counts"])
    for batch in batches:
        for slot, places, counts in zip(*[batch.column(c) for c in ("slot", "places", "counts")], strict=True):
            if slot.as_py() != at:
                if at is not None:
                    yield row()
                at, total = slot.as_py(), np.zeros(ROW, np.int64)
            n = np.frombuffer(counts.as_buffer(), np.uint8)
            # a row of chunk's places has each once; one of sums has them all
            total[np.frombuffer(places.as_buffer(), np.uint16) if places.is_valid else slice(None)] += n
    if at is not None:
        yield row()


def _full(least: int):
    """Rows of counts to the places of each that have reached the threshold, a bit each."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.frombuffer(c.as_buffer(), np.uint8) >= min(least, 255)).tobytes() for c in batch.column("counts")]
            yield pa.RecordBatch.from_arrays([batch.column("slot"), pa.array(bits, pa.binary())], names=["slot", "bits"])

    return full


def frequent_phrases(docs: DataFrame, scratch: list[str], shards: int = SHARDS, least: int = LEAST, bits: int = BITS, size: int = CHUNK, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """lang, words (1 to 3), phrase, f of all phrases with f >= least; rows of 0 words have all words of a language in f.

    Exact for any number of shards and bits (at least 16 for buckets); tables in the shared folder, whose paths are added
    to scratch."""
    if not 1 <= shards <= 80:
        raise ValueError("from 1 to 80 shards")  # steps are bytes
    spark = docs.sparkSession
    small_batches(spark)

    def kept(df: DataFrame, name: str, by: str, held: list[str]) -> DataFrame:
        path = new_path(spark, name)
        held.append(path)
        df.write.partitionBy(by).parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    dealt = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"), (F.monotonically_increasing_id() % shards).cast("int").alias("shard"))
    texts = kept(dealt, "collocations-shards", "shard", scratch)
    word_step, pair_step, bucket_step = (np.full(1 << b, NEVER, np.uint8) for b in (bits, bits, bucket_bits))
    live, places, done, step, last = None, None, [], 0, shards - 1
    while step <= last:
        tables = spark.sparkContext.broadcast((word_step, pair_step, bucket_step))

        def scan(batches: Iterator[pa.RecordBatch], step: int = step, tables=tables) -> Iterator[pa.RecordBatch]:
            now = Scan(step, shards, *tables.value, size)
            for table in chunks(batches, size):
                yield from now.grams(table["lang"], table["text"])

        found = texts.where(F.col("shard") == step % shards).select("lang", "text").mapInArrow(scan, GRAMS + SCANNED)
        mine: list[str] = []
        if step < shards:  # a cycle of added-up pairs, beside the phrases
            found = kept(found.withColumn("kind", (F.col("words") == PLACES).cast("int")), f"collocations-scan{step}", "kind", mine)
            new = found.where("kind = 1").select("slot", "places", "counts")
            new = new if places is None else new.unionByName(places.select("slot", F.lit(None).cast("binary").alias("places"), "counts"))
            places = written(new.repartition("slot").sortWithinPartitions("slot").mapInArrow(_added, "slot int, counts binary"), f"collocations-places{step}", scratch)
            for r in places.mapInArrow(_full(least), "slot int, bits binary").collect():
                now = bucket_step[r["slot"] * ROW : (r["slot"] + 1) * ROW]
                reached = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8)).astype(bool) & (now == NEVER)
                now[reached] = step + 1
                last = max(last, step + shards) if reached.any() else last
            found = found.where("kind = 0")
        rows = found.select("lang", "words", "phrase", "slot", "start", "f", F.lit(None).cast("int").alias("reached"))
        rows = rows if live is None else rows.unionByName(live)
        rows = rows.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"), F.min("slot").alias("slot"), F.min("start").alias("start"), F.min("reached").alias("reached"))
        rows = rows.withColumn("reached", F.coalesce("reached", F.when(F.col("f") >= least, step + 1)))
        rows = rows.withColumn("over", (F.col("start") + shards <= step + 1).cast("int")).where("over = 0 or words = 0 or f >= %d" % least)
        state = kept(rows, f"collocations-step{step}", "over", scratch)
        tables.destroy()
        drop(spark, mine)
        new = state.where(F.col("reached") == step + 1)
        # what reached the threshold here starts longer phrases at the next step, and those take a cycle
        if _noted(word_step, new.where("words = 1"), step + 1) + _noted(pair_step, new.where("words = 2"), step + 1):
            last = max(last, step + shards)
        done.append(state.where("over = 1").select("lang", "words", "phrase", "f"))
        live = state.where("over = 0").select("lang", "words", "phrase", "slot", "start", "f", "reached")
        step += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def score(a: str = "a", left: str = "l", right: str = "r") -> Column:
    """floor(1000000 * a * a / (l * r)) in whole numbers of up to 38 digits."""
    wide = lambda c: f"cast({c} as decimal(20,0))"
    return F.expr(f"cast((cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))) div ({wide(left)} * cast({right} as decimal(18,0))) as bigint)")


def first_by(df: DataFrame, key: str, least: int, *order: Column, deal: Column, parts: tuple[int, ...] = (64, 8)) -> DataFrame:
    """The first rows of each key in an order, with `rank`: first of each of many parts of a key, then of fewer, so that no
    task sees more than parts * least rows of a key that has most of all rows."""
    for n in parts:
        w = Window.partitionBy(key, "__part").orderBy(*order)
        df = df.withColumn("__part", F.pmod(deal, F.lit(n))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= least).drop("rank", "__part")
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= least)


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, share: int = SHARE, shards: int = SHARDS, bits: int = BITS, bucket_bits: int = BUCKET_BITS, scratch: list[str] | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of two or three words, by score and a
    descending and the phrase ascending.

    The cut with the lowest score counts, of equal ones the first. A pair inside a triple that has at least `share`
    hundredths of its occurrences goes, whether or not the triple stays."""
    mine: list[str] = []
    f = written(frequent_phrases(docs, mine, shards, least, bits, bucket_bits=bucket_bits), "collocations-counts", mine)
    n = f.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    phrases = f.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    sub = lambda i, k: F.array_join(F.slice("w", i, k), " ")
    inside = phrases.where("words = 3").select("lang", "a", F.explode(F.array(sub(1, 2), sub(2, 2))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    cuts = phrases.select("lang", "words", "phrase", "a", F.posexplode(F.when(F.col("words") == 2, F.array(F.struct(sub(1, 1).alias("x"), sub(2, 1).alias("y")))).otherwise(
        F.array(F.struct(sub(1, 1).alias("x"), sub(2, 2).alias("y")), F.struct(sub(1, 2).alias("x"), sub(3, 1).alias("y")))))).select("lang", "words", "phrase", "a", F.col("pos").alias("k"), "col.x", "col.y")
    part = lambda c, to: f.where("words between 1 and 2").select("lang", F.col("phrase").alias(c), F.col("f").alias(to))
    scored = cuts.join(part("x", "l"), ["lang", "x"]).join(part("y", "r"), ["lang", "y"]).withColumn("score", score())
    best = scored.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "words", "phrase", "a", "b.score", "b.l", "b.r")
    kept = best.join(inside, ["lang", "phrase"], "left").where((F.col("words") == 3) | F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    first = first_by(kept, "lang", top, F.col("score").desc(), F.col("a").desc(), F.col("phrase"), deal=F.xxhash64("phrase"))
    out = first.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    if scratch is not None:
        scratch += mine
        return out
    kept = written(out, "collocations")
    drop(docs.sparkSession, mine)
    return kept


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT doc, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS nr FROM (
    SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
      string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p
    FROM documents)),
words AS (
  SELECT doc, nr, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc, nr, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces)),
runs AS (
  SELECT lang, w AS w1, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY doc, nr ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM runs GROUP BY lang),
f AS (
  SELECT lang, w1 AS phrase, 1 AS words, '' AS head, '' AS tail, '' AS x, '' AS y, count(*) AS f FROM runs GROUP BY lang, w1
  UNION ALL SELECT lang, w1 || ' ' || w2, 2, w1, w2, w1, w2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, w1 || ' ' || w2, w2 || ' ' || w3, w1, w3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3),
cand AS (SELECT * FROM f WHERE words > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, words, f AS a, 1 AS k, x AS p, CASE words WHEN 2 THEN y ELSE tail END AS q FROM cand
  UNION ALL SELECT lang, phrase, words, f, 2, head, y FROM cand WHERE words = 3),
scored AS (
  SELECT c.*, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.p JOIN f r ON r.lang = c.lang AND r.phrase = c.q),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, sub, max(f) AS longer FROM (SELECT lang, unnest([head, tail]) AS sub, f FROM cand WHERE words = 3) GROUP BY lang, sub),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.sub = b.phrase
  WHERE b.words = 3 OR i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept k JOIN n ON n.lang = k.lang QUALIFY rank <= 2000
"""
