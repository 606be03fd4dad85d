"""Fingerprints of whole texts from prefix polynomial hashes.

The prefix array of a text holds sum(code * B**i) of its code points under two prime moduli, so the hash of any span
costs two look-ups; equal spans are told at once, and the longest common extension of two positions by binary search.
A fingerprint holds the length, the hash of the whole text and the least hashes of all its spans of a fixed width (16,
4 or 1 by the length of the text; short texts hold those of the smaller widths too); the likeness of two fingerprints
estimates the share of spans that their texts have in common, at the smaller of their widths.

Defined results: a null text is empty; two empty texts are alike (1), an empty and another text are not (0); equal
texts have equal fingerprints; documents follow each other by descending doc_id, null ids last, ties by the key of the
text (rows that repeat follow each other, in one task); the last is followed by the first, a single document by itself; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import mix, read, small_batches, text_key, text_of

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 1_500_007)
KEPT = 48
_tables = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(k: int, n: int) -> np.ndarray:
    """B**0 .. B**n under modulus k; grown by doubling."""
    t, p = _tables[k], PRIMES[k]
    while len(t) <= n:
        t = np.concatenate([t, t * np.uint64(pow(BASES[k], len(t), p)) % np.uint64(p)])
    _tables[k] = t
    return t


class PrefixHash:
    """Prefix arrays of a text; base is another PrefixHash whose first `shared` code points are the same."""

    def __init__(self, text: str, base: PrefixHash | None = None, shared: int = 0) -> None:
        self.n = len(text)
        new = np.frombuffer(text[shared:].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        self.sums = []
        for k, p in enumerate(PRIMES):
            terms = new * _power(k, self.n)[shared : self.n] % np.uint64(p)
            s = np.empty(self.n + 1, dtype=np.uint64)
            s[0] = 0
            if base is not None:
                s[: shared + 1] = base.sums[k][: shared + 1]
            # kept as sums below the modulus: a total of n terms below 2**31 fits 64 bits for any text in memory
            s[shared + 1 :] = (np.cumsum(terms) + s[shared]) % np.uint64(p)
            self.sums.append(s)

    def spans(self, width: int, first: int = 0) -> np.ndarray:
        """62-bit hashes of all spans of a width that begin at `first` or later, whatever their place."""
        if self.n < width:
            return np.empty(0, dtype=np.uint64)
        out = np.zeros(self.n - width + 1 - first, dtype=np.uint64)
        for k, p in enumerate(PRIMES):
            s, q = self.sums[k], np.uint64(p)
            d = (s[first + width :] + q - s[first : self.n - width + 1]) % q
            out = (out << np.uint64(31)) | d * _inverse(k, self.n)[first : self.n - width + 1] % q
        return out

    def span(self, i: int, n: int) -> tuple[int, ...]:
        """Hash of the span of n code points at i, whatever its place."""
        return tuple((int(s[i + n]) - int(s[i])) * int(_inverse(k, self.n)[i]) % PRIMES[k] for k, s in enumerate(self.sums))

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common extension of position i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, mid) == other.span(j, mid):
                low = mid
            else:
                high = mid - 1
        return low


_inverses = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _inverse(k: int, n: int) -> np.ndarray:
    """Powers of the inverse of the base."""
    t, p = _inverses[k], PRIMES[k]
    while len(t) <= n:
        t = np.concatenate([t, t * np.uint64(pow(BASES[k], -len(t), p)) % np.uint64(p)])
    _inverses[k] = t
    return t


WIDTHS = (16, 4, 1)
#: Texts of fewer code points hold the hashes of the smaller widths too: an edit can take them across a step of width.
SHORT = 96


def width_for(n: int) -> int:
    return 16 if n >= 48 else 4 if n >= 12 else 1


def _sketch(spans: np.ndarray) -> np.ndarray:
    h = (mix(spans) >> np.uint64(32)).astype(np.uint32)
    if len(h) > 4 * KEPT:
        # equal spans repeat their value: take a few times as many as are kept, and all if those hold too few
        least = np.unique(np.partition(h, 4 * KEPT)[: 4 * KEPT])
        if len(least) >= KEPT:
            return least[:KEPT]
    return np.unique(h)[:KEPT]


class Fingerprint:
    """Length, hash of the whole text and least span hashes, for its own width first; str() and parse() are inverse."""

    def __init__(self, n: int, whole: int, sketches: list[np.ndarray]) -> None:
        self.n, self.whole, self.sketches = n, whole, sketches

    def __str__(self) -> str:
        return "-".join([f"{self.n:x}", f"{self.whole:016x}", *(s.astype(">u4").tobytes().hex() for s in self.sketches)])

    @staticmethod
    def parse(text: str) -> Fingerprint:
        n, whole, *sketches = text.split("-")
        return Fingerprint(int(n, 16), int(whole, 16), [np.frombuffer(bytes.fromhex(s), dtype=">u4").astype(np.uint32) for s in sketches])

    def at(self, width: int) -> np.ndarray:
        """The least hashes of the spans of a width; none if it isn't held."""
        i = WIDTHS.index(width) - WIDTHS.index(width_for(self.n))
        return self.sketches[i] if 0 <= i < len(self.sketches) else np.empty(0, dtype=np.uint32)

    def likeness(self, other: Fingerprint) -> float:
        if (self.n, self.whole) == (other.n, other.whole):
            return 1.0
        width = min(width_for(self.n), width_for(other.n))
        x, y = self.at(width), other.at(width)
        union = np.union1d(x, y)[:KEPT]
        if not len(union):
            return 0.0
        both = np.intersect1d(x, y, assume_unique=True)
        return len(np.intersect1d(union, both, assume_unique=True)) / len(union)


def _print_of(h: PrefixHash, spans: np.ndarray) -> Fingerprint:
    a, b = h.span(0, h.n)
    smaller = [w for w in WIDTHS if w < width_for(h.n)] if h.n < SHORT else []
    return Fingerprint(h.n, a << 31 | b, [_sketch(spans), *(_sketch(h.spans(w)) for w in smaller)])


class Held:
    """A text with its prefix arrays, span hashes and fingerprint."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.hash = PrefixHash(text)
        self.spans = self.hash.spans(width_for(len(text)))
        self.print = _print_of(self.hash, self.spans)

    def edited(self, following: str) -> tuple[str, Fingerprint, int]:
        """(edited text, its fingerprint, longest common extension with this text at 0)."""
        n = len(self.text)
        cut = n - n // 3
        text = self.text[:cut] + following[: n // 3]
        h, width = PrefixHash(text, self.hash, cut), width_for(len(text))
        if width == width_for(n) and cut >= width:
            first = cut - width + 1
            spans = np.concatenate([self.spans[:first], h.spans(width, first)])
        else:
            spans = h.spans(width)
        return text, _print_of(h, spans), self.hash.extension(0, h, 0)


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix bigint"
_KINDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix", pa.int64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, ahead, doc_id, text) in order; a row with ahead only says what follows the last row of its part."""
    part, held, doc = None, None, None
    for batch in batches:
        out = []
        for p, ahead, d, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if p != part:
                part, held = p, None
            elif held is None:
                continue  # more rows ahead than the one needed
            here = Held(text)
            if held is not None:
                edited, mark, common = held.edited(text)
                sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((doc, len(held.text), sha, str(held.print), str(mark), held.print.likeness(mark), held.print.likeness(here.print), common))
            held, doc = (None, None) if ahead else (here, d)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*out, strict=True), _KINDS, strict=True)], schema=_KINDS)


def _cuts(keys: DataFrame, parts: int) -> np.ndarray:
    """The last (o, tk) of each of `parts` ranges of keys in ascending order, as Spark's range partitioning draws them."""
    dealt = keys.repartitionByRange(parts, "o", "tk").groupBy(F.spark_partition_id().alias("p"))
    tops = dealt.agg(F.max(F.struct("o", "tk")).alias("top")).collect()
    return np.array(sorted((r["top"]["o"], r["top"]["tk"]) for r in tops), dtype=np.int64).reshape(-1, 2)


def _range(cuts: np.ndarray, o: np.ndarray, tk: np.ndarray) -> np.ndarray:
    """How many cuts lie before each (o, tk)."""
    at, end = np.searchsorted(cuts[:, 0], o, "left"), np.searchsorted(cuts[:, 0], o, "right")
    for v in np.unique(o[at < end]):
        i, j = np.searchsorted(cuts[:, 0], [v, v + 1] if v < 2**63 - 1 else [v, v], "left")
        j = j if v < 2**63 - 1 else len(cuts)
        own = o == v
        at[own] = i + np.searchsorted(cuts[i:j, 1], tk[own], "left")
    return at


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and the likenesses to it and to the next document.

    Documents are cut into ranges of (doc_id, key of the text), so that one id with many texts is many ranges. The first
    document of each range also goes to the range before it: every range is worked through alone, texts are moved once.
    """
    spark = docs.sparkSession
    small_batches(spark, 200)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = -(2**63)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(least)).alias("o"), (-1 - text_key()).alias("tk"), text_of().alias("text"))
    cuts = _cuts(rows.select("o", "tk"), parts or 4 * n)

    @F.pandas_udf("int")
    def range_of(o: pd.Series, tk: pd.Series) -> pd.Series:
        # the highest ids come first
        return pd.Series((len(cuts) - 1 - _range(cuts, o.to_numpy(), tk.to_numpy())).astype("int32"))

    # a cut is the last key of its range in ascending order, so its first document; it also follows the range before
    m = len(cuts)
    follow = [(int(o), int(tk), (m - 2 - k) % m) for k, (o, tk) in enumerate(cuts)]
    follow = spark.createDataFrame(follow, "o bigint, tk bigint, before int")
    rows = rows.withColumn("p", range_of("o", "tk")).join(F.broadcast(follow), ["o", "tk"], "left")
    goes = F.array(F.struct(F.col("p").alias("part"), F.lit(0).alias("ahead")), F.struct(F.col("before").alias("part"), F.lit(1).alias("ahead")))
    rows = rows.select("doc_id", "o", "tk", "text", F.explode(F.filter(goes, lambda g: g["part"].isNotNull())).alias("g"))
    rows = rows.select("g.part", "g.ahead", "doc_id", "o", "tk", "text").repartition(n, "part").sortWithinPartitions("part", "ahead", F.desc("o"), F.desc("tk"))
    return rows.select("part", "ahead", "doc_id", "text").mapInArrow(_compare, RESULT)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
