"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

Voters are words of a stated lexicon, words and stems that a bounded set of labelled rows proposes, and patterns; each
votes toxic or abstains. The label model estimates by expectation-maximisation how often each voter fires in either
class (its accuracy) and, along a tree of the strongest dependences, how often it fires given the vote of another (its
correlation); it never sees a label. A logistic regression on the voters and on how many of a sort fire is trained on
the posteriors alone. Labels propose voters and set one number, the level that the scores are centred on.

The classifier is fitted on at most `limit` labelled rows (the ones with the least hash of their id); at most MINED
voters are proposed; scoring covers every word of every row. Texts stay on the executors: the driver gets counts of
terms and the votes of the training rows. Defined results: a null or empty text has the score of the intercept alone;
null doc_ids are never in the training rows and not held out; repeated rows get equal scores; empty tables give empty
results; other columns are ignored. Without labels of both classes the same label model and classifier are fitted on
`limit` rows of the documents (the ones with the least hash of their text), twice: first with the stated lexicon and the
patterns, then with the terms too that the first posteriors propose; the posteriors set the level.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import drop, read, small_batches, text_of, written

#: Common insults, as voters of their own.
LEXICON = (
    "abschaum arschloch asshole bastard bitch blöd clown connard crap coward cretin damn degenerate despicable disgusting dumb dumm dummkopf estúpido "
    "failure filth filthy fool freak garbage gilipollas hate idiot idiota idiote imbécile imbécil jerk kill liar loser maldito moron pathetic pig rat "
    "repulsive retard ridiculous salaud scum shit shut slime stupid stupide subhuman suck trash ugly useless vermin versager worthless wretched"
).split()
LIMIT, MINED, THRESHOLD = 8000, 400, 0.7
#: A proposed voter fires in at least so many toxic rows.
LEAST_ROWS = 4
#: Lengths of stems: inflecting languages spell one insult in many ways.
STEMS = (3, 4, 5, 6)
WORD = re.compile(r"\w+")
_INSULT = rf"(?:{'|'.join(LEXICON)})"
PATTERNS = (
    ("insult_near_insult", re.compile(rf"\b{_INSULT}\b(?=[^\0]{{0,300}}?\b{_INSULT}\b)")),
    ("insult_at_a_break", re.compile(rf"(?:^|[.!?\n])\s*{_INSULT}\b|\b{_INSULT}\s*(?:[.!?\n]|$)")),
    ("insult_inside_a_sentence", re.compile(rf"\w {_INSULT} \w")),
    ("second_person", re.compile(rf"\byou(?:'re| are)?\s+(?:(?:an?|such|so|the|all|are)\s+){{0,3}}{_INSULT}\b")),
    ("attack", re.compile(r"\b(?:shut\s+up|kill\s+yourself|get\s+lost|go\s+to\s+hell|drop\s+dead)\b")),
)
_HINT = re.compile(rf"{_INSULT}|lost|hell|drop")
_LEXICON = frozenset(LEXICON)


def _often(k: int, words: int) -> bool:
    """Whether k different words of one stem are many among the different words of a text."""
    return k > 1 and k * 200 >= words


def terms_of(text: str | None) -> set[str]:
    """The words of a whole text; stems that longer words begin with, with one star, and with two where many do."""
    words = set(WORD.findall((text or "").lower()))
    out = set(words)
    for n in STEMS:
        for s, k in Counter(w[:n] for w in words if len(w) > n).items():
            out.add(s + "*")
            if _often(k, len(words)):
                out.add(s + "**")
    return out


def pattern_hits(text: str | None) -> list[int]:
    low = (text or "").lower()
    if not _HINT.search(low):
        return [0] * len(PATTERNS)
    return [int(p.search(low) is not None) for _, p in PATTERNS]


class Voters:
    """The votes of a list of terms and of the patterns on whole texts."""

    def __init__(self, terms: list[str]) -> None:
        self.terms, self.at = terms, {w: i for i, w in enumerate(terms)}
        self.stems = [(n, frozenset(w.rstrip("*") for w in terms if w.endswith("*") and len(w.rstrip("*")) == n)) for n in STEMS]
        self.stated = np.array([w in _LEXICON for w in terms] + [False] * len(PATTERNS))
        self.size = len(terms) + len(PATTERNS)

    def fired(self, text: str | None) -> list[int]:
        words = set(WORD.findall((text or "").lower()))
        at = self.at
        out = [at[w] for w in at.keys() & words]
        for n, known in self.stems:
            if known:
                for s, k in Counter(s for w in words if len(w) > n and (s := w[:n]) in known).items():
                    out += [at[x] for x in ((s + "*", s + "**") if _often(k, len(words)) else (s + "*",)) if x in at]
        return out + [len(self.terms) + i for i, hit in enumerate(pattern_hits(text)) if hit]


def dependences(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The parent of each voter (-1: none) in the tree of the strongest correlations that the classes leave unexplained."""
    n, k = votes.shape
    rest = np.zeros((k, k))
    for w in (p, 1 - p):
        rate = (votes.T @ w + 1e-3) / (w.sum() + 2e-3)
        cov = (votes * w[:, None]).T @ votes / max(w.sum(), 1e-9) - np.outer(rate, rate)
        sd = np.sqrt(rate * (1 - rate))
        rest += (cov / np.outer(sd, sd).clip(1e-9)) ** 2 * w.sum() / n
    np.fill_diagonal(rest, 0)
    parent, best, root = np.full(k, -1), np.full(k, 0.01), np.zeros(k, dtype=bool)
    # Prim's way: the voter with the strongest tie to the tree joins it; a weak tie begins a tree of its own
    for _ in range(k):
        i = int(np.argmax(np.where(root, -1, best)))
        root[i] = True
        closer = ~root & (rest[i] > best)
        best[closer], parent[closer] = rest[i][closer], i
    return parent


def label_model(votes: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each row, firing rates of each voter [class, parent's vote, voter], parent of each voter).

    votes: rows x voters of 0/1. Expectation-maximisation of a two-class model, first with independent voters, then with
    each voter depending on the class and on its parent's vote.
    """
    n, k = votes.shape
    hits = votes.sum(axis=1)
    p = np.where(hits >= 3, 0.95, np.where(hits == 2, 0.6, np.where(hits == 1, 0.2, 0.01)))
    parent, other = np.full(k, -1), np.zeros_like(votes)
    rate = np.zeros((2, 2, k))
    for turn in range(rounds):
        if turn == rounds // 2:
            parent = dependences(votes, p)
            other = np.where(parent >= 0, votes[:, parent], 0.0)
        for c, w in ((1, p), (0, 1 - p)):
            a, b = (1.0, 3.0) if c else (0.05, 4.0)  # a voter is believed to fire more in toxic texts
            base = (votes.T @ w + a) / (w.sum() + a + b)
            for u in (0, 1):
                own = w[:, None] * (other == u)
                rate[c, u] = ((own * votes).sum(axis=0) + 4 * base) / (own.sum(axis=0) + 4)
        share = (p.sum() + 1) / (n + 8)
        on, off = np.log(rate[1] / rate[0]), np.log((1 - rate[1]).clip(1e-9) / (1 - rate[0]).clip(1e-9))
        # the vote and the parent's vote pick one of four log-odds of each voter
        z = off[0].sum() + votes @ (on[0] - off[0]) + other @ (off[1] - off[0]) + (votes * other) @ (on[1] - off[1] - on[0] + off[0])
        p = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + z, -30, 30)))
    return p, rate, parent


def features(votes: np.ndarray, stated: np.ndarray) -> np.ndarray:
    """The votes, and how many stated and how many other voters fire: a stated word that no training row holds still counts."""
    return np.column_stack([votes, np.log1p(votes[:, stated].sum(axis=1)), np.log1p(votes[:, ~stated].sum(axis=1))])


def logistic(x: np.ndarray, target: np.ndarray, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept fitted to soft targets by Adam."""
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        g = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - target
        grad = np.r_[x.T @ g / len(x) + 1e-3 * w, g.mean()]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def level(z: np.ndarray, label: np.ndarray) -> float:
    """The cut of z that tells the labelled rows apart best (by F1), half way between the two values around it."""
    order = np.argsort(-z, kind="stable")
    y = label[order]
    hits, taken = np.cumsum(y), np.arange(1, len(y) + 1)
    ends = np.r_[z[order][1:] != z[order][:-1], True]
    i = int(np.argmax(np.where(ends, 2 * hits / (taken + y.sum()), -1)))
    below = z[order][i + 1] if i + 1 < len(z) else z[order][i] - 2
    return float((z[order][i] + below) / 2)


@dataclass(frozen=True)
class ToxicityModel:
    terms: list[str]
    weights: np.ndarray
    bias: float
    voters: Voters = field(init=False, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "voters", Voters(self.terms))

    def score(self, text: str | None) -> float:
        at, v = self.voters.fired(text), self.voters
        stated = sum(bool(v.stated[i]) for i in at)
        z = self.bias + sum(self.weights[i] for i in at) + self.weights[v.size] * np.log1p(stated) + self.weights[v.size + 1] * np.log1p(len(at) - stated)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(terms: list[str], votes: np.ndarray, label: np.ndarray) -> ToxicityModel:
    """The label model weighs the votes, a logistic regression learns its posteriors, the labels set the level; where
    there are not both labels, the posteriors do, and where they find nothing toxic, or there are no rows, nothing does."""
    stated = Voters(terms).stated
    if not len(votes):
        return ToxicityModel(terms, np.zeros(votes.shape[1] + 2), -5.0)
    posterior, _, _ = label_model(votes)
    x = features(votes, stated)
    w, b = logistic(x, posterior)
    if not 0 < label.sum() < len(label):
        label = (posterior >= 0.5).astype(float)
    if not 0 < label.sum() < len(label):
        return ToxicityModel(terms, w, b)
    return ToxicityModel(terms, w, b - level(x @ w + b, label) + float(np.log(THRESHOLD / (1 - THRESHOLD))))


def training_rows(docs: DataFrame, labels: DataFrame, column: str, remainder: Column, limit: int) -> DataFrame:
    """Texts and labels of at most `limit` labelled ids, those with the least hash; an id that repeats counts once, with
    its least text. The ids that are broadcast are as bounded."""
    picked = labels.where(remainder & F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("r")).select("r.text", "r.label")


def held_out(mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, label) to the counts of each term in the rows of either label, added up over the task."""
    seen = [Counter(), Counter()]
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[int(y > 0)].update(terms_of(text))
    for part in range(0, len(keys := list(seen[0].keys() | seen[1].keys())), 50_000):
        own = keys[part : part + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([seen[1][k] for k in own], pa.int64()), pa.array([seen[0][k] for k in own], pa.int64())], names=["term", "toxic", "clean"])


def mine(rows: DataFrame, toxic: int, clean: int, most: int = MINED) -> list[str]:
    """Terms that toxic rows have far oftener than clean ones, first by the log-likelihood ratio of their row counts."""
    counts = rows.mapInArrow(_term_counts, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    n1, n0 = F.lit(float(max(1, toxic))), F.lit(float(max(1, clean)))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    share = (a + b) / (n1 + n0)
    gain = a * F.log(a / (n1 * share)) + F.when(b > 0, b * F.log(b / (n0 * share))).otherwise(0.0)
    found = counts.where(F.col("a") >= LEAST_ROWS).where(a / n1 >= 5 * (b + 0.5) / n0).withColumn("gain", F.round(gain, 6)).where("gain > 6")
    return [r["term"] for r in found.orderBy(F.desc("gain"), "term").limit(most).collect()]


def _votes(rows: DataFrame, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(votes, labels) of the training rows, in an order of their own."""
    voters = Voters(terms)

    @F.pandas_udf("array<int>")
    def fired(text: pd.Series) -> pd.Series:
        return pd.Series([sorted(voters.fired(t)) for t in text], dtype=object)

    got = rows.select(fired("text").alias("at"), "label").collect()
    got.sort(key=lambda r: (r["at"], r["label"]))
    votes = np.zeros((len(got), voters.size))
    for i, r in enumerate(got):
        votes[i, r["at"]] = 1
    return votes, np.array([float(r["label"] > 0) for r in got])


def _sizes(rows: DataFrame) -> dict[int, int]:
    return {int(r["y"]): r["n"] for r in rows.groupBy((F.col("label") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}


def train(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> ToxicityModel:
    """Three passes over the bounded training rows: their labels, their terms, their votes."""
    spark, scratch = docs.sparkSession, []
    small_batches(spark)
    rows = written(training_rows(docs, labels, "toxic", ~held_out(3, 1), limit), "toxicity-rows", scratch)
    sizes, terms = _sizes(rows), list(LEXICON)
    if len(sizes) < 2:
        # what the stated voters make of any rows stands in for labels, to propose further voters
        texts = docs.select(text_of().alias("text")).distinct()
        some = written(texts.orderBy(F.xxhash64("text"), "text").limit(limit).withColumn("label", F.lit(0)), "toxicity-rows", scratch)
        first = fit(terms, *_votes(some, terms))
        rows = written(some.withColumn("label", (toxicity_score(spark, first)("text") >= THRESHOLD).cast("int")), "toxicity-rows", scratch)
        sizes = _sizes(rows)
    if len(sizes) == 2:
        terms = list(dict.fromkeys([*terms, *mine(rows, sizes[1], sizes[0])]))
    out = fit(terms, *_votes(rows, terms))
    drop(spark, scratch)
    return out


def toxicity_score(spark: SparkSession, model: ToxicityModel):
    """A column function text -> score."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t) for t in text], dtype="float64")

    return score


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    score = toxicity_score(spark, train(docs, read(spark, sf_dir, "labels")))
    out = docs.select("doc_id", held_out(3, 1).alias("held_out"), score(text_of()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
