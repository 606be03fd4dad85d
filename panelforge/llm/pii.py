"""Personal data in texts by weak supervision.

Expressions, a gazetteer of first names and context words propose spans, from the runs of digits and the words with
capitals of a text. Labelers (checksum, gazetteer, context words,
shape, edges) vote personal, not personal or abstain on each; expectation-maximisation over the counts of all vote
patterns of the whole table estimates the labelers' reliabilities for every kind of span, and a logistic regression
trained on the posteriors is the final span classifier. Base spans (email, ip, card, phone) always stay; the classifier
decides which further spans (national number, iban, mac, local phone, account, person) are added. Spans that overlap a
base span are not proposed. Proposals may overlap each other: all are scored, and of the accepted ones that overlap, the
leftmost, then longest, then first kind is taken. A labeler that knows nothing about a span abstains, a span that none
speaks for has no evidence and is not accepted, and a classifier that saw no proposal adds nothing.

The gazetteer of first names is a parameter (`names`) of fit, find_pii and redact; the stated one holds common names of
the four languages of the tables.

The table is read twice: once for the counts of vote patterns (kinds times 3 to the number of labelers at most, so
bounded however long the table is), once to apply the model.

Defined results: a null or empty text has no spans; positions are code points of the whole text, ends exclusive;
repeated rows give equal results; null doc_ids stay; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import read, small_batches, text_of
from panelforge.llm.secrets import joined

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "national", "iban", "mac", "local_phone", "account", "person")
#: The base expressions; possessive digits keep long runs of digits linear, and match the same spans.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
RUN = re.compile(r"[0-9]+")
#: Tried only where a run of digits begins (or a bracket before it).
NATIONAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", re.A)
LOCAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])", re.A)
ACCOUNT = re.compile(r"[0-9](?:[\x20-]?[0-9]){5,17}(?![\w-])", re.A)
ACCOUNT_WORD = re.compile(r"(?i)\b(?:account|konto|passport|licen[cs]e|ssn)(?:\x20(?:no|nr|number))?[.:#]?\x20?#?$")
IBAN = re.compile(r"[A-Z][A-Z][0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", re.A)
MAC = re.compile(r"(?<!\w)(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b", re.A)
#: A word with a capital; a person where the gazetteer has the first of two, or a title or word announces them.
CAPITAL = re.compile(r"[A-ZÀ-Ý]\w+")
TITLE = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)$")
ANNOUNCER = re.compile(r"(?:Name|Contact|Signed|Dear|Patient)$")
ANNOUNCED = re.compile(r"\b(?:[Nn]ame|[Cc]ontact|[Ss]igned|[Dd]ear|[Pp]atient)(?:\x20is|\x20by)?[:,]?\x20$")
#: First names of the gazetteer, and words that announce personal data.
NAMES = frozenset(
    "adam adrien agnes alejandro alex alexander alice amelie ana andrea andreas andrew angela anna anne anthony antoine antonio barbara beatriz ben benjamin bernard bob brigitte camille carla carlos carmen "
    "caroline catherine charles charlotte chloe christian christina christine claire claudia clara daniel david diego dominik edward elena elisabeth elizabeth emily emma enrique eric eva felix fernando "
    "florian francisco francois frank frederic gabriel george gerard grace hannah hans heinz helen helga henri henry hugo ingrid isabel isabelle jack jacques james jan jane javier jean jennifer jessica joan john "
    "jonas jorge jose joseph juan julia julie julien jürgen karen karl katharina kevin klaus laura lea leon linda lisa louis louise lucas lucia luis luisa lukas manuel marc marcel margaret maria marie mark "
    "markus marta martin mary mateo mathilde matthew max michael michel miguel monika nadia nathalie nicolas nicole nina oliver olivia pablo patricia patrick paul paula pedro peter petra philip philippe pierre "
    "pilar rafael ramon raul rebecca richard robert rosa ruth sabine samuel sandra sara sarah sebastian sofia sophie stefan stephanie steven susan susanne teresa thomas tim ursula victor walter werner william wolfgang".split()
)
CONTEXT = re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax|ssn|social|iban|account|konto|bank|mac|device|name|contact|address|born|dear|signed|patient|passport|licen[cs]e|mr|mrs|dr)\b")
AGAINST = re.compile(r"(?i)\b(?:version|isbn|order|part|model|figure|table|page|chapter|invoice)\b")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost non-overlapping matches, found from each at sign; long runs without one cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    free = 0
    for run in RUN.finditer(text):
        if run.start() >= free and (m := IP.match(text, run.start())):
            free = m.end()
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


_BINDING = tuple("=/#&%_")


def _shape(kind: str, span: str) -> int:
    """What the span's own form tells: a telling one, a filler, or nothing."""
    if kind == "person":
        return 0 if any(w.isupper() for w in span.split()) else -1
    if len(set(span.lower()) - set(":-. ()")) <= 2:
        return 0
    return 1 if kind == "mac" or (kind == "local_phone" and span[0] == "(") else -1


#: Each labeler gets (kind, span, the text before it, the text after it) and votes 1, 0, or -1 to abstain.
LABELERS: tuple[tuple[str, Callable[[str, str, str, str], int]], ...] = (
    ("checksum", lambda k, s, a, z: int(_iban_valid(s)) if k == "iban" else int(not s.startswith(("000", "666", "9"))) if k == "national" else -1),
    ("gazetteer", lambda k, s, a, z: -1),  # told by the walk that proposes persons, which knows the gazetteer
    ("context", lambda k, s, a, z: 1 if CONTEXT.search(a) else -1),
    ("against", lambda k, s, a, z: 0 if AGAINST.search(a) else -1),
    ("shape", lambda k, s, a, z: _shape(k, s)),
    ("edges", lambda k, s, a, z: 0 if a[-1:] in _BINDING or z[:1] in _BINDING else -1),
)


def _inside_word(text: str, s: int, more: str = "") -> bool:
    """Whether the character before a place makes it the middle of a word."""
    return s > 0 and (text[s - 1].isalnum() or text[s - 1] == "_" or text[s - 1] in more)


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    """National numbers, local phone numbers and announced accounts, from each run of digits."""
    for run in RUN.finditer(text):
        s, n = run.start(), run.end() - run.start()
        if n == 3:
            if text[run.end() : run.end() + 1] == "-" and not _inside_word(text, s, "-") and (m := NATIONAL.match(text, s)):
                yield "national", s, m.end()
            at = s - (text[s - 1 : s] == "(")
            if not _inside_word(text, at, "+-") and (m := LOCAL_PHONE.match(text, at)):
                yield "local_phone", at, m.end()
        if ACCOUNT_WORD.search(text[max(0, s - 24) : s]) and (m := ACCOUNT.match(text, s)):
            yield "account", s, m.end()


def _persons(text: str, names: frozenset[str]) -> Iterator[tuple[str, int, int, bool]]:
    """Words with capitals that the gazetteer has (last of a row: true), or that a title or word before them announces.
    Every word of a run of such words is looked at, so one that is no name doesn't hide the ones after it."""
    words = [m.span() for m in CAPITAL.finditer(text) if not _inside_word(text, m.start())]
    for i, (s, e) in enumerate(words):
        word = text[s:e]
        after = words[i + 1] if i + 1 < len(words) else None
        joined_on = after is not None and after[0] == e + 1 and text[e] == " "
        title = TITLE.match(word) is not None
        if title and after is not None and (joined_on or (after[0] == e + 2 and text[e : e + 2] == ". ")):
            last = words[i + 2] if i + 2 < len(words) and words[i + 2][0] == after[1] + 1 and text[after[1]] == " " else after
            yield "person", s, last[1], any(text[a:b].lower() in names for a, b in (after, last))
        elif not title and not ANNOUNCER.match(word):
            known = word.lower() in names
            if joined_on and known:
                yield "person", s, after[1], True
            elif ANNOUNCED.search(text[max(0, s - 14) : s]):
                yield "person", s, after[1] if joined_on else e, known


def proposals(text: str, names: frozenset[str] = NAMES) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether the gazetteer has it) of spans proposed by expressions, by the gazetteer and by context
    words, by start, then longest, then kind; they may overlap."""
    found = [(k, s, e, False) for k, s, e in _numbers(text)] + list(_persons(text, names))
    found += [("iban", *m.span(), False) for m in IBAN.finditer(text) if not _inside_word(text, m.start())]
    if text.count(":") >= 5:
        found += [("mac", *m.span(), False) for m in MAC.finditer(text)]
    return sorted(found, key=lambda x: (x[1], -x[2], KINDS.index(x[0])))


def extra_spans(text: str, base: list[tuple[str, int, int]], names: frozenset[str] = NAMES) -> list[tuple[str, int, int, str]]:
    """Proposed spans that overlap no base span, with their votes as a pattern of the characters 1, 0 and -. Both lists are
    in order, so they are gone through side by side."""
    out, at, reach = [], 0, 0
    for kind, s, e, known in proposals(text, names):
        # base spans that begin before this one ends; starts only grow, ends of proposals may not
        while at < len(base) and base[at][1] <= s:
            reach = max(reach, base[at][2])
            at += 1
        if s < reach or (at < len(base) and base[at][1] < e):
            continue
        before, after = text[max(0, s - 40) : s], text[e : e + 8]
        votes = "".join("1" if name == "gazetteer" and known else "-" if (v := f(kind, text[s:e], before, after)) < 0 else str(v) for name, f in LABELERS)
        out.append((kind, s, e, votes))
    return out


def settled(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of accepted spans that overlap, the leftmost, then longest, then first kind."""
    out, free = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if s >= free:
            out.append((kind, s, e))
            free = e
    return out


def reliabilities(patterns: dict[tuple[str, str], int], rounds: int = 60) -> tuple[dict[str, np.ndarray], dict[tuple[str, str], float]]:
    """(kind: labelers x {share of votes 1 if personal, if not}, posterior of each pattern) by expectation-maximisation.

    patterns: how often each (kind, votes) was seen. A labeler has, for each kind and class, rates of voting 1, voting 0 and
    abstaining: one that only ever votes 1 tells the classes apart by how often it does. Every kind has its own share of
    personal spans; a prior of ten spans holds the rates of rare kinds near those of all kinds together."""
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], dtype=float)
    width = len(keys[0][1]) if keys else len(LABELERS)
    vote = np.array([["10-".index(c) for c in v] for _, v in keys], dtype=int).reshape(len(keys), width)
    cast = vote < 2
    share = np.where(cast.any(axis=1), (vote == 0).sum(axis=1) / np.maximum(cast.sum(axis=1), 1), 0.4)
    p = np.clip(share, 0.05, 0.95)
    kinds = sorted({k for k, _ in keys})
    of = np.array([kinds.index(k) for k, _ in keys], dtype=int)
    rate = np.full((len(kinds), width, 3, 2), 1 / 3)
    row, col = np.arange(len(keys))[:, None], np.arange(width)[None, :]
    for _ in range(rounds):
        for c, q in enumerate((p, 1 - p)):
            seen = np.zeros((len(kinds), width, 3))
            np.add.at(seen, (of[:, None] + 0 * col, col + 0 * row, vote), (n * q)[:, None] + np.zeros(width))
            prior = np.array([4.0, 1.0, 5.0]) if c == 0 else np.array([1.0, 4.0, 5.0])  # a labeler is believed to be better than chance
            pooled = seen.sum(axis=0) + prior
            pooled /= pooled.sum(axis=1, keepdims=True)
            rate[..., c] = (seen + 10 * pooled) / (seen.sum(axis=2, keepdims=True) + 10)
        mass, total = np.zeros(len(kinds)), np.zeros(len(kinds))
        np.add.at(mass, of, n * p)
        np.add.at(total, of, n)
        odds = (mass + 1) / (total + 2)
        lr = np.log(rate[..., 0].clip(1e-6)) - np.log(rate[..., 1].clip(1e-6))
        z = np.log(odds / (1 - odds))[of] + lr[of[:, None], col, vote].sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    shares = rate[:, :, 0, :] / rate[:, :, :2, :].sum(axis=2)
    return dict(zip(kinds, shares, strict=True)), dict(zip(keys, p.tolist(), strict=True))


def accepted(kind: str, votes: str, weights: np.ndarray) -> bool:
    """Whether the classifier takes a span; one that no labeler speaks for has no evidence."""
    return "1" in votes and bool(_features(kind, votes) @ weights > 0)


def _features(kind: str, votes: str) -> np.ndarray:
    x = np.zeros(len(KINDS) + 2 * len(LABELERS))
    x[KINDS.index(kind)] = 1
    for i, v in enumerate(votes):
        if v != "-":
            x[len(KINDS) + 2 * i + int(v)] = 1
    return x


def span_classifier(patterns: dict[tuple[str, str], int], steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression on kind and votes, fitted to the posteriors of all proposals by Newton steps with
    a ridge (votes and kinds are collinear). Without proposals all weights are zero, which accepts nothing."""
    keys = sorted(patterns)
    w = np.zeros(len(KINDS) + 2 * len(LABELERS))
    if not keys:
        return w
    _, posterior = reliabilities(patterns)
    x, y = np.array([_features(*k) for k in keys]), np.array([posterior[k] for k in keys])
    n = np.array([patterns[k] for k in keys], dtype=float)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + 0.1 * w
        hessian = (x.T * (n * p * (1 - p))) @ x + 0.1 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return w


def fit(docs: DataFrame, names: frozenset[str] = NAMES) -> np.ndarray:
    """Count the vote patterns of all documents and train the span classifier."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<string>")
    def proposed(text: pd.Series) -> pd.Series:
        return pd.Series([[f"{k} {v}" for k, _, _, v in extra_spans(t, base_spans(t), names)] for t in text], dtype=object)

    seen = docs.select(F.explode(proposed(text_of())).alias("k")).groupBy("k").count().collect()
    return span_classifier({tuple(r["k"].split(" ")): r["count"] for r in seen})


def spans_of(text: str | None, weights: np.ndarray, names: frozenset[str] = NAMES) -> list[tuple[str, int, int]]:
    """Base spans and those added, by start, then kind."""
    base = base_spans(text or "")
    added = settled([(k, s, e) for k, s, e, v in extra_spans(text or "", base, names) if accepted(k, v, weights)])
    return sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def find_pii(spark: SparkSession, weights: np.ndarray, names: frozenset[str] = NAMES):
    """A column function text -> array<struct<kind, start, end>>."""
    small_batches(spark)

    @F.pandas_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def spans(text: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t, weights, names)] for t in text], dtype=object)

    return spans


def redacted(text: str, weights: np.ndarray, names: frozenset[str] = NAMES) -> str:
    """The text with every span replaced by its kind in brackets; of spans that overlap, the union is replaced once."""
    out, done = [], 0
    for kind, s, e in spans_of(text, weights, names):
        if s >= done:
            out += [text[done:s], f"[{kind.upper()}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def redact(spark: SparkSession, weights: np.ndarray, names: frozenset[str] = NAMES):
    """A column function text -> redacted text."""
    small_batches(spark)

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t, weights, names) for t in text], dtype=object)

    return clean


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = docs.select("doc_id", find_pii(spark, fit(docs))(text_of()).alias("s"))
    number = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(number, BASE), F.sha2(joined(F.filter("s", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"),
    )
