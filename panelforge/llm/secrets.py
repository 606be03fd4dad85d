"""Secrets in texts: an Aho-Corasick keyword prefilter, anchored expressions near hits, embedded checksums.

One automaton pass over the lower-case text finds all keywords. Each kind's expression is tried only where one of its
keywords begins, anchored there and left to right, which gives exactly its leftmost non-overlapping matches because no
match can begin elsewhere. Runs of hexadecimal digits have no keyword; an expression finds them directly. Kinds with an
embedded checksum or structure are validated and dropped when it fails.

Base kinds: assign, access, hex. Added kinds: github (base-62 CRC-32 in the last six characters), npm (the same),
jwt (its header is a JSON object), pem, slack, google, stripe.

Defined results: a null or empty text has no spans; positions are code points of the whole text, ends exclusive;
letters match in either case only within ASCII; rows that repeat give equal results; null doc_ids stay; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import read, small_batches, text_of

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "jwt", "pem", "slack", "google", "stripe")
#: The base expressions.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out


def _checksummed(m: re.Match) -> bool:
    return base62_crc(m[1]) == m[2]


def _json_header(m: re.Match) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4))), dict)
    except ValueError:
        return False


#: kind: keywords in lower case, expression anchored at a keyword, validation of a match.
RULES = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (("akia",), ACCESS, lambda m: len(m[0]) >= 20),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _checksummed),
    "npm": (("npm_",), re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _checksummed),
    "jwt": (("eyj",), re.compile(r"(eyJ[A-Za-z0-9_-]{8,})\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), _json_header),
    "pem": (("-----begin",), re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), None),
    "slack": (("xox",), re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), None),
    "google": (("aiza",), re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"), None),
    "stripe": (("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[A-Za-z0-9]{16,}"), None),
}


def _automaton() -> ahocorasick.Automaton:
    found: dict[str, list[str]] = {}
    for kind, (keys, _, _) in RULES.items():
        for k in keys:
            found.setdefault(k, []).append(kind)
    out = ahocorasick.Automaton()
    for k, kinds in found.items():
        out.add_word(k, (len(k), tuple(kinds)))
    out.make_automaton()
    return out


AUTOMATON = _automaton()


def _lower_ascii(text: str) -> str:
    """Lower case without moving any position."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c < "\x80" else c for c in text)


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    if not text:
        return []
    spans, starts = [], {}
    for end, (size, kinds) in AUTOMATON.iter(_lower_ascii(text)):
        for kind in kinds:
            starts.setdefault(kind, set()).add(end - size + 1)
    for kind, at in starts.items():
        _, pattern, valid = RULES[kind]
        free = 0
        for i in sorted(at):
            if i >= free and (m := pattern.match(text, i)):
                free = m.end()
                if valid is None or valid(m):
                    spans.append((kind, i, free))
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(spark: SparkSession):
    """A column function text -> array<struct<kind, start, end>>."""
    small_batches(spark)

    @F.pandas_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def spans(text: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in text], dtype=object)

    return spans


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "documents").select("doc_id", find_secrets(spark)(text_of()).alias("s"))
    number = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(number, BASE), F.sha2(joined(F.filter("s", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"),
    )
