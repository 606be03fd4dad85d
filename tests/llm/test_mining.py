"""Mixing, phrase mining and spelling forms against brute force, their SQL, and the defined results for odd rows."""

import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelforge.llm import collocations, common, mixing, spelling
from panelforge.llm.common import drop, ranked
from test_corpus import DOCS, ODD, docs

ROOT = "/root/testdata/sf0.001"


def sourced(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, "k", "clash") for i, t, lang, s in rows], DOCS)


# ---- 11 mixing


def brute_targets(sizes, weights=mixing.WEIGHTS, most=mixing.MOST):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, bounded = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in bounded)
        free = [s for s in order if s not in bounded]
        out = {s: float(most * sizes[s]) for s in bounded} | {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if out[s] > most * sizes[s]}
        if not over:
            return out
        bounded |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets_against_resharing(spark, seed):
    r = random.Random(seed)
    sizes = {r.choice(["é", "b", "Z", "ab", "a", "漢", "c"]) + str(i): int(r.paretovariate(0.6)) for i in range(r.randrange(2, 12))} | {None: 3}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    mine = []
    got = {x["source"]: x["target"] for x in mixing.targets(rows, mine).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)
    assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6
    drop(spark, mine)


def test_meeting_keeps_sums_and_expectations():
    r = random.Random(3)
    for _ in range(300):
        a, b = ((s := r.randrange(2, 40)), r.uniform(0.01, 0.99) * s, 1), ((s := r.randrange(2, 40)), r.uniform(0.01, 0.99) * s, 2)
        up, down = min(a[0] - a[1], b[1]), min(a[1], b[0] - b[1])
        odds = down / (up + down)
        ends = [mixing.meet(a, b, odds * 0.999), mixing.meet(a, b, min(1.0, odds * 1.001 + 1e-9))]
        for x, y in ends:
            assert abs(x + y - a[1] - b[1]) < 1e-9 and (x in (0, a[0]) or y in (0, b[0])) and 0 <= x <= a[0] and 0 <= y <= b[0]
        assert abs(odds * ends[0][0] + (1 - odds) * ends[1][0] - a[1]) < 1e-9


def test_tree_against_a_replay(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FIRST", 6)
    monkeypatch.setattr(mixing, "FAN", 2)
    r = random.Random(5)
    rows = sourced(spark, [(i, " ".join(["w"] * r.randrange(0, 30)), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(400)])
    got = mixing.mix_sources(rows).collect()
    mine, held = [], [x.asDict() for x in mixing.sized(rows).collect()]
    sizes = Counter()
    for x in held:
        sizes[x["source"]] += x["size"]
    want, level, nodes = brute_targets(sizes), 0, 6
    for x in held:
        rate = want[x["source"]] / sizes[x["source"]] if sizes[x["source"]] else 0.0
        x |= {"copies": int(rate), "mass": (rate - int(rate)) * x["size"], "node": x["order"] % 6}
    pending = held
    while True:
        groups = defaultdict(list)
        for x in pending:
            groups[x["source"], x["node"]].append(x)
        pending = []
        for g in groups.values():
            keep = None
            for x in sorted(g, key=lambda x: (x["order"], x["doc_id"])):
                if 0 < x["mass"] < x["size"] and keep:
                    u = mixing._draw(keep["order"], x["order"], level, 11)
                    keep["mass"], x["mass"] = mixing.meet((keep["size"], keep["mass"], 0), (x["size"], x["mass"], 0), u)
                    keep = next((k for k in (keep, x) if 0 < k["mass"] < k["size"]), None)
                elif 0 < x["mass"] < x["size"]:
                    keep = x
            pending += [keep] if keep else []
        if nodes == 1:
            break
        nodes, level = -(-nodes // 2), level + 1
        for x in pending:
            x["node"] //= 2
    assert {x["doc_id"]: x["taken"] for x in got} == {x["doc_id"]: x["copies"] * x["size"] + round(x["mass"]) for x in held}
    taken = Counter()
    for x in got:
        taken[x["source"]] += x["taken"]
        assert x["taken"] <= 3 * x["size"] and abs(x["target"] - want[x["source"]]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want)
    # all but one row of a source are taken in whole copies
    parts = Counter(x["source"] for x in got if x["size"] and x["taken"] % x["size"])
    assert not parts or max(parts.values()) == 1
    drop(spark, mine)


def test_draws_are_unbiased(spark):
    rows = sourced(spark, [(i, "w " * (5 + i % 7), "en", "ab"[i % 2]) for i in range(40)])
    total = Counter()
    for seed in range(8):
        for x in mixing.mix_sources(rows, seed=seed, last="coin").collect():
            assert x["taken"] % x["size"] == 0
            total[x["source"]] += x["taken"] / x["target"] / 8
    assert all(abs(v - 1) < 0.08 for v in total.values())


def test_mixing_odd_rows(spark):
    rows = sourced(spark, [(1, None, "en", None), (2, "", "en", "a"), (3, "a b c\x1cd", "en", "a"), (3, "a b c\x1cd", "en", "a"), (None, "x y\tz", None, "b"), (5, "ab " * 50_000, "en", None)])
    got = mixing.mix_sources(rows).collect()
    assert sorted((x["size"], x["source_size"]) for x in got) == [(0, 2), (0, 50_000), (1, 2), (1, 2), (3, 3), (50_000, 50_000)]
    assert all(x["taken"] <= 3 * x["size"] for x in got) and sum(x["taken"] for x in got) == 50_005
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(rows).collect()), key=str)
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert [x["taken"] for x in mixing.mix_sources(docs(spark, [(1, None), (2, "")])).collect()] == [0, 0]
    with pytest.raises(ValueError):
        mixing.mix_sources(rows, last="half")


def test_ranked_counts_on_from_range_to_range(spark):
    mine = []
    df = spark.range(1000).select(F.xxhash64("id").alias("x"), F.lit(1).alias("rank2"))
    got = [tuple(r) for r in ranked(df, F.col("x").desc(), name="ranked", rank="place", scratch=mine).select("x", "place").collect()]
    assert sorted(got, key=lambda r: r[1]) == [(x, i) for i, x in enumerate(sorted((x for x, _ in got), reverse=True))]
    assert ranked(df.limit(0), F.col("x"), name="ranked", rank="place", scratch=mine).count() == 0
    drop(spark, mine)


# ---- 12 collocations


def brute_phrases(rows, least):
    f = Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            f[lang, 0, ""] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, k, " ".join(w[i : i + k])] += 1
    return {k: v for k, v in f.items() if v >= least or (k[1] == 0 and v)}


def chatter(seed, n, letters="abcé"):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = ["".join(r.choices(letters, k=r.randrange(1, 3))) for _ in range(r.randrange(0, 60))]
        out.append((i, "".join(x + r.choice([" ", " ", "  ", "\t", ". ", "\n", ","]) for x in w), r.choice(["en", "de", None]), "s"))
    return out


@pytest.mark.parametrize(("shards", "bits", "size"), [(1, 15, 1 << 20), (2, 20, 64), (4, 15, 16)])
def test_counts_of_whole_cycles_are_exact(spark, shards, bits, size):
    rows = [*chatter(shards, 60), (100, None, "en", "s"), (None, "A a. A a", "EN", "s"), (101, " ".join(["long"] * 900), "en", "s"), (102, "x" * 3000 + " a a", None, "s")]
    mine = []
    got = collocations.frequent_phrases(sourced(spark, rows), mine, shards=shards, least=4, bits=bits, size=size, bucket_bits=16 + shards).collect()
    drop(spark, mine)
    assert len(got) == len({(r["lang"], r["words"], r["phrase"]) for r in got})
    assert {(r["lang"], r["words"], r["phrase"]): r["f"] for r in got if r["f"] >= 4 or r["words"] == 0} == brute_phrases(rows, 4)


def test_a_pair_is_counted_from_the_step_its_words_are_known():
    never = np.full(1 << 15, collocations.NEVER, np.uint8)
    known, some = np.full(1 << 15, 1, np.uint8), np.full(1 << 17, 1, np.uint8)
    text, lang = pa.array(["a b c a b"]), pa.array(["en"])
    sizes = lambda **k: sorted({w for b in collocations.Scan(shards=2, **k).grams(lang, text) for w in b.column("words").to_pylist()})
    assert sizes(step=0, word_step=never, pair_step=never, bucket_step=np.full(1 << 17, 255, np.uint8)) == [-1, 0, 1]
    assert sizes(step=1, word_step=known, pair_step=never, bucket_step=some) == [-1, 0, 1, 2]
    assert sizes(step=1, word_step=known, pair_step=never, bucket_step=some + 1) == [-1, 0, 1]
    assert sizes(step=2, word_step=known, pair_step=np.full(1 << 15, 2, np.uint8), bucket_step=some) == [2, 3]
    assert sizes(step=3, word_step=known, pair_step=np.full(1 << 15, 2, np.uint8), bucket_step=some) == [3]


def test_a_chunk_takes_bounded_memory_and_leaves_in_small_batches():
    r = np.random.default_rng(7)
    words = np.array(["".join(chr(97 + c) for c in r.integers(0, 26, k)) for k in r.integers(2, 10, 9000)])
    text = [" ".join(words[(r.random(600) ** 2 * len(words)).astype(int)]) for _ in range(500)]
    lang, chunk, size = pa.array(["en"] * len(text)), pa.array(text), sum(map(len, text))
    known = np.full(1 << 15, 1, np.uint8)
    scan = collocations.Scan(step=2, shards=3, word_step=known, pair_step=known, bucket_step=np.full(1 << 17, 1, np.uint8))
    list(scan.grams(lang, chunk))
    pool = pa.default_memory_pool()
    tracemalloc.start()
    try:
        before, sizes, arrow = pool.bytes_allocated(), [], 0
        for b in scan.grams(lang, chunk):
            sizes.append(b.num_rows)
            arrow = max(arrow, pool.bytes_allocated() - before)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(sizes) > 500_000 and max(sizes) <= 1 << 15
    assert peak < 26 * size and arrow < 8 * size, (peak / size, arrow / size)


def test_scores_are_exact(spark):
    rows = [(a, left, right) for a in (10, 12_345_678_901, 999_999_999_937) for left in (a, a + 1, 3 * a + 7) for right in (a, 2 * a + 1)]
    df = spark.createDataFrame(rows, "a long, l long, r long").withColumn("s", collocations.score())
    assert [(r["a"], r["l"], r["r"], r["s"]) for r in df.collect()] == [(a, x, y, 1_000_000 * a * a // (x * y)) for a, x, y in rows]


def test_collocations_against_their_sql(spark):
    rows = [*chatter(9, 400, "abcd"), *[(None, "the same odd phrase. The same odd phrase", "en", "s")] * 12, (7, "ab " * 50_000, None, None), (8, None, None, None)]
    df = sourced(spark, rows)
    got = sorted(map(tuple, collocations.collocations(df).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    con = duckdb.connect()
    con.register("documents", pa.table({"text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string())}))
    want = con.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({collocations.OP12_SQL})").fetchall()
    assert got == sorted(want) and len(got) > 100
    few = collocations.collocations(df, top=7, shards=1, bits=15, bucket_bits=16).collect()
    assert sorted((r["lang"], r["rank"], r["phrase"]) for r in few) == [g[:3] for g in got if g[1] <= 7]
    assert collocations.collocations(docs(spark, []), shards=2, bits=15, bucket_bits=16).count() == 0
    assert collocations.collocations(docs(spark, ODD[:6]), shards=2, bits=15, bucket_bits=16).count() == 0


# ---- 13 spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(n):
    out = {}
    for w in n:
        near = [v for v in n if one_edit(v, w)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = (form, n[w], len(near), n[form] if form else None)
    root = lambda w: w if out[w][0] is None else root(out[w][0])
    return {w: (v[0], root(w), *v[1:]) for w, v in out.items()}


@pytest.mark.parametrize(("letters", "most"), [("ab", 7), ("aé÷ÿz", 6)])
def test_forms_against_brute_force(spark, letters, most):
    r = random.Random(most)
    n = {"".join(r.choices(letters, k=r.randrange(1, most))): int(r.paretovariate(0.5)) for _ in range(300)}
    df = spark.createDataFrame(list(n.items()), "word string, n long").withColumns({"id": F.lit("clash"), "part": F.lit(1)})
    got = spelling.spelling_forms(df).collect()
    assert len(got) == len(n) and {x["word"]: tuple(x)[1:] for x in got} == brute_forms(n)


def test_nodes_number_each_prefix_once(spark):
    words = {"".join(random.Random(i).choices("abé", k=i % 9 + 1)) for i in range(400)} | {"a" * 500, "a" * 499 + "b"}
    mine = []
    got = spelling.trie_nodes(spark.createDataFrame([(w,) for w in words], "word string"), "word", "nodes", mine).collect()
    drop(spark, mine)
    at = {}
    for x in got:
        for k, node in enumerate(x["nodes"]):
            assert at.setdefault(x["word"][:k], node) == node
    assert sorted(at.values()) == list(range(len(at)))


def test_common_prefix():
    for a, b in [("", "a"), ("abc", "abd"), ("ab", "abc"), ("xyz", "abc"), ("a" * 1000 + "b", "a" * 1000 + "c")]:
        assert spelling.common_prefix(a, b) == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_crc_of_many_words_at_once():
    r = random.Random(1)
    parts = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 2, 5, 64, 65, 300]))) for _ in range(200)]
    heads = [str(i).encode() + b":" for i in range(200)]
    at = np.r_[0, np.cumsum([len(p) for p in parts])]
    got = spelling.crc_after(np.array([zlib.crc32(h) for h in heads], dtype=np.uint32), np.frombuffer(b"".join(parts), np.uint8), at)
    assert got.tolist() == [zlib.crc32(h + p) for h, p in zip(heads, parts, strict=True)]


def test_vocabulary_against_brute_force_and_sql(spark):
    r = random.Random(2)
    rows = [(i, " ".join("".join(r.choices("abÀéß÷", k=r.randrange(3, 8))).capitalize() + r.choice(["", "1", "œ", " ", "."]) for _ in range(80)), "en", "s") for i in range(120)]
    rows += [(None, "Aaaaaaa aaaaaaa", None, None)] * 3 + [(5, None, None, None), (6, "", None, None), (7, "ab " * 50_000 + "y" * 5000, None, None), (8, "y" * 5000, None, None), (9, "y" * 5000, None, None)]
    n = Counter()
    for i, text, _, _ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall(r"[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
            n[run] += len(run) >= 5
    n = {w: c for w, c in n.items() if c >= 3}
    words = spelling.vocabulary(sourced(spark, rows))
    assert {x["word"]: x["n"] for x in words.collect()} == n
    got = spelling.spelling_forms(words).collect()
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([x[0] for x in rows], pa.int64()), "text": pa.array([x[1] for x in rows], pa.string())}))
    want = con.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({spelling.OP13_SQL.replace('length(run) >= 5', 'length(run) BETWEEN 5 AND 4000')})").fetchall()
    assert sorted((tuple(x) for x in got if len(x["word"]) < 4000), key=str) == sorted(want, key=str)
    assert sum(len(x["word"]) == 5000 for x in got) == 1
    assert spelling.spelling_forms(spelling.vocabulary(docs(spark, []))).count() == 0


@pytest.mark.parametrize("module", ["mixing", "collocations", "spelling"])
def test_tables_in_the_shared_folder_go(spark, tmp_path, module, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    df = sourced(spark, chatter(1, 30))
    if module == "mixing":
        mixing.mix_sources(df)
    elif module == "collocations":
        collocations.collocations(df, least=3, shards=2, bits=15, bucket_bits=16)
    else:
        spelling.spelling_forms(spelling.vocabulary(df, long=1))
    assert len(list(tmp_path.iterdir())) == 1  # the result
