"""corpus_pipeline: its stages on odd rows, and the whole run against a plain replay of its decisions."""

import random

from pyspark.sql import functions as F
from test_corpus import docs, words

import corpus_pipeline as cp
from panelforge.llm import bagminhash, decontamination, packing, pii, quality_mil
from panelforge.llm.common import read, text_of, text_key

ROOT = "/root/testdata/sf0.001"


def near(seed):
    base = words(200, seed)
    return " ".join(base), " ".join([*base[:100], "other", *base[101:]])


def table(spark, tmp_path, rows):
    """A folder of tables whose documents are rows; labels call repeated words bad."""
    junk = [(10_000 + i, "spam spam $$$ ### " * 40) for i in range(60)]
    fine = [(20_000 + i, " ".join(words(120, 500 + i)).capitalize() + ".") for i in range(60)]
    docs(spark, [*rows, *junk, *fine]).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [*((i, 0, 0) for i, _ in junk), *((i, 1, 0) for i, _ in fine)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = " ".join(words(20, 77))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), item


def test_run_over_odd_rows(spark, tmp_path):
    a, b = near(31)
    leak = " ".join([*words(60, 41), *words(20, 77), *words(60, 42)])
    mail = "Write to " + " ".join(words(80, 43)) + " a.person@example.org today."
    rows = [(1, a), (2, b), (1, a), (3, leak), (4, mail), (None, " ".join(words(150, 44))), (5, None), (6, ""), (7, " ".join(words(9000, 45)))]
    path, _ = table(spark, tmp_path, rows)
    got = cp.run(spark, path).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert 3 not in by and 2 not in by and len([r for r in by[1] if r["start"] == 0]) == 1  # leaked, near copy, repeated row
    assert None in by and 4 in by and 7 in by and not any(10_000 <= (i or 0) < 10_060 for i in by)
    assert sum(20_000 <= (i or 0) < 20_060 for i in by) == 60
    for pieces in by.values():
        assert sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"]
    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert used.get(r["sequence_id"], 0) == r["offset"]
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= packing.WINDOW
    # the address is gone from what was packed
    clean = pii.redacted(mail, pii.fit(read(spark, path, "documents")))
    assert "example.org" not in clean and by[4][0]["doc_tokens"] == len(packing.encode(clean, packing.default_vocabulary())) + 1


def test_stages_keep_clashing_columns_and_empty_tables(spark, tmp_path):
    path, _ = table(spark, tmp_path, [(1, "some words of a plain text")])
    extra = read(spark, path, "documents").withColumns({"tk": F.lit(1), "root": F.lit("r"), "class_id": F.lit(2), "item_id": F.lit(3), "hits": F.lit(4), "label": F.lit(5)})
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, extra, path)
        assert out.columns == extra.columns, name
        assert stage(spark, extra.limit(0), path).count() == 0, name
        assert out.where("class_id = 2 and label = 5").count() == out.count() > 0, name
    assert cp.pack_windows(spark, extra.limit(0), path).count() == 0


def brute_keepers(texts):
    """One document of each group of near copies: union-find over all pairs."""
    plain = sorted({t for _, t in texts})
    bags = {t: bagminhash.bag(t) for t in plain}
    root = {t: t for t in plain}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, x in enumerate(plain):
        for y in plain[i + 1 :]:
            if bagminhash.weighted_jaccard(bags[x], bags[y]) >= 0.8:
                root[find(y)] = find(x)
    first = {}
    for i, t in sorted(texts):
        first.setdefault(find(t), i)
    return set(first.values())


def test_run_against_a_replay(spark):
    rows = read(spark, ROOT, "documents")
    score = quality_mil.quality_score(spark, quality_mil.train(rows, read(spark, ROOT, "labels")))
    texts = [(r["doc_id"], r["text"] or "") for r in rows.where(score(text_of()) >= quality_mil.THRESHOLD).collect()]
    kept = brute_keepers(texts)
    grams = lambda t: {tuple(w[i : i + 5]) for w in [[x for x in __import__("re").split(r"[^\w]+|_", t.lower()) if x]] for i in range(len(w) - 4)}
    items = [g for r in read(spark, ROOT, "benchmark").collect() if (g := grams(r["text"] or ""))]
    texts = [(i, t) for i, t in texts if i in kept and not any(len(g & grams(t)) >= 0.8 * len(g) for g in items)]
    stage = rows.where(F.col("doc_id").isin([i for i, _ in texts]))
    weights = pii.fit(stage)
    want = sorted((i, len(packing.encode(pii.redacted(t, weights), packing.default_vocabulary())) + 1) for i, t in texts)
    got = sorted({(r["doc_id"], r["doc_tokens"]) for r in cp.run(spark, ROOT).collect()})
    assert got == want


def test_keys_tell_equal_ids_apart(spark):
    rows = docs(spark, [(1, "a b c"), (1, "d e f"), (None, random.Random(1).random().hex())])
    assert rows.select(text_key()).distinct().count() == 3 and decontamination.find_contained(rows, spark.createDataFrame([], "item_id long, text string")).count() == 0
