"""Corpus operators on small fixtures: round trips, brute force, and the defined results for odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm import bagminhash, chat_format, decontamination, fingerprints, packing, pii, quality_mil, secrets, sharding, toxicity
from panelforge.llm.common import text_of

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, k string, score string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None, "k", "clash") for i, t in texts], DOCS)


ODD = [(1, None), (2, ""), (3, "   "), (4, "one two three four five six seven"), (4, "one two three four five six seven"), (None, "x y"), (7, "ab " * 50_000)]


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a <|end|> &lt; [INST]"), (1, 1, "assistant", "</s>"), (1, 1, "assistant", "</s>"), (2, None, None, None), (None, 3, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("body", F.lit(1))
    out = chat_format.format_conversations(df).withColumn("back", chat_format.parse(F.col("formatted"))).collect()
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["back"]] for r in out}
    assert back == {1: [("user", rows[0][3]), ("assistant", "</s>"), ("assistant", "</s>")], 2: [("", "")], None: [("user", "x")]}
    one = next(r for r in out if r["conv_id"] == 1)
    assert [one["formatted"][s["start"] : s["start"] + s["length"]] for s in one["loss_spans"]] == ["&lt;/s>", "&lt;/s>"]
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_chat_parts(spark):
    df = spark.sql("select 1L conv_id, 0L turn, 'user' role, array(named_struct('type','text','text','<see','ref',null,'width',null,'height',null,'seconds',null,'pages',null), named_struct('type','image','text',null,'ref','a.png','width',56,'height',29,'seconds',null,'pages',null)) p")
    r = chat_format.format_conversations(df, parts="p").first()
    assert "&lt;see<|image|>" in r["formatted"] and r["expanded_tokens"] == 4 and r["attachments"][0]["ref"] == "a.png"


def test_bagminhash_is_unbiased():
    a, b = words(300, 1), words(300, 2)
    x, y = " ".join(a * 2 + b), " ".join(a * 2)
    bags = [bagminhash.bag(x), bagminhash.bag(y)]
    true = bagminhash.weighted_jaccard(*bags)
    sig = bagminhash.signatures(bags, 4000)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04


def test_near_duplicates(spark):
    base = words(200, 3)
    near = [*base]
    near[100] = "other"
    rows = [*ODD, (20, " ".join(base)), (21, " ".join(near)), (22, " ".join(base)), (30, " ".join(words(200, 4)))]
    members, _ = bagminhash.near_duplicate_classes(docs(spark, rows))
    got = sorted(((r["doc_id"], r["class_id"]) for r in members.collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (4, 4), (4, 4), (None, None), (7, 7), (20, 20), (21, 20), (22, 20), (30, 30)], key=str)
    kept = bagminhash.keepers(members).count()
    assert kept == 7
    assert bagminhash.near_duplicate_classes(docs(spark, []))[0].count() == 0


def test_keepers_of_repeated_and_null_ids(spark):
    def pair(seed):
        base = words(200, seed)
        return " ".join(base), " ".join([*base[:100], "other", *base[101:]])

    (a, a2), (b, b2), (c, c2) = pair(21), pair(22), pair(23)
    rows = docs(spark, [(1, a), (5, a2), (1, b), (6, b2), (None, c), (None, c2)])
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, rows, "").collect()), key=str)
    assert kept in [sorted([(1, a), (1, b), (None, x)], key=str) for x in (c, c2)]


def test_packing(spark):
    df = docs(spark, [*ODD, (9, "<|endoftext|> special")])
    got = packing.pack(packing.tokenized_pieces(df)).collect()
    assert sum(r["length"] for r in got if r["start"] == 0 and r["doc_id"] == 1) == 1
    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert used.get(r["sequence_id"], 0) == r["offset"]
        used[r["sequence_id"]] = r["offset"] + r["length"]
        assert len(r["ids"]) == 4 * r["length"]
    assert max(used.values()) <= packing.WINDOW
    exact, _ = packing._encoders(*packing.default_vocabulary())
    ids = np.frombuffer(next(r["ids"] for r in got if r["doc_id"] == 9), dtype="<u4").tolist()
    assert ids == [*exact.encode("<|endoftext|> special", add_special_tokens=False).ids, 1]


def test_packing_of_a_large_partition(spark):
    """Long pieces, then as many short ones that just fill their windows: one sequence for two pieces at any size."""
    n = 140_000
    length = F.when(F.col("id") < n, 1500).otherwise(packing.WINDOW - 1500).cast("long")
    pieces = spark.range(2 * n).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), length.alias("length"))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        windows = packing.pack(pieces).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("lo"), F.max("offset").alias("hi"))
        got = windows.groupBy("n", "lo", "hi").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert [tuple(r) for r in got] == [(packing.WINDOW, 0, 1500, n)]


def brute_secrets(t):
    out = [("assign", *m.span()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets():
    r = random.Random(5)
    parts = ["token", "Secret", '"', ":", "=", " ", "abcdef12", "AKIA", "A" * 16, "0af" * 9, "\n", "İ", "passwordtoken=", "ſecret=abcdefg", "K"]
    for _ in range(3000):
        t = "".join(r.choices(parts, k=12))
        assert sorted(s for s in secrets.find(t) if s[0] in secrets.BASE) == brute_secrets(t), t
    body = "zy" * 15  # no run of hexadecimal digits
    assert secrets.find(f"ghp_{body}{secrets.base62_crc(body)}")[0][0] == "github" and not secrets.find(f"ghp_{body}000000")
    assert secrets.find(None) == []


def brute_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii():
    r = random.Random(6)
    parts = ["a@b.c", "@", ".", "-", "x", "1", "255", "256", "4111111111111111", "+1", " ", "(20)", "555 0100 22", "é", "a.b-c@d-e.f.g"]
    for _ in range(4000):
        t = "".join(r.choices(parts, k=10))
        assert sorted(pii.base_spans(t)) == brute_pii(t), t
    weights = pii.span_classifier({("national", "1-1-11"): 50, ("national", "0---0-"): 40})
    assert "[EMAIL]" in pii.redacted("write to me@here.org now", weights) and pii.spans_of(None, weights) == []


def test_fingerprints(spark):
    texts = [(5, "abc " * 30), (3, "the next document " * 9), (2, ""), (1, None), (None, "last")]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs(spark, texts)).collect()}
    order = [5, 3, 2, 1, None]
    plain = {i: t or "" for i, t in texts}
    for i, d in enumerate(order):
        t, nxt = plain[d], plain[order[(i + 1) % 5]]
        n = len(t)
        assert got[d]["edited_sha256"] == hashlib.sha256((t[: n - n // 3] + nxt[: n // 3]).encode()).hexdigest()
    assert got[2]["fingerprint"] == got[1]["fingerprint"] and got[2]["near_next"] == 1.0
    h, g = fingerprints.PrefixHash("xxabcdefyy"), fingerprints.PrefixHash("abcdefzz")
    assert h.extension(2, g, 0) == 6 and h.span(2, 6) == g.span(0, 6)
    assert fingerprints.fingerprints(docs(spark, [])).count() == 0


def test_decontamination(spark):
    item = words(20, 8)
    rows = [*ODD, (40, " ".join([*words(3000, 9), *item, *words(50, 10)])), (41, " ".join([*item[:9], *words(60, 11)]))]
    items = spark.createDataFrame([(1, " ".join(item).upper()), (2, "too short"), (3, None), (None, " ".join(item))], "item_id long, text string")
    got = decontamination.find_contained(docs(spark, rows), items).collect()
    assert [(r["doc_id"], r["item_id"], r["containment"]) for r in got] == [(40, 1, 1.0)]


def test_sharding(spark):
    rows = [*ODD, *((100 + i, f"text {i}" * (i % 7 + 1)) for i in range(300)), *((900 + i, "same text") for i in range(150))]
    out, table = sharding.shard_rows(docs(spark, rows), shards=5, slots=64)
    got = out.collect()
    assert len(got) == len(rows)
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert next(r for r in got if r["doc_id"] == 1)["text_crc32"] == zlib.crc32(b"")
    weight = [(i * 37) % 91 + 1 for i in range(64)]
    old = sharding.SlotMap.balanced(weight, 5)
    new = old.grown(weight)
    assert all(b in (a, 5) for a, b in zip(old.shard_of, new.shard_of, strict=True)) and new.version == 2 and new.loads(weight)[5] > 0


def test_classifiers(spark):
    bad, good = "bad bad bad bad " * 30, " ".join(words(100, 12)) + " are you"
    model = quality_mil.fit([quality_mil.passages(t) for t in [bad, good] * 40], np.array([0.0, 1.0] * 40))
    low, high, _ = model.score([quality_mil.passages(t) for t in (bad, good, None)])
    assert low < 0.3 < high
    rows = docs(spark, [(i, f"w{i} idiot v{i}" if i % 4 == 0 else f"good day {i}") for i in range(200)])
    tox = toxicity.train(rows, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int"))
    assert tox.score("what an idiot") > 0.7 > tox.score("good day") and 0 <= tox.score(None) < 0.7
    score = toxicity.toxicity_score(spark, tox)
    assert docs(spark, ODD).select(score(text_of())).count() == len(ODD)
