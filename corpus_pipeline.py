"""A training corpus from raw documents: five stages, each on all that its predecessor kept.

Defined results: null and empty texts pass every filter that finds nothing in them; rows with a null doc_id take part
in all stages; rows that repeat are duplicates of each other, of which one stays; extra columns are carried along
whatever their names (columns that begin with "__stage_" excepted); empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import bagminhash, decontamination, packing, pii, quality_mil
from panelforge.llm.common import drop, read, text_key, text_of, written

KEY = "__stage_key"


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    score = quality_mil.quality_score(spark, quality_mil.train(docs, read(spark, sf_dir, "labels")))
    return docs.where(score(text_of()) >= quality_mil.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the least doc_id stays; of rows that repeat it, one."""
    members, _ = bagminhash.near_duplicate_classes(docs)
    keep = bagminhash.keepers(members).select(F.col("tk").alias(KEY), F.col("doc_id").alias("__stage_id"))
    rows = docs.withColumn(KEY, text_key())
    kept = rows.join(keep, rows[KEY].eqNullSafe(keep[KEY]) & rows["doc_id"].eqNullSafe(keep["__stage_id"])).select(rows["*"])
    return kept.dropDuplicates([KEY, "doc_id"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    keyed = docs.withColumn(KEY, F.xxhash64("doc_id", text_of()))
    found = decontamination.find_contained(keyed.select(KEY, "text"), read(spark, sf_dir, "benchmark"), doc_id=KEY)
    found = written(found.select(KEY).distinct(), "contaminated")
    return keyed.join(found, KEY, "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows the text."""
    clean = pii.redact(spark, pii.fit(docs))
    out = docs.withColumn("text", clean(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = packing.tokenized_pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_windows),
]
#: A trained classifier decides in the first stage, so no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote goes when the next one is written."""
    docs, held = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", new := [])
        drop(spark, held)
        held = new
    return docs
