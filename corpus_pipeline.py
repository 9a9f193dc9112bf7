"""A corpus pipeline of five stages, each one of the text operators.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of
``documents``; the last returns the encoded documents.  ``run`` applies them to ``documents`` and
writes each stage's result to the shared folder before the next begins, so a lost executor repeats
one stage at most.

For all stages: nulls in any column are kept as they are; a null or empty text is kept by every stage
that filters; a row without a doc_id is a document of its own, which loses nothing to others.  Decisions
are joined by doc_id and text, so rows that repeat a doc_id with other texts each have their own.
Further columns pass through, whatever their names.  An empty table gives an empty one.  Ties are
decided by the operators, on doc_id and text alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelry.llm import langid, toxicity
from panelry.llm.common import settled
from panelry.llm.decontam import found_items
from panelry.llm.neardup import near_duplicates
from panelry.llm.pieces import decoded, encoded
from panelry.llm.windowdedup import repeated_windows


def _free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _packed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, hash): whole rows beside the keys of decisions, so that no column can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; the model learns from the labels that are not held out.

    Null and empty texts are never rejected.  Rows that repeat get the same score.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~langid.held_out())
    score = _free_name(docs, "_toxicity")
    scored = toxicity.scored(docs, toxicity.train(docs, labels), score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Every document without a doc_id or without words stays.  Of rows that repeat a doc_id inside one group, the
    text with the smallest hash stays, and of rows that repeat doc_id and text one.
    """
    found = settled(near_duplicates(docs).where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "hash", "group", "kept"), "decisions")
    gone = found.where("NOT kept").select("doc_id", "hash")
    by = found.where("kept").groupBy("doc_id", "group").agg(F.min("hash").alias("low"), F.max("hash").alias("high"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = gone.unionByName(found.where("kept").join(by.where("low <> high"), ["doc_id", "group"]).where("hash <> low").select("doc_id", "hash"))
    left = _packed(docs).join(gone.distinct(), ["doc_id", "hash"], "left_anti")
    again = by.select("doc_id", F.col("low").alias("hash")).distinct()
    once = left.join(again, ["doc_id", "hash"], "left_semi").dropDuplicates(["doc_id", "hash"])
    return left.join(again, ["doc_id", "hash"], "left_anti").unionByName(once).select("row.*")


def cut_repeated_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word windows that start in a smaller document too.

    A text that loses nothing stays as it is, with its own white space; of the others the kept words
    are joined by one space, and n_chars is counted again.  Every row stays.
    """
    lost = repeated_windows(docs).where(F.size("removed") > 0)
    lost = lost.select("doc_id", F.xxhash64("text").alias("hash"), "kept").dropDuplicates(["doc_id", "hash"])
    joined = _packed(docs).join(lost, ["doc_id", "hash"], "left")
    new = F.col("row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType))
    return joined.select(F.when(F.col("kept").isNull(), F.col("row")).otherwise(new).alias("row")).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item; null and empty texts contain none."""
    items = _free_name(docs, "_items")
    found = found_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), items)
    return found.where(F.size(items) == 0).select(*[f"`{c}`" for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the sampled piece ids, their CRC-32, and the digest of the text that they decode to.

    A null text gives nulls.  Rows that repeat doc_id and text give the same pieces.
    """
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = decoded(encoded(docs.select("doc_id", "text"), path).select("doc_id", "pieces"), path)
    return out.select("doc_id", "pieces", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_windows", cut_repeated_windows),
    ("decontamination", drop_contaminated),
    ("pieces", encode_pieces),
]

#: A trained classifier and sampled pieces have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
