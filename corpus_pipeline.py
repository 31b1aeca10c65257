"""From raw documents to packed token sequences: toxicity, near duplicates, personal data, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import minhash, packing, pii, toxicity
from tallywright.llm._store import materialize
from tallywright.llm.queries import CONTEXT, WORD_BPE
from tallywright.shipping import ship

#: A column of spans that no documents table has.
SPANS = "__personal_data_spans"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models, fitted on this stage's documents with labels, don't reject.

    Rows with null or empty texts have no evidence and stay, as do rows without
    doc_id that don't score as toxic; repeated rows go or stay together, and equal texts
    (ties) have equal scores. Texts of any length are scored whole. Without
    labels of both classes, or documents, all rows stay. All columns pass through.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    return docs.where(toxicity.flag(docs, model) == 0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates; of rows with one id all stay or none.

    Rows without doc_id, and documents without words, stay. Of equal texts, the
    smallest id's stays. Rows whose doc_id has different texts can't be told apart by
    it: all of them stay, and nothing goes for their sake, so no text is lost. Texts of any length are
    compared whole. All columns pass through; an empty table gives none.
    """
    rows = ship(spark) and docs.select("doc_id", "text")
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b")
    several = minhash.small_side(materialize(several.select("doc_id"), "several"))
    found = minhash.near_duplicates(rows.join(several, "doc_id", "left_anti"))
    gone = materialize(found.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(minhash.small_side(gone), "doc_id", "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked and n_chars counted anew.

    Null texts stay null, with n_chars null; every row and column stays, one
    named pii too; repeated rows are masked alike, and texts of any length whole.
    """
    masked = pii.mask_pii(pii.find_pii(docs, out=SPANS), pii=SPANS)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the sequences.

    Null and empty texts are one piece, their end id; rows without doc_id and
    repeated rows have pieces of their own; texts of any length are cut, none is
    shortened; ties in length go by doc_id and piece; other columns are left out.
    """
    pieces = packing.cut_pieces(ship(spark) and docs, public_tokenizers.path(WORD_BPE), limit=CONTEXT)
    return packing.pack_pieces(pieces, CONTEXT)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: Tokenizers, models and sketches are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
