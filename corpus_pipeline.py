"""A training-data pipeline of five stages over ``documents``; each calls one operator of corvane.llm.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as Parquet
to the shared folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import minhash_dedup, mixing, packing, quality, secrets
from corvane.llm._common import cut, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are scored like others; very long texts are scored whole; equal texts share their fate, so repeated
    rows stay or go together; without labels every document has one score and all stay or all go (0.5: all stay).  All columns
    are kept, whatever their names; an empty table stays empty.
    """
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8), the one with the smallest id.

    Rows equal in id and text are one; texts without a word (null, empty, blank) are never near anything and stay, one row of
    each id and text, all where the id is null; rows without an id stay only where no row with an id resembles them.  Very long
    texts are compared whole.  All columns are kept; an empty table stays empty.
    """
    found = minhash_dedup.near_duplicates(docs)
    return minhash_dedup.keep_one(docs, found)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark.

    Null and empty texts stay as they are; very long texts are scanned whole; repeated rows get the same marks; all rows
    and columns are kept, null ids too; an empty table stays empty.
    """
    return secrets.redact(docs, secrets.train(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights.

    Texts without a word have no size and are left out; a null source is a source of its own, the last; a very long text is one
    document, its last copy may be cut; repeated rows are drawn each by itself, rows without an id too.  All columns are kept, also
    such as ``taken`` or ``nth``; an empty table stays empty.
    """
    return mixing.resample(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left: pieces with their ids and their place in a sequence.

    Null and empty texts are one closing id; very long texts are cut over as many sequences as they need; each row, also a
    repeated one or one without an id, is packed by itself.  Columns other than the id and the text end here; an empty table gives no
    pieces.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", dedup_stage),
    ("secret_scans", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage writes besides its result is deleted once that is stored."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark):
            docs = cut(stage(spark, docs, sf_dir), part="")
    return docs


QUERIES = {"pipeline": run}
