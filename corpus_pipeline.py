"""From raw documents to packed training sequences, in five stages.

STAGES: (name, function of (spark, docs, sf_dir)). Each function works on what its predecessor kept; all but the last
return the columns of documents. run(spark, sf_dir) applies them to the documents table.

Tables may have further columns of any name, which all stages but the last carry along; an empty table gives an empty
result. What becomes of nulls, empty and very long texts, ties and repeated rows is stated at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from credsieve.llm import dedup, jaccard, mixing, packing, quality
from credsieve.llm.common import crc_mod, cut, table
from credsieve.llm.queries import THRESHOLD


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Attention-based quality classifier: documents that it rejects go.

    Learned from labels whose crc32 of the id mod 5 is not 0. Null and empty texts are scored as an empty passage, very
    long ones passage by passage; a score of exactly the threshold stays; equal texts stay or go together.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0), THRESHOLD)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the document with the largest id stays.

    Null and empty texts are equal, null ids sort first, and repeated rows (equal id and text) leave one. Texts of any
    length are compared whole.
    """
    return dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each class stays, that with the smallest id.

    Null ids come last, ties go to the least hash of the text, and repeated rows leave one. Texts without words (null and
    empty ones too) have no near copies and stay. Texts of any length are compared whole.
    """
    return jaccard.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to target weights: documents come so often as the mix takes them.

    A null source is one of its own; a null id is a value like others. Documents without words (null and empty texts too)
    are never taken and so go. A document that a block's end cuts comes with the words that are taken. Repeated rows come
    each so often as the one that is taken most.
    """
    return mixing.remix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 1024 tokens: the columns of packing.pack.

    A null or empty text is its end token alone; a longer text than a sequence is cut into pieces. Repeated rows are packed
    each.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", good_documents),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mix", mixed),
    ("pack", packed),
]

#: The trained classifier and the seeded hashes can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents table of a folder; what the stages before it keep is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
