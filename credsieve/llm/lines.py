"""Line dedup: lines that several documents hold stay in one; DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: What counts as white space at a line's ends: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), string.ascii_uppercase, string.ascii_lowercase)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, text (the lines that stay, joined by line feeds), n_lines (before), n_dropped.

    A line whose key (see line_key) has at least min_chars characters and is found in at least min_docs documents goes, but
    for the document with the smallest id that holds it, where all its lines stay. Lines are exploded once, as SHA-256 of
    key with id, digest of the text and position: texts aren't shuffled with them. Documents are counted per digest after
    each task and then each (digest, id) has been reduced to one row, so that a line that all documents hold is no single
    task's work; the join back to the lines is one that Spark splits where a line is common. Texts are shuffled once, to meet
    the positions that they lose.

    A document is an id: rows that share one count once, and a null id is one that comes after all others. A null or empty
    text is one empty line. Lines and texts of any length are kept whole. Repeated rows are treated alike; an empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("_text_key", _digest(F.col("text")))
    at = own.select("doc_id", "_text_key", F.posexplode(F.split("text", "\n", -1)).alias("_place", "_line"))
    keyed = at.select("doc_id", "_text_key", "_place", line_key(F.col("_line")).alias("_key")).filter(F.length("_key") >= min_chars)
    lines = cut(keyed.select("doc_id", "_text_key", "_place", _digest(F.col("_key")).alias("_hash")))

    holders = lines.select("_hash", "doc_id").distinct()
    common = holders.groupBy("_hash").agg(F.count("*").alias("_docs"), F.min("doc_id").alias("_first")).filter(F.col("_docs") >= min_docs).select("_hash", "_first")
    lost = lines.join(common, "_hash").filter(~F.col("doc_id").eqNullSafe(F.col("_first"))).select(F.col("doc_id").alias("_id"), F.col("_text_key").alias("_of"), "_place")
    places = lost.groupBy("_id", "_of").agg(F.collect_set("_place").alias("_gone"))

    met = own.join(places, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_of")), "left")
    parts = met.select("doc_id", "text", "_gone", F.split("text", "\n", -1).alias("_parts"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_gone"))
    left = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_parts", i)), "\n"))
    return parts.select("doc_id", left.alias("text"), F.size("_parts").cast("long").alias("n_lines"), F.coalesce(F.array_size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))
