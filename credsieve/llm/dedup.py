"""Exact dedup by skew-safe combining; DataFrame functions only."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh

#: The rows of a text are combined under at least so many salts.
SALTS = 32
#: A text is hot from so many rows on, or 1 / MOST_HOT of the table: no more texts than that can be, which bounds what is broadcast.
HOT_ROWS, MOST_HOT = 1 << 10, 1 << 16


def salts_for(rows: int) -> int:
    """So many salts that neither a salt's share of the rows nor the number of salt winners of one text grows faster than the root of the table."""
    return max(SALTS, math.isqrt(rows // 64))


def normalised(text: Column) -> Column:
    """A-Z become lower case, nothing else changes; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _by_heat(rows: DataFrame, digest: str, salts: int | None, hot_rows: int | None) -> tuple[DataFrame, DataFrame, int]:
    """rows with cool and with hot digests (see HOT_ROWS), and the number of salts; the hot digests are a broadcast of bounded size."""
    n = rows.count()
    hot_rows = hot_rows or max(HOT_ROWS, n // MOST_HOT)
    (own,) = fresh(rows, "hot_digest")
    hot = F.broadcast(cut(rows.groupBy(F.col(digest).alias(own)).agg(F.count("*").alias("_n")).filter(F.col("_n") >= hot_rows).select(own)))
    few, many = (rows.join(hot, F.col(digest) == F.col(own), how) for how in ("left_anti", "left_semi"))
    return few, many, salts or salts_for(n)


def _combined(rows: DataFrame, salts: int) -> DataFrame:
    """doc_id, digest, _mark, _text -> keep_id and group_size of each text: inside each task, per salt, then over the salts."""
    by = ["digest", "_mark", "_text"]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).groupBy(*by, "_salt").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return salted.groupBy(*by).agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest=sha256, salts: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest.

    All rows are combined by digest and full content in three stages: inside each task (Spark's partial aggregation), per
    salt of a digest, then over the salts. The row with the largest id stays; of repeated rows with that id exactly one is
    marked kept. Rows find their group again by digest and a second hash, and by content too where two texts share both.
    Only in this last step does heat matter: rows of hot digests (see HOT_ROWS), which no task could take alone, stay where
    they are and get their group by a broadcast of bounded size.

    Nulls: a null text is an empty text, and a null id sorts below all others (a group of null ids keeps one of them).
    Texts of any length are compared whole. An empty table gives an empty result. Other columns are ignored, whatever
    their names.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("_text"))
    rows = texts.withColumns({"digest": digest(F.col("_text")), "_mark": F.xxhash64("_text")})
    n = rows.count()
    by = ["digest", "_mark", "_text"]
    merged = _combined(rows, salts or salts_for(n))
    groups, own, on = cut(merged.drop("_text")), cut(rows.drop("_text")), by[:2]
    if not groups.groupBy(*on).count().filter("count > 1").isEmpty():  # one digest and second hash, several texts: content decides
        groups, own, on = cut(merged), rows, by
    told = groups.groupBy(F.col("digest").alias("_hot")).agg(F.sum("group_size").alias("_n")).filter(F.col("_n") >= (hot_rows or max(HOT_ROWS, n // MOST_HOT)))
    hot = F.broadcast(cut(told.select("_hot")))

    def found(how: str) -> DataFrame:
        rows_of, groups_of = (t.join(hot, F.col("digest") == F.col("_hot"), how) for t in (own, groups))
        twin = Window.partitionBy("digest", "_mark", "doc_id").orderBy("keep_id")
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(twin) == 1)
        few = how == "left_semi" and on == by[:2]
        joined = rows_of.join(F.broadcast(groups_of) if few else groups_of, on).select("doc_id", "keep_id", "group_size", "digest", "_mark")
        return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")

    return found("left_anti").union(found("left_semi"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest=sha256, salts: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """docs without the rows that exact_groups drops; all columns stay, whatever their names.

    Whole rows are shuffled once at most. Hot digests are combined as in exact_groups, and their rows stay where they are:
    the winners are a broadcast of bounded size. Rows of a cool digest, fewer than a hot one has, meet in one task, where
    full contents are compared and the last row of each text stays.

    Repeated rows (equal id and text) leave one. Null and empty texts are one group, of which the row with the largest id
    stays (null ids sort first). Texts of any length are compared whole. An empty table gives an empty result.
    """
    own, mark, text, place = fresh(docs, "digest_of", "mark_of", "text_of", "place_of")
    plain = normalised(F.col(text_col))
    few, many, salts = _by_heat(docs.withColumns({own: digest(plain), mark: F.xxhash64(plain)}), own, salts, hot_rows)
    same = Window.partitionBy(own, mark, text).orderBy(F.col(id_col).desc_nulls_last())
    cool = few.repartition(own).withColumn(text, plain).withColumn(place, F.row_number().over(same)).filter(F.col(place) == 1).drop(text, place)

    names = {id_col: "doc_id", own: "digest", mark: "_mark"}
    merged = _combined(many.select(*[F.col(c).alias(to) for c, to in names.items()], plain.alias("_text")), salts)
    best, keys = cut(merged.drop("group_size")), [own, mark]
    if not best.groupBy("digest", "_mark").count().filter("count > 1").isEmpty():  # one digest and second hash, several texts: content decides
        keys.append(text)
    slim = best.select(F.col("keep_id").alias(place), *[F.col(c).alias(f"{place}_{k}") for k, c in enumerate(("digest", "_mark", "_text")[: len(keys)])])
    on = F.col(id_col).eqNullSafe(F.col(place))
    for k, c in enumerate(keys):
        on &= F.col(c) == F.col(f"{place}_{k}")
    slim = F.broadcast(slim) if len(keys) == 2 else slim
    hot = many.withColumn(text, plain).join(slim, on, "left_semi").dropDuplicates([id_col, *keys]).drop(text)
    return cool.union(hot).drop(own, mark)
