"""Exact top-k inner-product search with MaxScore over sharded postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

SHARD_ROWS = BLOCK_ROWS = 8192
#: Each round searches so many times the shards of all rounds before it.
ROUND = 7
#: Terms that are probed between two looks at who is still competitive.
PROBE = 8
#: Stands for no threshold.
NONE = -(1 << 63)


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of each component, x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * 256.0).cast("long"))


def usable(embedding: Column) -> Column:
    """False for null vectors and those that hold null, NaN or infinite components."""
    return F.coalesce(F.forall(embedding, lambda x: F.coalesce(x.cast("double").between(-1.7976931348623157e308, 1.7976931348623157e308) & ~F.isnan(x.cast("double")), F.lit(False))), F.lit(False))


def matrix(values: pd.Series, width: int) -> np.ndarray:
    """Vectors of fewer components are filled up with zeros."""
    out = np.zeros((len(values), width), np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


class Postings:
    """One shard. A term is a dimension with a sign. Its postings are the rows whose component has that sign, those with the largest first, and its bound is that of the first one.

    read counts the postings that searches have traversed.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.columns = np.ascontiguousarray(self.rows.T)
        self.high, self.low = self.columns.max(1, initial=0), self.columns.min(1, initial=0)
        self.by_impact = np.argsort(-self.columns, axis=1, kind="stable").astype(np.int32)  # of the positive term; the negative one's from the end
        self.sorted = -np.take_along_axis(self.columns, self.by_impact, 1)  # rising
        self.read = 0

    def postings(self, t: int, sign: int, least: float) -> np.ndarray:
        """Rows whose component of dimension t has this sign and at least this size."""
        n = len(self.ids)
        if sign > 0:
            return self.by_impact[t, : np.searchsorted(self.sorted[t], min(-least, -0.5), side="right")]
        return self.by_impact[t, np.searchsorted(self.sorted[t], max(least, 0.5), side="left") : n][::-1]

    def top(self, q: np.ndarray, own: int, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best rows for q, ties to the smaller id; rows below floor may be left out. Bounds, and so the result, are exact."""
        bound = np.maximum(0, np.maximum(q * self.high, q * self.low))
        terms = np.argsort(-bound, kind="stable")
        terms = terms[q[terms] != 0]
        rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # what the terms from i on can add at most
        other = np.flatnonzero(self.ids != own)
        if len(other) <= k or not len(terms):
            score = self.rows[other] @ q
        else:
            # rows that are strongest in the strongest term give a threshold, unless earlier shards gave a better one
            lead = self.postings(terms[0], int(np.sign(q[terms[0]])), 0)[: 4 * k]
            lead = lead[self.ids[lead] != own]
            least = np.sort(self.rows[lead] @ q)[-k] if len(lead) >= k else None
            least = floor if least is None else least if floor is None else max(least, floor)
            if least is not None and least > 0:
                # the non-essential terms can't reach the threshold together, so a row must get the missing part from an
                # essential one: from one of them at least as much as its bound's share of that part
                essential = max(1, int(np.searchsorted(-rest, -least, side="right")))
                part = (least - (rest[essential] if essential < len(rest) else 0)) / max(rest[0] - rest[min(essential, len(terms))], 1)
                alive = np.zeros(len(self.ids), bool)
                for t in terms[:essential]:
                    found = self.postings(t, int(np.sign(q[t])), part * bound[t] / abs(q[t]) - 1e-6)
                    alive[found] = True
                    self.read += len(found)
                alive[self.ids == own] = False
                other = np.flatnonzero(alive)
            score = np.zeros(len(other), np.int64)
            for at in range(0, len(terms), PROBE):  # essential terms first, then the others while a row is competitive
                now = terms[at : at + PROBE]
                score += q[now] @ self.columns[now[:, None], other]
                if least is not None:
                    keep = score + rest[min(at + PROBE, len(terms))] >= least
                    if not keep.all():
                        other, score = other[keep], score[keep]
        best = np.lexsort((self.ids[other], -score))[:k]
        return other[best], score[best]


def maxscore_topk(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, *, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k highest integer inner products with all other rows.

    Vectors are dealt into shards of at most about shard_rows by hash, queries into blocks of about block_rows; each pair
    of a block and a shard is one task's group. The shards are searched in rounds: the first has one, each other one
    ROUND times as many as came before. After a round the shards are merged, and a query's k-th score is the threshold
    that it takes to the next, so that shards return what can still be among the best and not k rows each.

    Vectors that are null or hold null or non-finite components take no part; shorter ones, however short, count as
    filled with zeros. Rows with the query's id are its own. Repeated candidate rows each take a rank; a repeated query id
    is one query (its smallest vector). Null ids take no part. Ties go to the smaller id. Fewer than k others give fewer
    rows; an empty table gives none. Other columns are ignored, whatever their names.
    """
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"), is_query.alias("asks"))
    clean = cut(own.filter(F.col("id").isNotNull() & usable(F.col("x"))).select("id", quantised(F.col("x")).alias("v"), F.coalesce("asks", F.lit(False)).alias("asks")))
    n, m, width = (int(x or 0) for x in clean.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v"))).first())
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))
    dealt = clean.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("s"), "id", "v")
    queries = clean.filter("asks").groupBy("id").agg(F.min("v").alias("v")).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(q) and len(c):
            shard = Postings(c["id"].to_numpy(), matrix(c["v"], width))
            floors = [None if x == NONE else int(x) for x in q["floor"]]
            for own, v, floor in zip(q["query_id"].to_numpy(), matrix(q["q"], width), floors, strict=True):
                at, score = shard.top(v, own, k, floor)
                out.append(pd.DataFrame({"query_id": own, "vec_id": shard.ids[at], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    best: DataFrame | None = None
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    for first, last in rounds(shards):
        asked = queries.withColumn("floor", F.lit(None).cast("long"))
        if best is not None:
            floors = best.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
            asked = queries.join(floors, "id", "left")
        asked = asked.select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.coalesce("floor", F.lit(NONE)).alias("floor"), "b", F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("s"))
        rows = dealt.filter(F.col("s").between(first, last - 1)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = asked.groupBy("s", "b").cogroup(rows.groupBy("s", "b")).applyInPandas(search, "query_id long, vec_id long, score long")
        merged = found if best is None else best.drop("rank").union(found)
        best = merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")
        if last < shards:
            best = cut(best)
    return best.select("query_id", "rank", "vec_id", "score")


def rounds(shards: int) -> Iterator[tuple[int, int]]:
    """From and to of the shards of each round."""
    first, last = 0, 1
    while first < shards:
        yield first, min(last, shards)
        first, last = last, last * (ROUND + 1)
