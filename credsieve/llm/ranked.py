"""Ranked lexical search: short posting lists term at a time, then one bounded iterator of their sums beside the long lists, document at a time."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: A shard has about so many postings; a pass over the texts looks for about so many terms; a block has about so many query terms.
SHARD_POSTINGS, PASS_TERMS, BLOCK_TERMS = 1 << 19, 1 << 18, 1 << 20
#: Documents that are bounded together, and the part of a shard's documents up to which a list is short.
WINDOW, SHORT = 64, 1 / 16
#: Lists that are probed between two looks at who is still competitive.
PROBE = 8

_TERM = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of letters and digits of ASCII and of characters beyond it, A-Z in lower case, in UTF-8."""
    return text.encode().lower().translate(_TERM).split()


def _counted(texts: DataFrame, carried: list[str]) -> DataFrame:
    """carried columns, term, times of the different terms of each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b["text"].to_pylist()):
                found = Counter(terms_of(text))
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(np.full(len(found), i))) for c in b.columns[:-1]], pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], [*carried, "term", "times"])

    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in carried)
    return texts.select(*carried, "text").mapInArrow(count, f"{kinds}, term string, times long")


def _postings(texts: DataFrame, wanted: list[str], numbers: list[int]) -> DataFrame:
    """_row, doc_id, n (all terms with repeats) and the wanted terms' numbers and times, for every text with a term."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = dict(zip([w.encode() for w in wanted], numbers))
        for b in batches:
            at, total, terms, times = [], [], [], []
            for i, text in enumerate(b["text"].to_pylist()):
                if own := terms_of(text):
                    met = Counter(map(number.get, own))
                    met.pop(None, None)
                    at.append(i)
                    total.append(len(own))
                    terms.append(list(met))
                    times.append(list(met.values()))
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b["_row"].take(where), b["doc_id"].take(where), pa.array(total, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["_row", "doc_id", "n", "terms", "times"])

    return texts.mapInArrow(search, f"_row long, doc_id {texts.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, times array<long>")


class Shard:
    """Posting lists of some documents, numbered in the order in which ties are settled.

    Lists of at most SHORT of the documents are short: document numbers and impacts. The others are long: impacts by
    document, 0 where the term isn't, with their maximum in every window of WINDOW documents. read counts the impacts that
    searches have looked up.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n: int, short: float = SHORT, window: int = WINDOW):
        order = np.lexsort((doc, term))
        doc, term, impact = doc[order], term[order], impact[order]
        self.n, self.window, self.read = n, window, 0
        names, first = np.unique(term, return_index=True)
        last = np.append(first[1:], len(term))
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.long: dict[int, int] = {}
        for t, i, j in zip(names.tolist(), first.tolist(), last.tolist()):
            if j - i <= short * n:
                self.short[t] = doc[i:j], impact[i:j]
            else:
                self.long[t] = len(self.long)
        is_long = np.isin(term, np.array(list(self.long), term.dtype))
        self.impact = np.zeros((len(self.long), -(-n // window) * window), np.int64)
        if self.long:
            of = np.searchsorted(np.array(sorted(self.long), term.dtype), term[is_long])
            self.impact[of, doc[is_long]] = impact[is_long]
        self.most = self.impact.reshape(len(self.long), -1, window).max(2, initial=0)

    def top(self, terms: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k best documents with a score above 0, ties to the smaller number."""
        # term at a time: short lists become sums, one iterator with a bound in every window
        summed = np.zeros(self.impact.shape[1], np.int64)
        listed = [(self.long[t], w) for t, w in zip(terms.tolist(), weight.tolist()) if t in self.long]
        for t, w in zip(terms.tolist(), weight.tolist()):
            if t in self.short:
                at, impact = self.short[t]
                summed[at] += w * impact
                self.read += len(at)
        own = summed.reshape(-1, self.window)
        lists, factor = (np.array(x, np.int64) for x in zip(*listed)) if listed else (np.zeros(0, np.int64),) * 2
        bound = self.most[lists] * factor[:, None]  # of each long list in each window
        total = bound.sum(0) + own.max(1, initial=0)
        least = np.partition(summed, -k)[-k] if len(summed) > k else 0  # sums alone are scores at least so high
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # document at a time, a window after the other; one that can't reach the k-th score is skipped in all lists
        for w in np.flatnonzero((total >= least) & (total > 0)).tolist():
            if total[w] < least:
                continue
            part, start = own[w], w * self.window
            order = np.argsort(-bound[:, w], kind="stable")
            rest = np.append(np.cumsum(bound[order, w][::-1])[::-1], 0)  # what the lists from a place on can add
            alive, score = np.arange(self.window), part.copy()
            for at in range(0, len(order), PROBE):
                if rest[at] == 0:
                    break
                now = order[at : at + PROBE]
                score = score + factor[now] @ self.impact[lists[now, None], start + alive]
                self.read += len(now) * len(alive)
                keep = score + rest[min(at + PROBE, len(order))] >= max(least, 1)
                if not keep.all():
                    alive, score = alive[keep], score[keep]
                    if not len(alive):
                        break
            keep = score >= max(least, 1)
            docs, scores = np.append(docs, start + alive[keep]), np.append(scores, score[keep])
            if len(docs) > k:
                best = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[best], scores[best]
                least = max(least, scores[-1])
        best = np.lexsort((docs, -scores))[:k]
        return docs[best], scores[best]


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", k: int = 10, *, shard_postings: int = SHARD_POSTINGS, pass_terms: int = PASS_TERMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k highest-scoring documents with a score above 0.

    N is the number of texts with a term, L all their terms with repeats, n those of one text, df a term's texts, tf its
    occurrences in one. A term weighs w = floor(1000 ln((2N + 2) / (2df + 1))); a text's m is 25 + 75nN div L; the score sums
    w * (1000000000 tf div (1000 tf + 8m)) over the item's terms, repeats too. All but w is in 64-bit integers, so that bounds
    and results are exact.

    Only the items' terms get postings: the texts are read once for every ``pass_terms`` of them, so that what a task
    is sent is bounded. Documents are dealt into shards of about ``shard_postings`` postings by hash of the row; a shard's
    lists are built once and searched for all items of a block of about ``block_terms`` terms: see Shard. Shards return k rows an item
    at most, which are merged by item.

    Null texts have no terms. A null id is an id above all others; repeated rows each take a rank; of repeated item ids the
    least text counts, and a null item id is one like others. Very long texts are counted whole. Ties go to the smaller id.
    Empty tables give an empty result. Other columns are ignored, whatever their names.
    """
    spark, texts = docs.sparkSession, docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(query_col), F.lit("")).alias("text")).groupBy("item_id").agg(F.min("text").alias("text"))
    asked = cut(_counted(asked, ["item_id"]).withColumnRenamed("times", "repeats"))
    terms = asked.select("term").distinct()
    passes = max(1, -(-terms.count() // pass_terms))
    terms = cut(terms.select("term", F.pmod(F.xxhash64("term"), F.lit(passes)).alias("_pass"), F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("term"), F.lit(passes))).orderBy("term")).alias("_in")))
    found: DataFrame | None = None
    for p in range(passes):  # each pass has about pass_terms terms
        own = terms.filter(F.col("_pass") == p).select("term", "_in").collect()
        part = cut(_postings(texts, [r["term"] for r in own], [r["_in"] * passes + p for r in own]))
        found = part if found is None else found.unionByName(part)

    n_docs, n_terms = (int(x or 0) for x in part.agg(F.count("*"), F.sum("n")).first())
    kind = found.schema["doc_id"].dataType.simpleString()
    out = f"item_id {asked.schema['item_id'].dataType.simpleString()}, doc_id {kind}, score long"
    if not n_docs:
        return spark.createDataFrame([], out).withColumn("rank", F.lit(0)).select("item_id", "rank", "doc_id", "score")
    df = found.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    numbered = terms.select("term", (F.col("_in") * passes + F.col("_pass")).cast("int").alias("number"))
    weighed = asked.join(numbered, "term").join(df, "number").withColumn("weight", F.col("repeats") * weight).filter("weight > 0")
    queries = cut(weighed.groupBy("item_id").agg(F.collect_list("number").alias("terms"), F.collect_list("weight").alias("weights")))
    n_asked, n_postings = (int(x or 0) for x in (queries.agg(F.sum(F.size("terms"))).first()[0], found.agg(F.sum(F.size("terms"))).first()[0]))
    shards, blocks = max(1, -(-n_postings // shard_postings)), max(1, -(-n_asked // block_terms))
    dealt = found.filter(F.size("terms") > 0).withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int"))

    def search(q: pa.Table, d: pa.Table) -> pa.Table:
        q, d = q.combine_chunks(), d.combine_chunks()
        item, doc, score = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        rows = d.group_by("_row").aggregate([("doc_id", "max")]).sort_by([("doc_id_max", "ascending"), ("_row", "ascending")])  # nulls come last
        if len(q) and len(d):
            known = rows["_row"].to_numpy()
            by_row = np.argsort(known)  # rows of one text are one document, so that passes over the texts meet again
            place = by_row[np.searchsorted(known, d["_row"].to_numpy(), sorter=by_row)]
            size = pc.list_value_length(d["terms"]).to_numpy()
            tf, n = pc.list_flatten(d["times"]).to_numpy(), np.repeat(d["n"].to_numpy(), size)
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * n * n_docs // n_terms))
            shard = Shard(np.repeat(place, size), pc.list_flatten(d["terms"]).to_numpy(), impact, len(rows))
            for i, (t, w) in enumerate(zip(q["terms"], q["weights"])):
                at, s = shard.top(t.values.to_numpy(), w.values.to_numpy(), k)
                item += [i] * len(at)
                doc.append(at)
                score.append(s)
        return pa.table({"item_id": q["item_id"].take(pa.array(item, pa.int64())), "doc_id": rows["doc_id_max"].take(pa.array(np.concatenate(doc))), "score": np.concatenate(score)})

    best: DataFrame | None = None
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        got = block.groupBy("_shard").cogroup(dealt.groupBy("_shard")).applyInArrow(search, out)
        best = got if best is None else best.union(got)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
