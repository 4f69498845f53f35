"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: A source is laid out in buckets of about so many words or rows, whichever makes more buckets; their places are summed in runs of FAN buckets.
BUCKET_WORDS, BUCKET_ROWS, FAN = 1 << 16, 1 << 12, 1024
BLOCK_WORDS = 256
LEAST_BLOCKS = 1 << 16


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size) -> also weight, target. Sources take the weights in turn, by code point, null last.

    The targets share budget x all sizes by weight; none exceeds most x its source's size, and what is over goes to the
    others by weight until none is above. With sources in order of cap per weight that is one running sum: the first k
    are at their caps and the rest share by weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    fill = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy(F.lit(0))
    done = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(budget) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(done), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(done), F.lit(0.0))
    )
    return (
        sizes.withColumn("weight", w)
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_level", level)
        .withColumn("_open", F.col("_cap") / F.col("weight") > F.col("_level"))
        # the level of the first source that stays below its cap holds for all after it
        .withColumn("_from", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("_level").alias("lv")))).over(everything))
        .withColumn("target", F.when(F.col("_open"), F.least(F.col("_cap"), F.col("weight") * F.col("_from.lv"))).otherwise(F.col("_cap")))
        .drop("_cap", "_level", "_open", "_from")
    )


def apportion(parties: DataFrame, seats: int, key: str = "source", votes: str = "target") -> DataFrame:
    """Adds quota: so many of ``seats`` seats for each party as Sainte-Laguë's highest quotients votes / (2k + 1) give.

    Seats near each party's exact share are settled at once; only quotients within what rounding can move compete, a
    number in proportion to the parties. Ties go to the key's order, null last. Parties without votes get none.
    """
    kept = parties.columns
    return _houses(parties, [max(0, seats)], key, votes).select(*kept, "quota")


def shard_quotas(parties: DataFrame, seats: int, shards: int, key: str = "source", votes: str = "target") -> DataFrame:
    """Adds shard and quota, a row for each party and shard: the seats in order of their quotients fill the shards one after another.

    Sainte-Laguë never takes a seat back when the house grows, so a shard's quota is what the party has of all seats up
    to the shard's last, less what it has of those before.
    """
    ends = [max(0, seats) * (i + 1) // shards for i in range(shards)]
    kept = parties.columns
    before = Window.partitionBy(key).orderBy("_house")
    return _houses(parties, ends, key, votes).select(*kept, F.col("_house").alias("shard"), (F.col("quota") - F.coalesce(F.lag("quota").over(before), F.lit(0))).alias("quota"))


def _houses(parties: DataFrame, houses: Sequence[int], key: str, votes: str) -> DataFrame:
    """parties for each house, with _house, its number, and quota: see apportion."""
    everything = Window.partitionBy("_house")
    total, n = F.sum(votes).over(everything), F.count("*").over(everything)
    seats = F.col("_seats")
    near = (
        parties.select("*", F.posexplode(F.array(*[F.lit(x).cast("long") for x in houses])).alias("_house", "_seats"))
        .withColumn("_share", F.coalesce(F.try_divide(F.col(votes), total), F.lit(0.0)))
        .withColumn("_slack", F.ceil(2 * n * F.col("_share")) + 2)
        .withColumn("_low", F.greatest(F.lit(0), F.floor(F.col("_share") * seats) - F.col("_slack")).cast("long"))
        .withColumn("_high", (F.floor(F.col("_share") * seats) + F.col("_slack")).cast("long"))
        .withColumn("_left", seats - F.sum("_low").over(everything))
    )
    rivals = near.filter(F.col(votes) > 0).select(key, votes, "_house", "_left", F.explode(F.sequence(F.col("_low"), F.col("_high"))).alias("_k"))
    rank = F.row_number().over(Window.partitionBy("_house").orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), F.col(key).isNull(), F.col(key), F.col("_k")))
    won = rivals.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_left")).groupBy(F.col(key).alias("_key"), F.col("_house").alias("_h")).agg(F.count("*").alias("_won"))
    quota = F.when(F.col(votes) > 0, F.col("_low") + F.coalesce("_won", F.lit(0))).otherwise(0).cast("long")
    return near.join(won, near[key].eqNullSafe(won["_key"]) & (near["_house"] == won["_h"]), "left").select(*parties.columns, "_house", quota.alias("quota"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[int] = WEIGHTS, budget: float = 1.5, most: float = 2.0, seed: int = 17, shards: int = 8) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, whole, part_from, part_to, shard.

    Each source's documents lie end to end in seeded order and are cut into blocks of equal numbers of words. All blocks
    of the mix are apportioned among the sources and shards by target (shard_quotas), which gives each source an integer
    quota in each shard. A source's quota takes all its blocks so often as it can, then one seeded run of neighbouring
    blocks (a random sample, as the order is random). Its shards take their quotas of these one after another, each block
    as often as it comes. ``whole`` counts how often the complete document is taken, words part_from..part_to come once
    more; taken = whole * size + part_to - part_from, at most ``most`` times the size. ``shard`` is that of the document's
    first taken block, null if nothing is taken. The order is by hash of id and text, so that reruns agree.

    A block has BLOCK_WORDS words, fewer where that makes less than LEAST_BLOCKS blocks in all. Nulls: a null text has
    no words; a null source is a source of its own, the last; a null id is a value like others. Texts of any length are
    counted whole. Repeated rows count each. An empty table gives an empty result; documents without words are never
    taken. Other columns are ignored, whatever their names.
    """
    return _mixed(docs, id_col, text_col, source_col, weights, budget, most, seed, shards).drop("at")


def _place(id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], budget: float, most: float, seed: int, shards: int) -> DataFrame:
    """mix's rows, with at, the hash that orders them."""
    slim = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            _place(id_col, text_col, seed).alias("_at"),
        )
    )
    words, n = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    buckets = max(1, words // BUCKET_WORDS, n // BUCKET_ROWS)
    block = max(1, min(BLOCK_WORDS, int(words * budget) // LEAST_BLOCKS))
    slim = slim.withColumn("_bucket", F.pmod(F.shiftright("_at", 3), F.lit(buckets)))
    filled = cut(slim.groupBy("source", "_bucket").agg(F.sum("size").alias("_words")).withColumn("_run_of", F.floor(F.col("_bucket") / FAN)))
    sources = source_targets(filled.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, budget, most)
    dealt = shard_quotas(sources, int(words * budget) // block, shards)
    # _ends: of a source's seats, how many there are up to the end of each shard
    quotas = dealt.groupBy("source", "source_size", "target").agg(F.sum("quota").alias("quota"), F.array_sort(F.collect_list(F.struct("shard", "quota"))).alias("_own"))
    quotas = quotas.withColumn("_ends", F.transform("_own", lambda x, i: F.aggregate(F.slice("_own", 1, i + 1), F.lit(0).cast("long"), lambda n, y: n + y["quota"]))).withColumn("_blocks", F.ceil(F.col("source_size") / block).cast("long"))
    plan = quotas.select(
        "source", "source_size", "target", "quota", "_ends", "_blocks",
        F.least(F.when(F.col("_blocks") > 0, F.floor(F.col("quota") / F.col("_blocks"))).otherwise(0), F.lit(int(most))).cast("long").alias("_passes"),
    ).withColumns(
        {
            "_run": F.when(F.col("_passes") < int(most), F.col("quota") - F.col("_passes") * F.col("_blocks")).otherwise(0),
            "_first": F.when(F.col("_blocks") > 0, F.pmod(F.xxhash64(F.lit(seed), F.col("source")), F.col("_blocks"))).otherwise(0),
        }
    )
    earlier = lambda keys, order: F.coalesce(F.sum("_words").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = filled.groupBy("source", "_run_of").agg(F.sum("_words").alias("_words")).select(F.col("source").alias("_s"), F.col("_run_of").alias("_r"), earlier(["source"], "_run_of").alias("_far"))
    near = filled.withColumn("_near", earlier(["source", "_run_of"], "_bucket"))
    laid_out = near.join(runs, near["source"].eqNullSafe(runs["_s"]) & (near["_run_of"] == runs["_r"])).select("source", "_bucket", (F.col("_near") + F.col("_far")).alias("_before"))
    placed = laid_out.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).select("b.source", "b._bucket", "b._before", *[f"p.{c}" for c in plan.columns if c != "source"])
    within = Window.partitionBy("source", "_bucket").orderBy("_at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = slim.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = laid.alias("d").join(placed.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d._bucket") == F.col("q._bucket"))).select("d.*", *[f"q.{c}" for c in placed.columns if c not in ("source", "_bucket")])
    # the run covers the blocks from _first, around the end to the start where it is longer than what is left
    lo = F.col("_before") + F.col("_in")
    hi = lo + F.col("size")
    a, b = F.col("_first") * block, (F.col("_first") + F.col("_run")) * block
    wrap = (F.col("_first") + F.col("_run") - F.col("_blocks")) * block
    over = lambda x, y: F.greatest(F.lit(0), F.least(hi, y) - F.greatest(lo, x))
    head, tail = over(F.lit(0), wrap), over(a, b)
    part = F.least(head + tail, F.col("size"))
    cut_from = F.when(head > 0, F.lit(0)).otherwise(F.greatest(F.lit(0), a - lo))
    # the first taken block, and how many seats the source's blocks before it have
    at = F.floor(F.when((F.col("_passes") > 0) | (head > 0), lo).otherwise(F.greatest(lo, a)) / block)
    ran = F.least(at, F.greatest(F.lit(0), F.col("_first") + F.col("_run") - F.col("_blocks"))) + F.least(F.greatest(at - F.col("_first"), F.lit(0)), F.col("_run"))
    seat = F.col("_passes") * at + ran
    return out.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("_passes") * F.col("size") + part).cast("long").alias("taken"),
        (F.col("_passes") + (part == F.col("size")).cast("long") * (F.col("size") > 0).cast("long")).alias("whole"),
        F.when((part > 0) & (part < F.col("size")), cut_from).otherwise(0).cast("long").alias("part_from"),
        F.when((part > 0) & (part < F.col("size")), cut_from + part).otherwise(0).cast("long").alias("part_to"),
        F.when((F.col("_passes") * F.col("size") + part) > 0, F.least(F.size(F.filter("_ends", lambda x: x <= seat)), F.lit(shards - 1))).cast("long").alias("shard"),
        F.col("_at").alias("at"),
    )


def remix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[int] = WEIGHTS, budget: float = 1.5, most: float = 2.0, seed: int = 17, shards: int = 8) -> DataFrame:
    """docs as the mix takes them (see mix), all columns kept, whatever their names: each document so often as it is taken whole, and once more with only the words taken where a block ends inside it. n_chars, where there is one, follows the text.

    Documents that aren't taken, and so those whose text is null, empty or without words, go. Repeated rows (equal id and
    text) come each so often as the one that is taken most. An empty table gives an empty result.
    """
    taken = _mixed(docs, id_col, text_col, source_col, weights, budget, most, seed, shards).filter("taken > 0")
    own, at, whole, start, end, copy = fresh(docs, "place", "at", "whole", "part_from", "part_to", "copy")
    first = taken.groupBy(F.col("at").alias(at)).agg(F.max("whole").alias(whole), F.max(F.struct("part_to", "part_from")).alias(start)).select(at, whole, F.col(f"{start}.part_to").alias(end), F.col(f"{start}.part_from").alias(start))
    joined = docs.withColumn(own, _place(id_col, text_col, seed)).join(first, F.col(own) == F.col(at))
    copies = joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(whole) + (F.col(end) > 0).cast("long"))))
    piece = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), (F.col(start) + 1).cast("int"), (F.col(end) - F.col(start)).cast("int")), "")
    partial = F.col(copy) > F.col(whole)
    out = copies.withColumn(text_col, F.when(partial, piece).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(partial, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(own, at, whole, start, end, copy)
