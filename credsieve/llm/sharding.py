"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut
from .mixing import WORD

#: Light groups share so many bundles. A group above 1 / (shards * GRAIN) of all bytes, tokens or rows is placed by itself; one above a whole shard's share can't stay together and is placed in pieces of 1 / PIECES of a shard.
BUNDLES, GRAIN, PIECES = 8192, 64, 8
#: Slots are counted in cells of about 1 / CELLS of all rows.
CELLS = 8192


def place(sizes: np.ndarray, shards: int, repairs: int = 4000) -> np.ndarray:
    """The shard of each row of sizes (unit x dimension), the first dimension being the one to keep closest.

    Units go by falling size to the shard where the dot product of the unit and the residual capacities is highest; ties
    go to the first. Then units move from the fullest to the emptiest shard while that makes the first dimension more even.
    """
    total = np.maximum(sizes.sum(0), 1)
    unit = sizes / total * shards
    left, home = np.ones((shards, sizes.shape[1])), np.zeros(len(sizes), np.int64)
    for i in np.lexsort((np.arange(len(unit)), -unit.max(1))):
        home[i] = at = int(np.argmax(left @ unit[i]))
        left[at] -= unit[i]
    load, first = np.bincount(home, sizes[:, 0], shards), sizes[:, 0]
    for _ in range(repairs):
        high, low = int(load.argmax()), int(load.argmin())
        gap = load[high] - load[low]
        own = np.flatnonzero((home == high) & (first < gap))
        if not len(own):
            break
        i = own[np.abs(first[own] - gap / 2).argmin()]
        home[i] = low
        load[high] -= first[i]
        load[low] += first[i]
    return home


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 40, bundles: int = BUNDLES, grain: int = GRAIN) -> DataFrame:
    """One row per row of docs: doc_id, size, tokens, text_crc32, shard, slot.

    A group of equal texts stays in one shard. Only a group that has more than a shard's share of all bytes, tokens or
    rows is split by id into pieces of an eighth of a share, each placed by itself. Groups far below a share (1 / grain of
    one) are pre-combined into ``bundles`` hash bundles, so that what is packed stays below bundles + 3 * shards * grain
    + CELLS units however large the table is. Slots count from 0 in each shard without gaps: unit after unit, and in a
    unit cell after cell (cells by hash of the id, so that a large group is no single task's work), and in a cell by id.

    A null text counts as empty. Texts of any length are measured whole. Repeated rows are rows of their own with slots of
    their own; null ids sort first, and rows of a large group without id share a cell. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text, 256).alias("_digest"),
        )
    )
    groups = slim.groupBy("_digest").agg(F.sum("size").alias("_b"), F.sum("tokens").alias("_t"), F.count("*").alias("_r"))
    total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_b", "_t", "_r")]).first()
    shares = F.greatest(*[F.col(c) / max(1, total[c]) for c in ("_b", "_t", "_r")]) * shards
    cells = F.ceil(F.col("_r") * CELLS / max(1, total["_r"]))
    # each is at least 1 / (shards * grain) of one total: at most 3 * shards * grain rows, so the broadcast is bounded
    heavy = (
        groups.withColumn("_p", shares)
        .filter(F.col("_p") > 1 / grain)
        .select(F.col("_digest").alias("_heavy"), (F.col("_p") > 1).alias("_split"), F.least(F.when(F.col("_p") > 1, F.greatest(cells, F.ceil(F.col("_p") * PIECES))).otherwise(cells), F.col("_r")).alias("_cells"))
    )
    cell = F.when(F.col("_heavy").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.col("_cells"))).cast("long")
    unit = F.when(F.col("_heavy").isNull(), F.concat(F.lit("b"), F.pmod(F.xxhash64("_digest"), F.lit(bundles)))).when(F.col("_split"), F.concat("_digest", F.lit("/"), cell)).otherwise(F.col("_digest"))
    units = slim.join(F.broadcast(heavy), F.col("_digest") == F.col("_heavy"), "left").withColumns({"_unit": unit, "_cell": cell}).drop("_heavy", "_split", "_cells")
    summed = units.groupBy("_unit", "_cell").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r"))

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if len(rows := pd.concat([pd.DataFrame({"_unit": [], "_cell": [], "b": [], "t": [], "r": []}), *frames])):
            u = rows.sort_values(["_unit", "_cell"], ignore_index=True)
            whole = u.groupby("_unit", sort=True)[["b", "t", "r"]].sum()
            u["shard"] = u["_unit"].map(dict(zip(whole.index, place(whole.to_numpy(float), shards), strict=True)))
            u["before"] = u.groupby("shard")["r"].cumsum() - u["r"]
            yield pd.DataFrame({"_at": u["_unit"], "_part": u["_cell"].astype("int64"), "shard": u["shard"].astype("int32"), "before": u["before"].astype("int64")})

    homes = summed.repartition(1).mapInPandas(packed, "_at string, _part long, shard int, before long")
    row = F.row_number().over(Window.partitionBy("_unit", "_cell").orderBy("doc_id", "_digest"))
    return (
        units.withColumn("_row", row)
        .join(F.broadcast(homes), (F.col("_unit") == F.col("_at")) & (F.col("_cell") == F.col("_part")))
        .select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("before") + F.col("_row") - 1).cast("long").alias("slot"))
    )
