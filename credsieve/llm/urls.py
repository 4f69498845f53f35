"""URL filter: host and path rules, then the ratio of two character Markov models."""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import cut

#: (verdict, host and path); the longest that fits wins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
ORDER = 4
#: So many windows' ratios are broadcast at most (about 40 MB in a worker); the others are joined by a shuffle.
MOST = 1 << 18
#: Logarithms are added up in steps of 1 / FIXED.
FIXED = 1 << 32
#: The calibration sees differences in steps of 1 / STEPS up to LIMIT, so that at most so many counts reach the driver.
STEPS, LIMIT = 128, 8
START, END = "\x02", "\x03"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits a URL's host (or a domain above it) and the start of its path, and its verdict; else null."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def window_ratios(texts: DataFrame, order: int) -> DataFrame | None:
    """_w, _n, _v for every different window of order + 1 characters in texts (_text, _rows, _learned: accepted, rejected or null).

    _n is how often the window comes in all rows; _v is the logarithm of the chance of its last character after those before
    it, as accepted less as rejected, in steps of 1 / FIXED, so that sums don't depend on their order. Both chances come from
    the exact counts of the learned texts, interpolated over all shorter contexts with Witten-Bell's weights. No group or join
    key has more rows than there are different characters. None if one class is missing.
    """
    chars = F.filter(F.split(F.concat(F.lit(START * order), "_text", F.lit(END)), ""), lambda c: c != "")  # windows of an array, as places in a string are counted from its start
    learned = [(F.col("_learned") == what).cast("long").alias(c) for what, c in (("accepted", "_a"), ("rejected", "_r"))]
    windows = (
        texts.select("_rows", *[F.coalesce(x, F.lit(0)).alias(c) for x, c in zip(learned, ("_a", "_r"))], chars.alias("_c"))
        .select("_rows", "_a", "_r", F.explode(F.expr(f"transform(sequence(1, size(_c) - {order}), i -> array_join(slice(_c, i, {order + 1}), ''))")).alias("_w"))
        .groupBy("_w").agg(F.sum("_rows").alias("_n"), F.sum("_a").alias("_a"), F.sum("_r").alias("_r"))
    )
    ends = F.explode(F.array(*[F.substring("_w", order + 1 - n, n + 1) for n in range(order + 1)]))
    keys = windows.select(ends.alias("_key"), "_n", "_a", "_r").groupBy("_key").agg(*[F.sum(c).alias(c) for c in ("_n", "_a", "_r")])
    context = Window.partitionBy(F.expr("left(_key, length(_key) - 1)"))
    about = [F.struct(F.col(c).alias("seen"), F.sum(c).over(context).alias("total"), F.count_if(F.col(c) > 0).over(context).alias("kinds")).alias(c) for c in ("_a", "_r")]
    counted = cut(keys.select("_key", "_n", F.length("_key").alias("_length"), *about))
    totals = counted.filter("_length = 1").agg(F.max("_a.total"), F.max("_r.total")).first()
    if not all(totals):
        return None
    level = counted.filter("_length = 1").withColumns({"_pa": F.lit(1 / 256), "_pr": F.lit(1 / 256)})
    for n in range(order + 1):  # from no context to the longest; a key's chance starts from that of the key without its first character
        if n:
            shorter = level.select(F.col("_key").alias("_end"), "_pa", "_pr")
            level = counted.filter(F.col("_length") == n + 1).join(shorter, F.expr("substring(_key, 2)") == F.col("_end"))
        chance = [F.when(F.col(f"{c}.total") > 0, (F.col(f"{c}.seen") + F.col(f"{c}.kinds") * F.col(p)) / (F.col(f"{c}.total") + F.col(f"{c}.kinds"))).otherwise(F.col(p)).alias(p) for c, p in (("_a", "_pa"), ("_r", "_pr"))]
        level = level.select("_key", "_n", *chance)
    return cut(level.select(F.col("_key").alias("_w"), "_n", F.round((F.ln("_pa") - F.ln("_pr")) * FIXED).cast("long").alias("_v")))


class Scorer:
    """Length-normalised log-likelihood differences of texts, from the ratios of all their windows.

    At most `most` windows, those in more than their share of all window occurrences, are broadcast; fewer than that can be.
    All others are joined by a shuffle on the window, where none has a larger share than 1 / most. Whatever `most` is, the
    sums are the same.
    """

    def __init__(self, texts: DataFrame, ratios: DataFrame, order: int, most: int):
        n, total = ratios.agg(F.count("*"), F.sum("_n")).first()
        least = 0 if n <= most else total // most
        got = ratios.filter(F.col("_n") > least).select("_w", "_v").toArrow()
        self.order, self.more = order, None
        self.known = texts.sparkSession.sparkContext.broadcast(dict(zip(got["_w"].to_pylist(), got["_v"].to_pylist())))
        if n > most:
            rare = ratios.filter(F.col("_n") <= least).select("_w", "_v")
            rest = self._summed(texts.select("_text")).filter(F.size("_rest") > 0).select("_at", F.explode("_rest").alias("_w"))
            self.more = cut(rest.join(rare, "_w").groupBy("_at").agg(F.sum("_v").alias("_more")))

    def _summed(self, rows: DataFrame) -> DataFrame:
        """rows without _text, and _sum over the windows known, _size, the other windows as _rest, and _at: the text's digest, or another key for each row where no window is left."""
        known, order = self.known, self.order
        kept = [f for f in rows.schema if f.name != "_text"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            get = known.value.get
            for b in batches:
                sums, sizes, rests = [], [], []
                for text in b["_text"].to_pylist():
                    t = START * order + text + END
                    windows = [t[i - order : i + 1] for i in range(order, len(t))]
                    values = list(map(get, windows))
                    rest = [w for w, v in zip(windows, values, strict=True) if v is None] if None in values else []
                    sums.append(sum(v for v in values if v is not None) if rest else sum(values))
                    sizes.append(len(windows))
                    rests.append(rest)
                at = [d if rest else f"{d}{i}" for i, (d, rest) in enumerate(zip(b["_digest"].to_pylist(), rests, strict=True))]
                own = [b[f.name] for f in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sums, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rests, pa.list_(pa.string())), pa.array(at, pa.string())], [*(f.name for f in kept), "_sum", "_size", "_rest", "_at"])

        shape = StructType([*kept, *StructType.fromDDL("_sum long, _size long, _rest array<string>, _at string").fields])
        return rows.withColumn("_digest", F.sha2("_text", 256)).mapInArrow(run, shape)

    def differences(self, rows: DataFrame) -> DataFrame:
        """rows with _x in place of _text. A text with windows left to join has no larger share of the rows than they have of all windows, so that no such key is hot."""
        summed = self._summed(rows)
        if self.more is not None:
            summed = summed.join(self.more, "_at", "left").withColumn("_sum", F.col("_sum") + F.coalesce("_more", F.lit(0)))
        return summed.select(*[c for c in rows.columns if c != "_text"], (F.col("_sum") / F.col("_size") / FIXED).alias("_x"))


def calibrate(x: np.ndarray, y: np.ndarray, n: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and intercept of P(accepted | x) over n cases each, by Newton's method on a slightly shrunk logistic likelihood."""
    slope, base = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + base, -30, 30)))
        w = n * p * (1 - p)
        g = np.array([(n * (p - y) * x).sum() + 1e-3 * slope, (n * (p - y)).sum() + 1e-3 * base])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        slope, base = slope - step[0], base - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(slope), float(base)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, rules: Sequence[tuple[str, str]] = RULES, order: int = ORDER, most: int = MOST) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (chance that the URL is accepted).

    All different URLs that a rule judges train the models: Spark counts every character after its contexts in four fifths
    of them, chosen by hash, and the others calibrate the length-normalised log-likelihood difference. A URL counts once,
    however many rows have it. Every page's URL is scored; where no rule fits, a chance of 0.5 or more means allow. Counts
    are exact at every size: the ratios of at most `most` windows of characters are broadcast, others meet the URLs by a join.

    A URL that is null or has no :// has an empty host and path, fits no rule, and is scored as an empty text. Very long
    URLs are scored whole. Repeated rows are judged alike. Where rules leave one class empty, all chances are 0.5, and so a
    tie, which is allowed. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    url = F.col(url_col)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)", 1), F.lit(""))
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), rest.alias("_rest")).withColumns({"rule": rule, "verdict": verdict})
    judged = judged.withColumn("_text", F.concat("host", "_rest")).drop("_rest")
    accepted = F.when(F.col("rule").isNotNull(), F.col("verdict") == "allow")
    texts = cut(judged.groupBy("_text").agg(F.count("*").alias("_rows"), F.first(accepted).alias("_accepted")))
    fits = F.pmod(F.xxhash64(F.lit(5), "_text"), F.lit(5)) > 0
    ratios = window_ratios(texts.withColumn("_learned", F.when(fits & F.col("_accepted"), "accepted").when(fits & ~F.col("_accepted"), "rejected")), order)
    slope, base = 0.0, 0.0
    if ratios:
        model = Scorer(texts, ratios, order, most)
        near = F.round(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("_x"))) * STEPS).cast("int")
        held = model.differences(texts.filter(F.col("_accepted").isNotNull() & ~fits).select("_text", "_accepted")).groupBy(near.alias("_x"), "_accepted").count().toArrow()
        x, y, n = held["_x"].to_numpy() / STEPS, held["_accepted"].to_numpy(zero_copy_only=False).astype(float), held["count"].to_numpy()
        slope, base = calibrate(x, y, n) if len(set(y)) == 2 else (1.0, 0.0)
        judged = model.differences(judged)
    else:
        judged = judged.withColumn("_x", F.lit(0.0))
    chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("_x") * slope + base)))
    return judged.withColumn("score", chance).select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("score") >= 0.5, "allow").otherwise("block")).alias("verdict"), "score")
