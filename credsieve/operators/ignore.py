"""Ignore lists and allowlists as tables of any length: globs and rules meet paths and values by strings that a match must hold."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import paths as P
from ..storage import cut
from .dictionary import contained
from .rules import literal_of

#: An allowlist rule: criteria that are null or empty are none; a finding must meet all others.
ALLOW = "secret_types array<string>, paths array<string>, value_regex string, severities array<string>"
#: What rules look at in a finding.
SEEN = ("path", "display_name", "type_id", "value", "severity")


def glob_index(globs: DataFrame) -> DataFrame:
    """glob, regex, negated, run of each different glob that isn't null: of its literal runs that which the fewest globs have, of these the longest."""

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(g, *P.glob_to_regex(g), r) for g in f["glob"] for r in set(P.literal_runs(g))]
            yield pd.DataFrame(rows, columns=["glob", "regex", "negated", "run"])

    runs = cut(globs.select("glob").filter("glob IS NOT NULL").distinct().mapInPandas(parsed, "glob string, regex string, negated boolean, run string"))
    best = Window.partitionBy("glob").orderBy("_held", F.length("run").desc(), "run")
    held = runs.groupBy("run").agg(F.count("*").alias("_held"))
    return runs.join(held, "run").withColumn("_best", F.row_number().over(best)).filter("_best = 1").select("glob", "regex", "negated", "run")


def glob_matches(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """path, glob, negated for every different path (column path) and different glob (column glob) whose body matches; a leading ! is no part of the body.

    Paths are read once, whatever the number of globs: a containment join finds those that hold a glob's literal run, and
    only these are compared with its expression. No glob reaches the driver, and no expression grows with their number. A
    glob of wildcards alone has the edges as its only runs, and so is compared with every path, nearly all of which it matches.

    Null paths and null globs match nothing; an empty glob matches an empty file name. Repeated rows count once; empty tables
    give an empty result.
    """
    index = cut(glob_index(globs))
    texts = paths.select("path").filter("path IS NOT NULL").distinct().select("path", P.marked(F.col("path")).alias("text"))
    near = contained(texts, index.select(F.col("run").alias("value")))
    return near.join(index, F.col("value") == F.col("run")).filter(F.rlike(F.col("path"), F.col("regex"))).select("path", "glob", "negated")


def ignored_paths(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """The different paths that a list of globs ignores: one glob matches, or one negated glob doesn't. The order of a list is of no effect.

    See glob_matches. Negated globs are counted: a path that fewer of them match than there are fails one.
    """
    pairs = glob_matches(paths, globs)
    negated = globs.select("glob").distinct().filter(F.col("glob").rlike("^(!!)*!(?!!)")).count()
    out = pairs.filter("NOT negated").select("path")
    if negated:
        pairs = cut(pairs)
        all_met = pairs.filter("negated").groupBy("path").agg(F.count("*").alias("_n")).filter(F.col("_n") == negated)
        out = pairs.filter("NOT negated").select("path").union(paths.select("path").filter("path IS NOT NULL").join(all_met, "path", "left_anti"))
    return out.distinct()


@F.pandas_udf(T.BooleanType())
def _holds(value: pd.Series, regex: pd.Series) -> pd.Series:
    """Whether the expression is found in the value; an invalid one never is."""
    known: dict[str, re.Pattern | None] = {}

    def pattern(text: str) -> re.Pattern | None:
        if text not in known:
            try:
                known[text] = re.compile(text)
            except re.error:
                known[text] = None
        return known[text]

    return pd.Series([v is not None and (p := pattern(r)) is not None and p.search(v) is not None for v, r in zip(value, regex)], dtype=bool)


def _rules(allow: DataFrame) -> DataFrame:
    """Different rules that can let something pass, with a criterion and no invalid expression: their columns (severities in upper case), globs as (regex, negated), and literal, which each value that fits has in lower case."""

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["globs"] = [[P.glob_to_regex(g) for g in gs if g is not None] for gs in f["paths"]]
            f["literal"] = ["" if r is None else literal_of(r) if _valid(r) else None for r in f["value_regex"]]
            yield f

    names = [c.split()[0] for c in ALLOW.split(", ")]
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
    plain = allow.select(some("secret_types"), some("paths"), "value_regex", F.transform(some("severities"), F.upper).alias("severities"))
    named = plain.filter(F.greatest(*[F.size(c) for c in names if c != "value_regex"]) + F.col("value_regex").isNotNull().cast("int") > 0)
    return named.distinct().mapInPandas(parsed, ALLOW + ", globs array<struct<regex:string,negated:boolean>>, literal string").filter("literal IS NOT NULL").withColumn("rule", F.monotonically_increasing_id())


def _valid(regex: str) -> bool:
    try:
        return re.compile(regex) is not None
    except re.error:
        return False


def allowed_findings(found: DataFrame, allow: DataFrame) -> DataFrame:
    """The different (path, display_name, type_id, value, severity) of found that a rule of allow (columns of ALLOW) lets pass.

    A finding must meet all criteria that a rule has: its type's name or id is listed, a glob fits its path, the expression is
    found in its value, its severity is listed in either case. Each rule is asked of the findings that meet it by its most
    telling criterion: globs (unless one is negated), else a literal of its expression, else types, else severities. Only a rule
    without any of these, an expression with no literal or negated globs, is asked of all different findings.

    A rule without criteria and one with an invalid expression let nothing pass. A null in a finding meets no criterion on it.
    Repeated rows count once; empty tables give an empty result.
    """
    seen, rules = cut(found.select(*SEEN).distinct()), cut(_rules(allow))
    by_path = (F.size("paths") > 0) & ~F.exists("globs", lambda g: g["negated"])
    kinds: list[tuple[Column, Callable[[DataFrame], DataFrame]]] = [
        (by_path, lambda own: _by_paths(seen, own)),
        (F.col("literal") != "", lambda own: _by_literals(seen, own)),
        (F.size("secret_types") > 0, lambda own: _by_types(seen, own)),
        (F.size("severities") > 0, lambda own: seen.join(own.withColumn("_severity", F.explode(F.array_distinct("severities"))), F.upper("severity") == F.col("_severity")).drop("_severity")),
        (F.lit(True), lambda own: seen.join(own)),
    ]
    parts, before = [], F.lit(False)
    for fits, candidates in kinds:
        own = rules.filter(F.coalesce(fits, F.lit(False)) & ~before)
        before = before | F.coalesce(fits, F.lit(False))
        if not own.isEmpty():
            parts.append(_met(candidates(own)))
    return reduce(DataFrame.union, parts).distinct() if parts else seen.limit(0)


def _by_paths(seen: DataFrame, own: DataFrame) -> DataFrame:
    wanted = own.select("rule", F.explode("paths").alias("glob"))
    pairs = glob_matches(seen, wanted).join(wanted, "glob").select("path", "rule").distinct()
    return seen.join(pairs, "path").join(own, "rule")


def _by_literals(seen: DataFrame, own: DataFrame) -> DataFrame:
    texts = seen.select("value").filter("value IS NOT NULL").distinct().select("value", F.lower("value").alias("text"))
    near = contained(texts.withColumnRenamed("value", "_own"), own.select(F.col("literal").alias("value")))
    return seen.join(near.select(F.col("_own").alias("value"), F.col("value").alias("literal")), "value").join(own, "literal")


def _by_types(seen: DataFrame, own: DataFrame) -> DataFrame:
    named = own.select("rule", F.explode(F.array_distinct("secret_types")).alias("_type"))
    both = seen.withColumn("_type", F.explode(F.array_distinct(F.array("display_name", "type_id"))))
    return both.join(named, "_type").drop("_type").distinct().join(own, "rule")


def _met(pairs: DataFrame) -> DataFrame:
    """The findings of the pairs that meet all criteria of their rule."""
    none = lambda c: F.size(c) == 0
    listed = none("secret_types") | F.array_contains("secret_types", F.col("display_name")) | F.array_contains("secret_types", F.col("type_id"))
    placed = none("paths") | F.exists("globs", lambda g: F.rlike(F.col("path"), g["regex"]) != g["negated"])
    rated = none("severities") | F.array_contains("severities", F.upper("severity"))
    left = pairs.filter(listed & placed & rated)
    plain, asked = left.filter("value_regex IS NULL"), left.filter("value_regex IS NOT NULL")
    return plain.select(*SEEN).union(asked.filter(_holds("value", "value_regex")).select(*SEEN))
