"""Filters, dedup, baselines, ignore rules and allowlists over flat findings."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from ..functions import text as X
from .ignore import SEEN, allowed_findings, ignored_paths


def min_confidence(found: DataFrame, least: float = 0.6) -> DataFrame:
    return found.filter(F.col("confidence") >= least)


def exclude_tests(found: DataFrame) -> DataFrame:
    return found.filter(~F.col("is_test_file"))


def only_verified(found: DataFrame) -> DataFrame:
    return found.filter(F.col("validated").eqNullSafe(F.lit(True)))


def report_filter(found: DataFrame, severities: Iterable[str] = ("CRITICAL", "HIGH", "MEDIUM", "LOW"), exclude_docs: bool = False) -> DataFrame:
    out = found.filter(F.col("severity").isin(*severities))
    return out.filter(~F.col("is_documentation")) if exclude_docs else out


def likely_false_positive() -> Column:
    return F.when(F.col("is_private_key"), False).when(F.col("confidence") < 0.7, True).otherwise((F.col("is_test_file") | F.col("is_documentation")) & (F.col("confidence") < 0.9))


def first_per_value(found: DataFrame) -> DataFrame:
    """Working-tree-first dedup: one finding per file and value, by (has a commit, line, column, rule)."""
    commit = F.col("commit_hash").isNotNull() if "commit_hash" in found.columns else F.lit(False)
    w = Window.partitionBy("path", "value").orderBy(commit, "line_number", "start", "rule_ord")
    return found.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def drop_runs(found: DataFrame) -> DataFrame:
    """Consecutive matches of one value on a line leave the first."""
    w = Window.partitionBy("path", "line_number").orderBy("rule_ord", "start")
    return found.withColumn("_p", F.lag("value").over(w)).filter(~F.col("value").eqNullSafe(F.col("_p"))).drop("_p")


def merge_structured(found: DataFrame, structured: DataFrame) -> DataFrame:
    return found.unionByName(structured.join(found, ["path", "value"], "left_anti"), allowMissingColumns=True)


def not_in_worktree(history: DataFrame, worktree: DataFrame) -> DataFrame:
    return history.join(worktree, ["path", "value"], "left_anti")


# ---- baselines ----


def baseline_create(found: DataFrame, reason: str | None = None) -> DataFrame:
    return found.select("fingerprint", F.col("display_name").alias("secret_type"), F.col("path").alias("file_path"), "line_number", "redacted_value", F.lit(reason).cast("string").alias("reason"))


ENTRY = "fingerprint string, secret_type string, file_path string, line_number int, redacted_value string, reason string"


def write_baseline(baseline: DataFrame, path: str) -> None:
    """As JSON lines, one entry each; what was there is replaced."""
    baseline.select(*[c.split()[0] for c in ENTRY.split(", ")]).write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """Entries of JSON lines, or of one JSON document that holds them in ``entries``. Entries without a fingerprint are left out."""
    if document:
        entries = spark.read.schema(f"version string, generated_at string, count long, entries array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path).select(F.inline("entries"))
    else:
        entries = spark.read.schema(ENTRY).json(path)
    return entries.filter("fingerprint IS NOT NULL")


def baseline_apply(found: DataFrame, baseline: DataFrame) -> DataFrame:
    return found.join(baseline, "fingerprint", "left_anti")


def baseline_update(baseline: DataFrame, found: DataFrame) -> DataFrame:
    return baseline.unionByName(baseline_create(found.join(baseline, "fingerprint", "left_anti")))


# ---- ignore files and allowlists ----


def parse_ignore(lines: DataFrame) -> DataFrame:
    """kind (glob or fingerprint) and value of an ignore file's lines (value)."""
    v = F.regexp_replace("value", r"^\s+|\s+$", "")
    rows = lines.select(v.alias("v")).filter((F.col("v") != "") & ~F.col("v").startswith("#"))
    mark = F.col("v").startswith("fingerprint:") | F.col("v").rlike("^[0-9a-fA-F]{64}$")
    return rows.select(F.when(mark, "fingerprint").otherwise("glob").alias("kind"), F.regexp_replace("v", r"^fingerprint:\s*", "").alias("value"))


def ignored_by_glob(path: Column, globs: Iterable[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | P.glob_match(path, g)
    return out


def allowed(rule: dict) -> Column:
    """All criteria that an allowlist rule names must hold: secret_types, paths (globs), value_regex, severities. A rule without any never holds."""
    out: Column | None = None
    checks = []
    if rule.get("secret_types"):
        checks.append(F.col("display_name").isin(*rule["secret_types"]) | F.col("type_id").isin(*rule["secret_types"]))
    if rule.get("paths"):
        checks.append(ignored_by_glob(F.col("path"), rule["paths"]))
    if rule.get("value_regex"):
        try:
            re.compile(rule["value_regex"])
            checks.append(F.col("value").rlike(rule["value_regex"]))
        except re.error:  # an invalid expression lets nothing pass
            checks.append(F.lit(False))
    if rule.get("severities"):
        checks.append(F.col("severity").isin(*[s.upper() for s in rule["severities"]]))
    for c in checks:
        out = c if out is None else out & c
    return F.lit(False) if out is None else out


def suppress(found: DataFrame, globs: Iterable[str] | DataFrame = (), fingerprints: DataFrame | None = None, allow: Iterable[dict] | DataFrame = ()) -> DataFrame:
    """Adds ignored and ignore_reason: inline marker, ignore file, fingerprint, or allowlist.

    A few globs or rules can be given as they are and become part of one expression; as tables (glob; columns of
    ignore.ALLOW) they can be any number.
    """
    out = found
    if fingerprints is not None:
        out = out.join(fingerprints.select(F.col("value").alias("fingerprint"), F.lit(True).alias("_known")).distinct(), "fingerprint", "left")
    else:
        out = out.withColumn("_known", F.lit(None).cast("boolean"))
    if isinstance(globs, DataFrame):
        out, by_path = out.join(ignored_paths(found, globs).withColumn("_placed", F.lit(True)), "path", "left"), F.col("_placed")
    else:
        out, by_path = out.withColumn("_placed", F.lit(None).cast("boolean")), ignored_by_glob(F.col("path"), globs)
    if isinstance(allow, DataFrame):
        right = allowed_findings(found, allow).select(*[F.col(c).alias(f"_{c}") for c in SEEN], F.lit(True).alias("_allowed"))
        on = F.lit(True)
        for c in SEEN:
            on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        out, by_rule = out.join(right, on, "left").drop(*[f"_{c}" for c in SEEN]), F.col("_allowed")
    else:
        out, by_rule = out.withColumn("_allowed", F.lit(None).cast("boolean")), F.lit(False)
        for rule in allow:
            by_rule = by_rule | allowed(rule)
    reason = F.when(X.inline_ignored(F.col("line")), "inline").when(by_path, "path").when(F.col("_known"), "fingerprint").when(by_rule, "allowlist")
    return out.withColumn("ignore_reason", reason).withColumn("ignored", F.col("ignore_reason").isNotNull()).drop("_known", "_placed", "_allowed")
