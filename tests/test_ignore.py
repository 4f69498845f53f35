"""Globs and allowlist rules as tables, against a matcher written character by character."""

import random
import re

import pytest
from pyspark.sql import functions as F

from credsieve.functions import paths as P
from credsieve.operators import ignore as I
from credsieve.operators import suppress as B


def fits(text, pattern):
    """Whether the whole text is of the pattern: ** crosses slashes and takes the one after it along, * and ? don't."""
    if not pattern:
        return not text
    if pattern.startswith("**"):
        rest = pattern.lstrip("*").removeprefix("/")
        return any(fits(text[i:], rest) for i in range(len(text) + 1))
    if pattern[0] == "*":
        return any(fits(text[i:], pattern[1:]) for i in range(len(text) + 1) if "/" not in text[:i])
    return bool(text) and (text[0] == pattern[0] or pattern[0] == "?" and text[0] != "/") and fits(text[1:], pattern[1:])


def glob(path, pattern):
    if pattern.startswith("!"):
        return not glob(path, pattern[1:])
    if "/" not in pattern:
        return fits(path.rsplit("/", 1)[-1], pattern)
    tails = [path, *(path[i + 1 :] for i, c in enumerate(path) if c == "/")]
    return any(fits(t, pattern.removeprefix("**/")) for t in tails)


def made(seed, n, alphabet, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


PATHS = made(1, 300, ["a", "b", "ab", "/", "/", ".py", "é"], 8) + ["", "/", "src/a.py", "/src/a.py", "x/src/a.py", "src/deep/er/a.py", "srcx/a.py", "a\n", "ä/日本.py", "x" * 70_000 + "/a.py"]
GLOBS = made(2, 200, ["a", "b", "/", "*", "**", "**/", "?", ".py", "é"], 6) + ["", "*", "**", "***", "**/", "*.py", "src/*.py", "/src/*.py", "**/src/**/a.py", "src/**", "?.py", "a**b", "日本.*", "no/such.txt", "[a].py", "a.p+"]


def test_globs_against_brute_force(spark):
    rows = [(p, 1) for p in [*PATHS, None, "src/a.py"]]
    got = I.glob_matches(spark.createDataFrame(rows, "path string, glob int"), spark.createDataFrame([(g,) for g in [*GLOBS, None, "*.py"]], "glob string"))
    assert sorted((r.path, r.glob) for r in got.collect()) == sorted((p, g) for p in set(PATHS) for g in set(GLOBS) if glob(p, g))
    one = spark.createDataFrame([(p,) for p in PATHS], "path string")
    for g in ["!*.py", "!!*.py", "a/**/b", "**/a", "a**b", "/src/a.py"]:
        assert [r[0] for r in one.select(P.glob_match(F.col("path"), g)).collect()] == [glob(p, g) for p in PATHS], g


@pytest.mark.parametrize("globs", [["*.py", "src/**"], ["!*.py", "!src/**", "!src/**"], ["!!*.py", "!!!**/a*"], [None]])
def test_ignored_paths(spark, globs):
    got = I.ignored_paths(spark.createDataFrame([(p,) for p in [*PATHS, None]], "path string"), spark.createDataFrame([(g,) for g in globs], "glob string"))
    assert sorted(r[0] for r in got.collect()) == sorted(p for p in set(PATHS) if any(glob(p, g) for g in globs if g is not None))


def test_many_globs_make_no_larger_plan(spark):
    """20,000 globs of one hot directory, as a table: the same plan as for one."""
    paths = spark.range(2000).select(F.concat(F.lit("vendor/lib/m"), "id", F.lit("/index.js")).alias("path"))
    many = spark.range(20000).select(F.concat(F.lit("lib/m"), "id", F.lit("/*.js")).alias("glob"))
    plan = lambda n: len(I.ignored_paths(paths, many.limit(n))._jdf.queryExecution().analyzed().toString())
    assert abs(plan(20000) - plan(1)) < 200 and I.ignored_paths(paths, many).count() == 2000


def fits_rule(f, rule):
    types, paths, regex, severities = rule
    try:
        checks = [
            *([f[1] in types or f[2] in types] if types else []),
            *([any(glob(f[0], g) for g in paths)] if paths else []),
            *([f[3] is not None and re.search(regex, f[3]) is not None] if regex is not None else []),
            *([(f[4] or "").upper() in [s.upper() for s in severities]] if severities else []),
        ]
    except re.error:
        return False
    return bool(checks) and all(checks)


def test_allow_rules_against_brute_force(spark):
    rng = random.Random(5)
    pick = lambda some, p=0.5: some if rng.random() < p else rng.choice([None, []])
    found = [(rng.choice(PATHS[:40]), rng.choice(["Key", "Token"]), rng.choice(["K", "T"]), rng.choice(["sk_live_ABC", "tok-123456", "Épée", "", None]), rng.choice(["HIGH", "LOW"])) for _ in range(150)]
    rules = [(pick([rng.choice(["Key", "T"])]), pick([rng.choice(["*.py", "a*/**", "!*.py"]), "ab"]), rng.choice([None, None, "LIVE", "(?i)LIVE", "^tok", "[", "", "p.e", "123|abc"]), pick([rng.choice(["low", "High"])])) for _ in range(40)]
    found_df = spark.createDataFrame([(*f, 7) for f in found], "path string, display_name string, type_id string, value string, severity string, rule int")
    for t, p, x, s in [*rules[:10], (None, None, None, None), (None, None, "[", None)]:
        mine = found_df.filter(B.allowed({"secret_types": t, "paths": p, "value_regex": x, "severities": s}))
        assert x == "" or {tuple(r)[:5] for r in mine.collect()} == {f for f in found if fits_rule(f, (t, p, x, s))}
    for some in [rules, [(None, [], None, [])], []]:
        got = I.allowed_findings(found_df, spark.createDataFrame([(*r, 1) for r in some], I.ALLOW + ", literal int"))
        assert sorted(map(str, got.collect())) == sorted({str(r) for r in found_df.drop("rule").collect() if any(fits_rule(tuple(r), x) for x in some)})


def test_invalid_rules_are_asked_of_no_finding(spark):
    """Rules whose expression doesn't compile let nothing pass, so that no join pairs them with all findings."""
    found = spark.range(50).select(F.concat(F.lit("a"), "id", F.lit(".py")).alias("path"), F.lit("Key").alias("display_name"), F.lit("K").alias("type_id"), F.concat(F.lit("tok-1234-"), "id").alias("value"), F.lit("LOW").alias("severity"))
    rules = spark.range(50).selectExpr("CAST(NULL AS array<string>) AS secret_types", "CAST(NULL AS array<string>) AS paths", "concat('tok-1234-', id, IF(id % 10 = 0, '$', '[')) AS value_regex", "CAST(NULL AS array<string>) AS severities")
    got = I.allowed_findings(found, rules)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(r.value for r in got.collect()) == sorted(f"tok-1234-{i}" for i in range(0, 50, 10))
    assert I.allowed_findings(found, rules.filter("value_regex LIKE '%['")).count() == 0
