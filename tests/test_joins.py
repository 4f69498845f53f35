"""Containment joins, lines that no rule can match, snapshots, and first-seen findings over restarts."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_scan import MIXED, sample

from credsieve.operators import dictionary as D
from credsieve.operators import match as M
from credsieve.operators import report as R
from credsieve.plans import queries as Q
from credsieve.sources import history as H
from credsieve.streaming import scan as W


@given(st.binary(max_size=60), st.integers(1, 8))
def test_windows(raw, size):
    got = D.windows(np.frombuffer(raw, np.uint8), size)
    assert got.tolist() == [int.from_bytes(raw[i : i + size], "little") for i in range(len(raw) - size + 1)]
    assert all(((x >= 0) & (x < D.FILTER_BITS)).all() for x in D.slots(got, size)) and len(list(D.slots(got, size))) == D.PROBES


def test_containment_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé日 =") for _ in range(n))
    texts = [word(rng.randint(0, 300)) for _ in range(400)] + ["", None, "x" * 70_000 + "needle in hay" + "y" * 9, "a common prefix 1"] * 2
    values = [t[(i := rng.randint(0, len(t))) : i + rng.randint(1, 40)] for t in texts[:300]] + ["needle in hay", "x" * 9, "x" * 10, "y", "xy", "x" * 69_999, "", None, "nowhere at all", "a common prefix 1", "a common prefix 2", "a common prefix 12"]
    texts.append("x" * D.PIECE + "needle in hay" + "x" * D.PIECE + "needle in hay" + "y" * 40)  # over several pieces
    rows = [(i, t) for i, t in enumerate(texts)]
    got = D.contained(spark.createDataFrame([(*r, 1) for r in rows], "id int, text string, value2 int"), spark.createDataFrame([(v,) for v in values * 2], "value string"))
    assert sorted((r.id, r.value) for r in got.collect()) == sorted((i, v) for i, t in rows for v in set(values) if v and t is not None and v in t)
    assert "MapInArrow" in got._jdf.queryExecution().toString()


@given(st.binary(min_size=70, max_size=90), st.sampled_from(D.GRAMS[1:]), st.integers(0, 30))
def test_long_windows(raw, size, at):
    data = np.frombuffer(raw, np.uint8)
    got = D.windows(data, size)
    assert len(got) == len(raw) - size + 1 and got[at] == D.windows(data[at : at + size], size)[0]
    assert len(set(got.tolist())) == len({raw[i : i + size] for i in range(len(got))})


def test_values_stand_by_their_rarest_gram(spark):
    values = [f"postgresql://admin:{i:04d}@db" for i in range(50)] + ["password Zq9!7K", "ab", "x" * 40]
    got = {r.value: r for r in D.gram_index(spark.createDataFrame([(v,) for v in values], "value string")).collect()}
    assert set(got) == set(values) and len({r.gram for r in got.values()}) == len(values)
    assert [got[v]["size"] for v in (values[0], *values[-3:])] == [24, 12, 2, 32]
    wanted = D.windows(np.frombuffer(b"password Zq9!7K", np.uint8), 12)[3:].view(np.int64)
    assert got["password Zq9!7K"].gram in wanted, "with the fewest lower-case letters"


def test_reports_are_not_traced(spark):
    head = '{"version":1,"total_findings":0,"findings":[]}'
    files = spark.createDataFrame([(p, c) for p, c in [("a.py", "k"), ("b.html", "k"), ("c/scan.json", "k"), ("d.sarif", "k"), ("e.json", head), ("f.json", "k"), ("html", "k")]], "path string, content string")
    assert {r.path for r in R.traceable(files).collect()} == {"a.py", "f.json", "html"}


def test_no_match_is_ruled_out(spark):
    """Lines made from every pattern, in both cases and amid other text, and lines of letters that fold to ASCII."""
    rng, lines = random.Random(8), [*MIXED, "", None]
    rows = [r.asDict() for r in Q.rules(spark).collect()]
    for _, _, _, rx, _, _ in Q.CATALOGUE:
        for k in range(4):
            made = sample(rx, rng)
            lines.append(rng.choice(["", "é ", "x" * 30 + " "]) + (made if k < 2 else made.swapcase().replace("k", "K").replace("s", "ſ")) + rng.choice(["", " 'and'"]))
    lines += ["".join(rng.choice("ab1ſK ='\":/") for _ in range(40)) for _ in range(300)]
    kept = {r.n for r in spark.createDataFrame(list(enumerate(lines)), "n int, line string").filter(M.candidate(F.col("line"), rows)).collect()}
    catalogue = M.Catalogue(rows)
    hit = {i for i, line in enumerate(lines) if line and list(catalogue.matches(line))}
    assert hit <= kept and len(hit) > len(Q.CATALOGUE)


def test_hardly_any_line_reaches_python(spark):
    rows = [r.asDict() for r in Q.rules(spark).collect()]
    lines = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.explode(F.split("text", "\n")).alias("line"))
    assert lines.filter(M.candidate(F.col("line"), rows)).count() < 0.05 * lines.count()


@pytest.mark.parametrize(("regex", "run"), [("AKIA[A-Z0-9]{16}", 20), ("(?i)key.{0,9}['\"]([a-z]{3,5})", 3), ("a(?:bc|d)*e", 2), ("a(?:b c|d)*e", 1), ("(?:ab|cde){2}f", 5), (r"\d{30}", 0), ("x?y{2,}z", 3), ("[^a]{40}", 0), ("abc$", 3)])
def test_sure_runs(regex, run):
    assert M.sure_run(regex) == run


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30), st.integers(1, 3))
def test_shortest_edit_script(a, b, most):
    kept = H.kept_lines(a, b)
    assert kept == sorted(set(kept)) and len(kept) == longest(a, b)
    for places in (kept, H.kept_lines(a, b, most)):
        rest = iter(a)
        assert all(any(b[p] == x for x in rest) for p in places), "a common subsequence"
    old, new = [str(x) for x in a], [str(x) for x in b]
    assert len(H.added_places(old, new)) == len(b) - longest(a, b)


def test_snapshots_against_brute_force(spark):
    rng = random.Random(5)
    text = lambda: "\n".join(rng.choice(["", "a", "b", "key = 1", "é\r"]) for _ in range(rng.randint(0, 12)))
    old = [(f"f{i}", text()) for i in range(60)] + [("gone", "x\ny"), ("null", None), (None, "p\nq"), ("twice", "a\nb"), ("twice", "c")]
    new = [(p, c if i % 3 else text()) for i, (p, c) in enumerate(old[:60])] + [("new", "1\n2\n"), ("empty", ""), ("null", "was null"), (None, "p\nq\nr"), ("twice", "a\nc")]
    tables = [spark.createDataFrame(x, "path string, content string").withColumn("line", F.lit("clash")) for x in (old, new)]
    got = {}
    for r in H.tree_diff(*tables, "c9", "who", "2024-01-02 03:04:05").collect():
        got.setdefault(r.file_path, []).append((r.line_number, r.line))
        assert (r.commit_hash, r.commit_author, str(r.commit_date)) == ("c9", "who", "2024-01-02 03:04:05")
    least = {}
    for p, c in old:
        least[p] = min(c or "", least.get(p, c or ""))
    cut = lambda c: (c or "").split("\n")[: -1 if not c or c.endswith("\n") else None]
    for p, c in new:
        a, b, added = cut(least.get(p)), cut(c), sorted(got.pop(p, []))
        assert all(b[n - 1] == x for n, x in added) and len(added) == len(b) - longest(a, b)
        kept = [x for n, x in enumerate(b, 1) if n not in dict(added)]
        rest = iter(a)
        assert all(any(x == y for y in rest) for x in kept)
    assert not got and H.tree_diff(tables[0], tables[0]).count() == H.tree_diff(tables[0], tables[1].filter("false")).count() == 0


def test_a_file_of_a_million_lines():
    old = [f"line {i % 70_000}" for i in range(1_000_000)]
    new = old[:300_000] + ["secret"] + old[300_000:700_000] + ["other", *old[700_010:]]
    assert [new[p] for p in H.added_places(old, new)] == ["secret", "other"]


def test_first_seen_over_restarts(spark, tmp_path):
    """A query that dies while it writes, and after it wrote but before the batch is done, goes on from its checkpoint; nothing comes twice, nothing is lost."""
    source, table = tmp_path / "in", str(tmp_path / "known")
    source.mkdir()
    schema = "fingerprint string, ts timestamp, path string"

    def arrive(name, keys):
        rows = [(k, f"2024-01-0{i % 9 + 1} 00:00:00", f"{name}-{i}") for i, k in enumerate(keys)]
        spark.createDataFrame(rows, "fingerprint string, t string, path string").selectExpr("fingerprint", "timestamp(t) ts", "path").coalesce(1).write.parquet(str(source / name))

    def drain(act):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
        q = stream.writeStream.foreachBatch(act).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception as e:  # noqa: BLE001  as planned
            return str(e)
        return ""

    remember = W.remember_new(table)

    def dies(batch, n):
        remember(batch, n)
        if n == 1:
            raise RuntimeError("lost")

    arrive("one", ["a", "b", "a", None])
    assert not drain(remember)
    arrive("two", ["b", "c", "c", None])
    assert "lost" in drain(dies)
    assert not drain(remember)
    arrive("three", ["d", "a", "c"])
    assert not drain(remember)
    got = spark.read.schema(schema).parquet(table).collect()
    assert sorted(str(r.fingerprint) for r in got) == ["None", "a", "b", "c", "d"]
    assert {r.fingerprint: r.path for r in got}["a"] == "one-0" and {r.fingerprint: r.path for r in got}["c"] == "two-1"
