"""Commit history: added lines of exported patches, ranges, listings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import cut


def commits(patches: DataFrame) -> DataFrame:
    """patches: one row per commit (patch: its ``git log -p`` text). -> commit_hash, commit_author, commit_date, patch"""
    head = F.col("patch")
    return patches.select(
        F.regexp_extract(head, r"^(?:commit )?([0-9a-f]{7,64})", 1).alias("commit_hash"),
        F.regexp_extract(head, r"(?m)^Author: *(.*)$", 1).alias("commit_author"),
        F.try_to_timestamp(F.regexp_extract(head, r"(?m)^Date: *(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d)", 1)).alias("commit_date"),
        "patch",
    )


_HUNK = re.compile(r"@@ -[0-9]+(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))?")


def _patch_lines(patch: str) -> Iterator[tuple[str | None, int | None, str]]:
    """file, number and text of each added line. Inside the counts that a hunk's header gives, any line that starts as one of a hunk does belongs to it; beyond them, lines that look like headers don't."""
    file, number, old, new, inside = None, 0, 0, 0, False
    for line in patch.split("\n"):
        start = line[:1]
        counted = inside and (new > 0 if start == "+" else old > 0 if start == "-" else start in ("", " ", "\\") and old + new > 0)
        if not counted:
            if hunk := _HUNK.match(line):
                (old, new), number, inside = (int(n or 1) for n in hunk.group(1, 3)), int(hunk[2]), True
                continue
            if line.startswith("diff --git"):
                inside = False
            elif line.startswith("+++ b/"):
                file = line[6:]
            if not inside or line.startswith(("index ", "--- ", "+++ ")):
                continue
        if start == "+":
            yield file, number if number < 1 << 31 else None, line[1:]
        number += start not in ("-", "\\")
        old -= start not in ("+", "\\")
        new -= start not in ("-", "\\")


def added_lines(history: DataFrame) -> DataFrame:
    """file_path, line_number, line, commit_hash, commit_author, commit_date of every added line.

    Each patch is walked by itself, without a shuffle, so that commits whose hash is null, unreadable or repeated are as good
    as others. A null patch has no lines; a line before any file's name has a null file_path.
    """
    shape = StructType([*StructType.fromDDL("file_path string, line_number int, line string").fields, *(history.schema[c] for c in ("commit_hash", "commit_author", "commit_date"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, added, held = [], [], 0

            def flushed(b: pa.RecordBatch) -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, t in zip(zip(*added, strict=True), (pa.string(), pa.int32(), pa.string()))]
                return pa.RecordBatch.from_arrays([*columns, *(b[c].take(pa.array(at, pa.int64())) for c in shape.names[3:])], shape.names)

            for i, patch in enumerate(b["patch"]):
                for found in _patch_lines(patch.as_py() or ""):
                    at.append(i)
                    added.append(found)
                    held += len(found[2]) + 100
                    if held > 8 << 20:
                        yield flushed(b)
                        at, added, held = [], [], 0
            if added:
                yield flushed(b)

    return history.select("commit_hash", "commit_author", "commit_date", "patch").mapInArrow(run, shape)


def ancestors(edges: DataFrame, commit: str) -> DataFrame:
    """commit_hash of a commit and all its ancestors over edges (child, parent), however deep the history is.

    Along one parent of each commit the ancestors are found by pointer doubling; other parents of what is reached start
    the next round, until nothing new is found. Tables between the steps lie in the shared folder.
    """
    links = cut(edges.filter("child IS NOT NULL AND parent IS NOT NULL AND child <> parent").select("child", "parent").distinct())
    jump, jumps, reach, most = cut(links.groupBy("child").agg(F.min("parent").alias("parent"))), [], 1, links.count()
    while reach <= most and not jump.isEmpty():  # longer ways than there are edges only run in circles
        jumps.append(jump)
        jump = cut(jump.alias("a").join(jump.alias("b"), F.col("a.parent") == F.col("b.child")).select("a.child", "b.parent"))
        reach *= 2
    front = edges.sparkSession.range(1).select(F.lit(commit).alias("commit_hash"))
    own = None
    while True:
        for j in jumps:
            front = cut(front.union(front.join(j, F.col("commit_hash") == F.col("child")).select("parent")).distinct())
        own = front if own is None else cut(own.union(front).distinct())
        front = cut(links.join(own, F.col("child") == F.col("commit_hash"), "left_semi").select(F.col("parent").alias("commit_hash")).distinct().join(own, "commit_hash", "left_anti"))
        if front.isEmpty():
            return own


def commit_range(edges: DataFrame, history: DataFrame, start: str | None, end: str, limit: int | None = None) -> DataFrame:
    """Commits of end's ancestry that aren't in start's, newest first, at most limit."""
    own = ancestors(edges, end)
    if start is not None:
        own = own.join(ancestors(edges, start), "commit_hash", "left_anti")
    out = history.join(own, "commit_hash", "left_semi").orderBy(F.col("commit_date").desc(), "commit_hash")
    return out if limit is None else out.limit(limit)


def merge_cumulative(found: DataFrame, cumulative: DataFrame) -> DataFrame:
    """Findings, and those of the cumulative diff whose path and value aren't among them."""
    return found.unionByName(cumulative.join(found, ["file_path", "value"], "left_anti"), allowMissingColumns=True)


# ---- snapshots ----

#: So many edits are looked for at once; a file that needs more is compared piece by piece.
MOST_EDITS = 512


def kept_lines(a: list[int], b: list[int], most: int = MOST_EDITS) -> list[int]:
    """Places in b of a common subsequence of a and b: a longest one where at most ``most`` edits lead from a to b.

    Greedy search for the shortest edit script, furthest point by diagonal. After ``most`` edits the furthest point is kept
    and the search starts again from there, so that memory grows with the square of ``most`` and time with it and the length.
    """
    out: list[int] = []
    x0, y0 = 0, 0
    while x0 < len(a) and y0 < len(b):
        n, m = len(a) - x0, len(b) - y0
        far, steps, end = {1: 0}, [], None

        def start(far: dict[int, int], k: int) -> tuple[int, int]:
            """Where diagonal k goes on with one edit more, and the diagonal that it comes from; -1 for nowhere."""
            right, down = far.get(k - 1, -1), far.get(k + 1, -1)
            right = right + 1 if 0 <= right < n else -1  # noqa: B023
            down = down if down >= 0 and down - k <= m else -1  # noqa: B023
            return (down, k + 1) if down >= right else (right, k - 1)

        for d in range(most + 1):
            steps.append(dict(far))
            for k in range(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2):
                x, _ = start(far, k)
                if x >= 0:
                    while x < n and x - k < m and a[x0 + x] == b[y0 + x - k]:
                        x += 1
                    if x == n and x - k == m:
                        end = (d, k, x)
                far[k] = x
            if end:
                break
        if not end:
            end = (d, *max(((k, x) for k, x in far.items() if x >= 0 and (k - d) % 2 == 0 and x - k >= 0), key=lambda p: 2 * p[1] - p[0]))
        d, k, x = end
        to, found = (x0 + x, y0 + x - k), []
        for at in range(d, -1, -1):
            first, other = start(steps[at], k)
            found += range(y0 + x - k - 1, y0 + first - k - 1, -1)
            x, k = steps[at].get(other, 0), other
        out += reversed(found)
        x0, y0 = to
    return out


def added_places(old: list[str], new: list[str]) -> list[int]:
    """Places of new's lines that a shortest edit script from old adds: what both begin and end with stays, and lines that only one side has can't, so that the search is for the rest alone."""
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    number: dict[str, int] = {}
    a, b = ([number.setdefault(x, len(number)) for x in side[head : len(side) - tail]] for side in (old, new))
    both = set(a) & set(b)
    place = [i for i, x in enumerate(b) if x in both]
    kept = {place[i] for i in kept_lines([x for x in a if x in both], [b[i] for i in place])}
    return [head + i for i in range(len(b)) if i not in kept]


def tree_diff(old: DataFrame, new: DataFrame, commit_hash: str | None = None, author: str | None = None, date: str | None = None) -> DataFrame:
    """file_path, line_number (in new), line, commit_hash, commit_author, commit_date of the lines that snapshot new has added to snapshot old (path, content), attributed to a commit.

    Files are paired by path. Digests are compared first, so that contents of equal files are neither shuffled nor looked at;
    each other pair is one row's work, in memory of the two texts: see added_places. Moved files count as new. A last line is
    the same with and without its line feed.

    A null content is an empty file, and a null path is a path like others. Of several files with one path in old, the
    least content counts; in new, each is compared with it. Empty snapshots give what the other one says: nothing or all lines.
    """
    plain = lambda files: files.select("path", F.coalesce("content", F.lit("")).alias("content"))
    old, new = plain(old), plain(new)
    digests = [s.select("path", F.sha2("content", 256).alias("digest")) for s in (new, old)]
    same = F.col("a.path").eqNullSafe(F.col("b.path"))
    changed = cut(digests[0].alias("a").join(digests[1].alias("b"), same & (F.col("a.digest") == F.col("b.digest")), "left_anti").select("path").distinct())
    after = new.alias("a").join(changed.alias("b"), same, "left_semi")
    before = old.alias("a").join(changed.alias("b"), same, "left_semi").groupBy("path").agg(F.min("content").alias("before"))
    pairs = after.alias("a").join(before.alias("b"), same, "left").select("a.path", "content", "before")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (after, before) in enumerate(zip(b["content"].to_pylist(), b["before"].to_pylist())):
                now, then = (x.split("\n")[: -1 if x.endswith("\n") or not x else None] for x in (after, before or ""))
                places = added_places(then, now)
                yield pa.RecordBatch.from_arrays([b["path"].take(pa.array([i] * len(places), pa.int64())), pa.array([p + 1 for p in places], pa.int32()), pa.array([now[p] for p in places], pa.string())], ["file_path", "line_number", "line"])

    lines = pairs.mapInArrow(added, "file_path string, line_number int, line string")
    return lines.withColumns({"commit_hash": F.lit(commit_hash), "commit_author": F.lit(author), "commit_date": F.lit(date).cast("timestamp")})
