"""Detection: lines against the rule catalogue, overlaps, generic suppression, scores, findings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate
from operator import or_
from re._constants import ASSERT, ASSERT_NOT, AT, BRANCH, IN, LITERAL, MAX_REPEAT, MIN_REPEAT, RANGE, SUBPATTERN
from re._parser import parse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P
from ..functions import text as X

ENTROPY, TRACE_ENTROPY, MIN_CONFIDENCE = 3.5, 3.0, 0.6
#: Rules are sent to every task: the catalogue is checked to have at most so many.
MOST_RULES = 20_000
ABOUT = {"type_id": T.StringType(), "display_name": T.StringType(), "severity": T.StringType(), "confidence": T.DoubleType(), "is_generic": T.BooleanType(), "is_private_key": T.BooleanType(), "is_conn_string": T.BooleanType()}


# ---- what a line must hold ----

#: Characters of tokens; a rule whose every match holds so many of them side by side needs no other look at lines without.
TOKEN, RUN = "A-Za-z0-9_+/=.~%!$:@-", 20
#: What case folding makes an ASCII letter of, beyond ASCII: lines with one are never ruled out.
FOLDED = "\u0130\u0131\u017f\u212a"
_TOKEN_CODES = frozenset(c for c in range(128) if re.match(f"[{TOKEN}]", chr(c)))


def sure_run(regex: str) -> int:
    """A length of token characters side by side that every match of the pattern has; 0 where none is sure."""

    def within(items) -> bool:
        for op, arg in items:
            codes = [arg] if op is LITERAL else range(arg[0], arg[1] + 1) if op is RANGE else [-1]
            if not _TOKEN_CODES.issuperset(codes):
                return False
        return True

    def joined(parts) -> tuple[bool, int, int, int, int]:
        """Only token characters; least number of them; sure run at the start, anywhere, at the end."""
        only, least, head, best, tail = True, 0, 0, 0, 0
        for only_, least_, head_, best_, tail_ in parts:
            best = max(best, best_, tail + head_)
            head = least + head_ if only else head
            tail = tail + least_ if only_ else tail_
            only, least = only and only_, least + least_
        return only, least, head, best, tail

    def part(op, arg) -> tuple[bool, int, int, int, int]:
        if op is LITERAL and arg in _TOKEN_CODES or op is IN and within(arg):
            return True, 1, 1, 1, 1
        if op is SUBPATTERN:
            return tree(arg[-1])
        if op is BRANCH:
            each = [tree(b) for b in arg[1]]
            return (all(x[0] for x in each), *[min(x[k] for x in each) for k in range(1, 5)])
        if op in (MAX_REPEAT, MIN_REPEAT):
            times, inner = min(arg[0], RUN), tree(arg[2])
            return joined([inner] * times) if times and times == arg[1] else joined([*[inner] * times, (inner[0], 0, 0, 0, 0)])
        return op in (AT, ASSERT, ASSERT_NOT), 0, 0, 0, 0

    def tree(nodes) -> tuple[bool, int, int, int, int]:
        return joined(part(op, arg) for op, arg in nodes)

    return tree(parse(regex))[3]


def candidate(line: Column, rules: list[dict]) -> Column:
    """False for lines that no rule can match, without Python: they have no run of RUN token characters, nor an anchor (and a quote where one is needed) of a rule that may do without such a run."""
    has = lambda text, parts: reduce(or_, [F.contains(text, F.lit(a)) for a in parts])
    # a run lies within a word, and only lines with a word so long are searched for one
    out = F.exists(F.split(line, " "), lambda w: F.octet_length(w) >= RUN) & line.rlike(f"[{TOKEN}]{{{RUN}}}") | has(line, FOLDED)
    for needs_quote in (False, True):
        anchors = {a for r in rules if r["needs_quote"] == needs_quote and sure_run(r["regex"]) < RUN for a in r["anchors"]}
        if anchors:
            fewest = sorted(a for a in anchors if not any(b != a and b in a for b in anchors))
            sure = all(a and a.isascii() for a in fewest)
            met = F.exists(F.array(F.lower(line)), lambda low: has(low, fewest)) if sure else F.lit(True)  # noqa: B023  in lower case once
            out = out | (has(line, "'\"") & met if needs_quote else met)
    return out


# ---- matching ----


class Catalogue:
    """Rules as one task uses them: a search for all anchors at once, and patterns that are compiled when first met."""

    def __init__(self, rules: list[dict]):
        import ahocorasick

        self.rules = rules
        self.patterns: dict[int, re.Pattern] = {}
        self.always = [k for k, r in enumerate(rules) if "" in r["anchors"]]
        self.anchors = ahocorasick.Automaton()
        holds: dict[str, list[int]] = {}
        for k, r in enumerate(rules):
            for a in r["anchors"]:
                if a:
                    holds.setdefault(a, []).append(k)
        for a, ks in holds.items():
            self.anchors.add_word(a, ks)
        if holds:
            self.anchors.make_automaton()

    def met(self, line: str) -> list[int]:
        """Numbers of the rules whose anchor the line holds, and a quote where they need one."""
        found = set(self.always)
        if len(self.anchors):
            for _, ks in self.anchors.iter(line.lower()):
                found.update(ks)
        if not found:
            return []
        quote = "'" in line or '"' in line
        return sorted(k for k in found if quote or not self.rules[k]["needs_quote"])

    def matches(self, line: str) -> Iterator[tuple[int, str, int, int]]:
        """(number of the rule, value, start, end), offsets in bytes, by rule and position. The value is group 1 where it took part, else all."""
        at: list[int] | None = None
        for k in self.met(line):
            p = self.patterns.get(k) or self.patterns.setdefault(k, re.compile(self.rules[k]["regex"]))
            for m in p.finditer(line):
                g = 1 if p.groups and m[1] is not None else 0
                if line.isascii():
                    yield k, m[g], m.start(g), m.end(g)
                else:
                    at = at or [0, *accumulate(1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4 for c in line)]
                    yield k, m[g], at[m.start(g)], at[m.end(g)]

    def kept(self, line: str) -> list[tuple[int, str, int, int]]:
        """The matches that no earlier one contains, without generic ones that share their value with a specific one."""
        out: list[tuple[int, str, int, int]] = []
        for m in self.matches(line):
            if not any(s <= m[2] and m[3] <= e for _, _, s, e in out):
                out.append(m)
        specific = [v for k, v, _, _ in out if not self.rules[k]["is_generic"]]
        return [m for m in out if not self.rules[m[0]]["is_generic"] or not any(v in m[1] or m[1] in v for v in specific)]


def _scan(lines: DataFrame, rules: DataFrame, line_col: str, kept: bool) -> DataFrame:
    rows = [r.asDict() for r in rules.orderBy("rule_ord").limit(MOST_RULES + 1).collect()]
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    own = [T.StructField("rule_ord", T.IntegerType()), *(T.StructField(n, t) for n, t in ABOUT.items())]
    found = [T.StructField("value", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    schema = T.StructType([*lines.schema.fields, *own, *found])

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        catalogue = Catalogue(rows)
        about = {"rule_ord": pa.array([r["rule_ord"] for r in rows], pa.int32())} | {n: pa.array([r[n] for r in rows]) for n in ABOUT}
        for b in batches:
            at, hits = [], []
            for i, line in enumerate(b[line_col].to_pylist()):
                if line:
                    new = catalogue.kept(line) if kept else list(catalogue.matches(line))
                    at += [i] * len(new)
                    hits += new
            if hits:
                k, value, start, end = zip(*hits)
                left = b.take(pa.array(at, pa.int64()))
                of = pa.array(k, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*left.columns, *(c.take(of) for c in about.values()), pa.array(value, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                    [*left.schema.names, *about, "value", "start", "end"],
                )

    return lines.filter(candidate(F.col(line_col), rows)).mapInArrow(matched, schema)


def find_matches(lines: DataFrame, rules: DataFrame, line_col: str = "line") -> DataFrame:
    """lines' columns and rule_ord, type_id, display_name, severity, confidence, is_generic, is_private_key, is_conn_string, value, start, end for every match of every rule; offsets in bytes.

    One pass: what no rule can match is left out in the JVM (see candidate); of the rest, which goes to Python in Arrow
    batches, all anchors are looked for at once, and only patterns of rules whose anchor is there, with a quote where they need
    one, are tried. A null line has no matches.
    """
    return _scan(lines, rules, line_col, False)


def scan_lines(lines: DataFrame, rules: DataFrame, line_col: str = "line") -> DataFrame:
    """find_matches, resolve_overlaps and suppress_generic in the same pass: a line's matches are in one place, so that nothing is shuffled."""
    return _scan(lines, rules, line_col, True)


def resolve_overlaps(matches: DataFrame, *keys: str) -> DataFrame:
    """Of a line's matches, those that no earlier one (by rule, then position) contains. keys name the line. A line's matches are few, as lines are at most 5,000 bytes. For matches of any origin; scan_lines does the same while it scans."""
    own = [c for c in matches.columns if c not in keys]
    order = ["rule_ord", "start", "end", *[c for c in own if c not in ("rule_ord", "start", "end")]]
    lines = matches.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("_m"))
    free = F.filter("_m", lambda m, i: ~F.exists(F.slice("_m", 1, i), lambda p: (p["start"] <= m["start"]) & (m["end"] <= p["end"])))
    return lines.select(*keys, F.inline(free)).select(*matches.columns)


def suppress_generic(matches: DataFrame, *keys: str) -> DataFrame:
    """Without generic matches whose value contains, or is contained in, that of a specific match on the line."""
    own = [c for c in matches.columns if c not in keys]
    lines = matches.groupBy(*keys).agg(F.collect_list(F.struct(*own)).alias("_m"))
    kept = F.filter("_m", lambda m: ~m["is_generic"] | ~F.exists("_m", lambda p: ~p["is_generic"] & (F.contains(p["value"], m["value"]) | F.contains(m["value"], p["value"]))))
    return lines.select(*keys, F.inline(kept)).select(*matches.columns)


def score(matches: DataFrame, threshold: float = ENTROPY, comment: Column | None = None) -> DataFrame:
    """Adds entropy (of a connection string's credential, else of the value); confidence * 0.7 below the threshold unless it is a private key, * 0.75 in comments."""
    secret = F.when(F.col("is_conn_string"), X.conn_credential(F.col("value"))).otherwise(F.col("value"))
    entropy = X.shannon_entropy(secret)
    factor = F.when((F.col("_entropy") < threshold) & ~F.col("is_private_key"), 0.7).otherwise(1.0)
    if comment is not None:
        factor = factor * F.when(comment, 0.75).otherwise(1.0)
    return matches.withColumn("_entropy", entropy).withColumn("confidence", F.col("confidence") * factor).withColumnRenamed("_entropy", "entropy")


def scan_scannable(lines: DataFrame, rules: DataFrame, threshold: float = ENTROPY, placeholder: Callable[[Column], Column] = X.is_placeholder) -> DataFrame:
    """Scored matches of lines (line and any other columns) that are short enough and no placeholders. Being a placeholder is costly to tell, so that only lines with matches are asked."""
    short = lines.filter(F.octet_length("line") <= X.MAX_LINE_BYTES)
    return score(scan_lines(short, rules).filter(~placeholder(F.col("line"))), threshold, X.is_comment(F.col("line")))


def findings(lines: DataFrame, rules: DataFrame, threshold: float = ENTROPY, placeholder: Callable[[Column], Column] = X.is_placeholder) -> DataFrame:
    """Flat findings of lines (path, line_number, line, line_before, line_after): one row per match that stays. placeholder tells the lines that hold no real secret."""
    scored = scan_scannable(lines, rules, threshold, placeholder)
    slash = F.concat(F.lit("/"), F.regexp_replace("path", "^/", ""))
    return scored.withColumns(
        {"is_test_file": P.is_test_file(slash), "is_config_file": P.is_config_file(F.col("path")), "is_documentation": P.is_documentation(F.col("path")), "file_extension": P.file_ext(F.col("path")), "redacted_value": X.redact(F.col("value")), "fingerprint": X.fingerprint(F.col("display_name"), F.col("path"), F.col("value"))}
    ).withColumn("severity", P.adjust_severity(F.col("severity"), F.col("is_documentation")))


def nested(flat: DataFrame) -> DataFrame:
    """Findings in the nested form of reports, with an id and a time stamp."""
    return flat.select(
        F.uuid().alias("id"),
        F.struct(F.col("display_name").alias("secret_type"), "value", "redacted_value", "entropy", "severity", "confidence", F.lit(None).cast("boolean").alias("validated")).alias("secret"),
        F.struct(F.col("path").alias("file_path"), "line_number", F.col("start").alias("column_start"), F.col("end").alias("column_end"), F.lit(None).cast("string").alias("commit_hash"), F.lit(None).cast("string").alias("commit_author"), F.lit(None).cast("timestamp").alias("commit_date")).alias("location"),
        F.struct("line_before", F.col("line").alias("line_content"), "line_after", "is_test_file", "is_config_file", "is_documentation", "file_extension").alias("context"),
        F.current_timestamp().alias("timestamp"), F.lit(False).alias("ignored"), F.lit(None).cast("string").alias("ignore_reason"),
    )


def scan_added_lines(history: DataFrame, rules: DataFrame, threshold: float = ENTROPY) -> DataFrame:
    """Findings of added lines (see sources.history): no placeholder, length or comment handling; columns span the line."""
    keys = ("file_path", "line_number", "line", "commit_hash", "commit_author", "commit_date")
    return score(scan_lines(history.select(*keys), rules), threshold).withColumns({"start": F.lit(0), "end": F.octet_length("line") + 1})
