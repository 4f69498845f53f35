"""Token alignment, ranked search and line dedup against brute force, on odd rows, and on the other way of every size-dependent step."""

import collections
import functools
import hashlib
import math
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_odd_rows import CLASHES, LONG, odd
from tokenizers import Tokenizer

from credsieve.llm import align, lines, ranked
from credsieve.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
STRANGE = ["a", "é", " ", "  ", "\n", " \n", "\t", "<|endoftext|>", "</s>", "▁", "🤦🏼", "12", "word", " word", "ﬁ", " ", "́", "'s", "\r\n", "日本", "\x00", " "]


@pytest.fixture(scope="module")
def tokens():
    return align.Tokens()


def whole(tokens, text):
    found = tokens.encode(text) if text else None
    return found and tuple(x.tobytes() for x in found)


@functools.cache
def library():
    """Ids of whole texts by the libraries themselves."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return lambda t: a.encode(" " + t, add_special_tokens=False).ids, b.encode


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(STRANGE), st.text(max_size=6)), max_size=12))
def test_words_have_the_ids_of_whole_texts(parts):
    t = test_words_have_the_ids_of_whole_texts.tokens = getattr(test_words_have_the_ids_of_whole_texts, "tokens", None) or align.Tokens()
    text = "".join(parts)
    text = text.encode("utf-8", "ignore").decode()
    got, want = t.of([text])[0], whole(t, text)
    assert (got and tuple(x.tobytes() for x in got)) == want
    if want:
        libs = library()
        assert [x.tolist() for x in got] == [f(text) for f in libs]


def test_ids_on_real_texts(spark, tokens):
    a, b = library()
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if r.text]
    kept = tokens.of(texts)
    assert sum(x is not None for x in kept) > 0.9 * len(texts)
    for text, ids in zip(texts, kept):
        if ids:
            assert ids[0].tolist() == a(text) and ids[1].tolist() == b(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans(), st.integers(1, 3)), min_size=1, max_size=200))
def test_stretches_are_cut_at_common_ends(steps):
    a, b, at = [], [], 0
    for x, y, size in steps:
        at += size
        a += [at] * x
        b += [at] * y
    at += 1
    a, b = [*a, at], [*b, at]
    odd, i, j, got = align.irregular(np.array(a), np.array(b)), 0, 0, []
    for k in range(0, len(odd) + 1, 4):
        u, p, v, q = odd[k : k + 4] or (len(a), len(a), len(b), len(b))
        assert a[i:u] == b[j:v] and (p - u, q - v) != (1, 1) and not set(a[u : p - 1]) & set(b[v : q - 1])
        got += [*a[i:u], *a[p - 1 : p][: p - u]]
        i, j = p, q
    assert got == sorted(set(a) & set(b))


def brute_alignment(tokens, rows):
    """Byte ranges and all overlaps, pair by pair."""
    out, holds, each = [], collections.Counter(), []
    for doc_id, text in rows:
        ids = whole(tokens, text)
        links, groups, n = [], [], (0, 0)
        if ids:
            sides = []
            for raw, size in zip(ids, (tokens.size_a, tokens.size_b)):
                at, own = 0, []
                for k in range(0, len(raw), 4):
                    i = int.from_bytes(raw[k : k + 4], "little")
                    own.append((i, at, at + int(size[i])))
                    at = own[-1][2]
                sides.append(own)
            a, b = sides
            n, start = (len(a), len(b)), 0
            links = [(x, y) for x, s, e in a for y, f, g in b if s < g and f < e]
            for end in sorted({e for _, _, e in a} & {e for _, _, e in b}):
                groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in sides))
                start = end
        holds.update(set(links))
        each.append((doc_id, n, groups, links))
    best = collections.defaultdict(int)
    for (x, _), c in holds.items():
        best[x] = max(best[x], c)
    for doc_id, n, groups, links in each:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, *n, len(groups), len(links), sum(holds[p] == best[p[0]] for p in links), sum(holds[p] for p in links), sha))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [align.BROADCAST_PAIRS, 0])
def test_alignment_against_brute_force(spark, tokens, most):
    rows = [(r.doc_id, (r.text or "")[:400]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [(None, "two rows"), (None, "two rows"), (1, None), (2, ""), (3, " "), (4, "▁"), (5, "a  b"), (6, "<|endoftext|> </s>"), (7, "ﬁ n"), (8, "日本 🤦🏼\n")]
    got = align.align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_pairs=most, groups=True).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == brute_alignment(tokens, rows)
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got if r.n_a)


def test_alignment_on_odd_rows(spark):
    got = collections.defaultdict(list)
    for r in align.align_tokenizers(odd(spark)).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == 14 and align.align_tokenizers(odd(spark).filter("false")).count() == 0
    assert all(tuple(got[i][0])[1:] == (0, 0, 0, 0, 0, 0, "") for i in (1, 2)) and got[4][0] == got[4][1]
    long = max(got[9], key=lambda r: r.n_a)
    assert long.n_a > 600_000 and long.n_links == long.n_a + long.n_b - long.n_groups


def brute_ranks(docs, items, k=10):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    own = [(i, collections.Counter(w), len(w)) for i, t in docs if (w := find(t))]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df, out = collections.Counter(w for _, c, _ in own for w in c), []
    for item, text in items:
        scores = []
        for i, c, n in own:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in find(text) if w in c)
            scores += [(-s, i is None, i or 0)] * (s > 0)
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"shard_postings": 3000, "pass_terms": 300, "block_terms": 200}])
def test_ranks_against_brute_force(spark, sizes):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + [(None, "The THE été"), (None, "the"), (1, None), (2, ""), (3, "?! \n"), (2**60 + 1, "qq zz"), (2**60, "qq zz"), (5, "x" * 70_000 + " qq")]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()] + [(None, "qq QQ zz"), (1000, ""), (1001, None), (1002, "unheard")]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = ranked.rank_documents(*(t.select("*", *[F.lit(1).alias(c) for c in ("term", "number", "n", "_row", "score", "terms")]) for t in tables), **sizes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_ranks(docs, items)
    assert ranked.rank_documents(tables[0].filter("false"), tables[1]).count() == ranked.rank_documents(tables[0], tables[1].filter("false")).count() == 0


def test_search_skips(spark):
    """Windows that can't reach the best sums of short lists are skipped in the long lists, with exact results."""
    rng, n = np.random.default_rng(1), 6400
    lists = [np.flatnonzero(rng.random(n) < p) for p in [0.9] * 10 + [0.01] * 4]
    doc, term = np.concatenate(lists), np.repeat(np.arange(14), [len(x) for x in lists])
    impact = rng.integers(1, 100, len(doc)) * np.where(term < 10, 1, 50)
    shard, weight = ranked.Shard(doc, term, impact, n), rng.integers(1, 9, 14)
    assert len(shard.long) == 10 and len(shard.short) == 4
    at, score = shard.top(np.arange(14), weight, 10)
    exact = np.bincount(doc, impact * weight[term], n).astype(int)
    assert score.tolist() == sorted(exact, reverse=True)[:10] and (exact[at] == score).all() and shard.read < 0.5 * len(doc)


def brute_lines(rows, least=2):
    key = lambda x: re.sub("[A-Z]+", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        gone = [len(key(x)) >= 10 and len(h := holders[key(x)]) >= least and min(h, key=lambda j: (j is None, j)) != i for x in parts]
        out.append((i, "\n".join(x for x, g in zip(parts, gone) if not g), len(parts), sum(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [2, 3])
def test_lines_against_brute_force(spark, least):
    common = "\t A line that MANY hold \r"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [(i, f"{common}\nown line number {i}\n\nA line that many hold\n") for i in range(1000, 1100)] + [(None, common), (None, common), (5000, common + "\n\n"), (5000, "a line that many hold"), (5001, None), (5002, ""), (5003, "Été à la plage"), (5004, "été à la plage"), (5005, "short\nshort"), (5006, "\n" * 3)]
    got = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=least)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_lines(rows, least)


def test_lines_on_odd_rows(spark):
    d = odd(spark)
    got = lines.drop_repeated_lines(d).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_lines([(r.doc_id, r.text) for r in d.collect()])
    assert lines.drop_repeated_lines(d.filter("false")).count() == 0 and any(r.text == LONG for r in got) and CLASHES


def test_line_plans_are_native(spark):
    plan = QUERIES["op13_line_dedup"](spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|MapPartitions|BroadcastExchange HashedRelation", plan.split("== Physical Plan ==")[0])
