"""Dual-tree search against scoring every document, by the definition, on tables with odd rows and ties."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from terralog.llm import lexical_search as ls
from terralog.llm import queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out, of = [], {}
    for i, t in items:
        if i is not None:
            of.setdefault(i, set()).update(terms(t))
    for i, own in of.items():
        scored = []
        for d, c in docs:
            m = 10 + 90 * sum(c.values()) * n_docs // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def text(r, n, language):
    return " ".join(f"{language}{int(r.paretovariate(0.7)) % 400}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    items = [(i, text(r, 20, "ab"[i % 2])) for i in range(60)] + [(100, None), (101, ""), (102, "!? --"), (None, "a1 a2"), (103, "a1 nowhere"), (103, "b2 b3 b3"), (104, "ÀÉ a7_B9 İx"), (104, "ÀÉ a7_B9 İx")]
    docs = [(i, text(r, r.choice([3, 30, 80, 300]), "ab"[i // 300])) for i in range(600)]
    docs += [(700 + i, items[i % 5][1]) for i in range(40)] + [(800, None), (801, ""), (802, "...\t,"), (None, items[0][1]), (0, docs[0][1]), (803, text(r, 30_000, "a")), (804, "ÀÉ, A7 b9-İx İX"), (-5, items[1][1].upper())]
    return docs, items


def tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1.0, 5) for i, t in docs], "doc_id long, text string, score double, rank int").repartition(5)
    return d, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


def result(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize(("k", "chars"), [(10, ls.GROUP_CHARS), (3, 2500)])
def test_search_equals_scoring_all(spark, rows, k, chars, monkeypatch):
    monkeypatch.setattr(ls, "SEED_DOCS", 100)
    docs, items = rows
    assert result(ls.search(*tables(spark, docs, items), k, chars)) == plain(docs, items, k)


def test_sql_says_the_same(spark, rows):
    docs, items = rows
    con = duckdb.connect()
    for name, of, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", [list(r) for r in of if r[0] is not None and not (name == "documents" and r == docs[0])])
    found = con.execute(queries.ORACLE_SQL["op11_lexical_search"]).fetchall()
    once = [r for r in docs if r != docs[0]]
    assert sorted(found) == plain(once, items) == result(ls.search(*tables(spark, once, items)))


def test_empty_tables(spark, rows):
    docs, items = rows
    for d, i in (([], items), (docs, []), ([], []), ([(1, None)], items), (docs, [(1, "nowhere else")])):
        assert ls.search(*tables(spark, d, i)).count() == 0


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(2)
    n_terms, n_docs = 400, 512
    own = [np.sort(rng.choice(200, 12, replace=False) + 200 * (i % 2)) for i in range(64)]
    weight = rng.integers(0, 5000, n_terms)
    u = np.where(rng.random((n_terms, n_docs)) < 0.05, rng.integers(1, 10**6, (n_terms, n_docs)), 0)
    u[:200, : n_docs // 2] = u[200:, n_docs // 2 :] = 0
    for i, t in enumerate(own):  # twelve near copies of each item
        u[t, rng.choice(n_docs // 2, 12, replace=False) + (n_docs // 2 if i % 2 == 0 else 0)] = 900_000
    order = np.concatenate(ls.split(u.T > 0, ls.LEAF_DOCS))
    tree, best = ls.ItemTree(own, weight), ls.Best(64, 10)
    dense = u[np.ix_(tree.terms, order)]
    scored = ls.search_batch(tree, 0, dense.astype(tree.kind), order, best)
    for i, t in enumerate(own):
        s = weight[t] @ u[t]
        want = np.lexsort((np.arange(n_docs), -s))[:10]
        assert best.found[i][1].tolist() == want[s[want] > 0].tolist()
    assert scored < 0.65 * 64 * n_docs


def test_shares_are_exact_for_large_counts():
    n, tf = np.array([10**7]), np.array([3])
    assert ls.saturated(tf, n, 10**12, 10**14)[0] == 3 * 10**9 // (3000 + 8 * (10 + 90 * 10**7 * 10**12 // 10**14))
