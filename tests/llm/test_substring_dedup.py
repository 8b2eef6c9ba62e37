"""Repeated passages by FM-index shards against the definition, with odd rows, ties, runs of one word and hot passages."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from terralog.llm import fm_index, queries
from terralog.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window=20):
    """By the definition: rows of one id and one text are one document, others of one id are in order of their texts' hashes."""
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        w = WORD.findall(t or "")
        gone = set()
        for s in range(len(w) - window + 1):
            x = tuple(w[s : s + window])
            gone |= set(range(s, s + window)) if x in seen else set()
            seen.add(x)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, t] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return Counter((i, *out[i, t]) for i, t in rows)


def prose(r, n):
    return " ".join(r.choice("abcdefgh") * r.randint(1, 3) + str(r.randint(0, 300)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    passages = [prose(r, n) for n in (19, 20, 21, 45, 120, 700)]
    rows = []
    for i in range(200):
        parts = [prose(r, r.randint(0, 60)) for _ in range(3)]
        for k in r.sample(range(6), 2):
            parts.insert(r.randint(0, 3), passages[k] if r.random() < 0.8 else " ".join(passages[k].split()[r.randint(0, 9) : -r.randint(1, 9)]))
        rows.append((i * 3, r.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(1, rows[50][1])]  # copies, one of them before its source
    rows += [(1100, "x " * 500), (1101, "x " * 19), (1102, "y z " * 300), (1103, "x " * 20), (1104, " ".join(rows[3][1].split()[:19]))]
    rows += [(1200, None), (1201, ""), (1202, " \n\t\x0b\x0c\r"), (1203, "ünï  words " * 30), (rows[9][0], rows[9][1]), (None, rows[12][1]), (None, prose(r, 50))]
    return [*rows, (1300, prose(r, 30_000) + " " + passages[5])]


def result(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


@pytest.mark.parametrize(("hot", "shard", "seen"), [(sd.HOT, sd.SHARD_BYTES, sd.SEEN_BYTES), (3, 3000, 2000)])
def test_removal_equals_the_definition(spark, rows, hot, shard, seen, monkeypatch):
    monkeypatch.setattr(sd, "SHARD_BYTES", shard)
    monkeypatch.setattr(sd, "SEEN_BYTES", seen)
    df = spark.createDataFrame([(i, t, 5, "k", 0) for i, t in rows], "doc_id long, text string, key long, d1 string, at int").repartition(6)
    assert result(sd.deduplicate(df, hot=hot)) == plain(rows)


def test_sql_says_the_same(rows):
    con = duckdb.connect()
    once = [r for k, r in enumerate(rows) if r[0] is not None and r[0] not in {x[0] for x in rows[:k]}]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in once])
    assert Counter(con.execute(queries.ORACLE_SQL["op12_substring_dedup"]).fetchall()) == plain(once)


def test_small_tables(spark):
    schema = "doc_id long, text string"
    assert sd.deduplicate(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(1, None)], [(1, "a b")], [(2, "a " * 20), (1, "a " * 20)], [(5, "p q " * 11)] * 3):
        assert result(sd.deduplicate(spark.createDataFrame(rows, schema))) == plain(rows)


@pytest.mark.parametrize("alphabet", [1, 2, 50])
def test_index_against_plain_search(alphabet):
    rng = np.random.default_rng(alphabet)
    parts = [rng.integers(1, alphabet + 1, rng.integers(6, 40)) for _ in range(30)]
    parts += [parts[3], np.r_[parts[4], parts[5]]]
    text = np.concatenate([np.r_[p, 0] for p in parts])
    index = fm_index.FMIndex(text, 6)
    places = {}
    for s in range(len(text) - 5):
        for n in range(1, 7):
            places.setdefault(tuple(text[s : s + n]), []).append(s)
    ends = np.array([s + 6 for s in range(len(text) - 5) if 0 not in text[s : s + 6]])
    length, earliest = index.matches(ends)
    for e, n, first in zip(ends.tolist(), length.tolist(), earliest.tolist(), strict=True):
        assert n == max([k for k in range(1, 7) if len(places[tuple(text[e - k : e])]) > 1], default=0)
        assert first == (places[tuple(text[e - 6 : e])][0] if n == 6 else -1)
    lengths = np.array([len(p) for p in parts])
    found = fm_index.repeated_windows(text, np.cumsum(lengths + 1) - lengths - 1, lengths - 5, 6, stride=4)
    assert found.tolist() == [e - 6 for e in ends.tolist() if places[tuple(text[e - 6 : e])][0] < e - 6]


def test_pieces_cover_each_window_once():
    r = random.Random(4)
    texts = ["", "a b", prose(r, 20), prose(r, 333), "x " * 400]
    of, key, again, first, n, b, e = sd.pieces(texts)
    for k, t in enumerate(texts):
        w = WORD.findall(t)
        mine = np.flatnonzero(of == k)
        assert again[mine].any() == (k == 4)
        starts = [s for i in mine for s in range(first[i], first[i] + n[i])]
        assert starts == list(range(max(0, len(w) - 19)))
        for i in mine:
            assert WORD.findall(t.encode()[b[i] : e[i]].decode()) == w[first[i] : first[i] + n[i] + 19]
