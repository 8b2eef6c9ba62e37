"""The ten operators on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terralog.llm import base, boosting, components, decontaminate, hashing, jaccard_join, license_scan, packing, quality_classifier, quality_rules, secret_scan, token_store, tokens, toxicity, warc
from terralog.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, key long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.0, 1, 2) for i, t in rows], SCHEMA)


def ws(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "re", "tion", "the", "er", "oué", "sch"]) for _ in range(r.randint(1, 4))) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two three four"), (6, prose(1, 60)), (7, prose(1, 60)), (8, prose(2, 30_000)), (9, "İstanbul ÀÉ x  y\n\nz '' 12,5%"), (9, "İstanbul ÀÉ x  y\n\nz '' 12,5%"), (None, "no id here at all"), (10, "A. " * 200)]


@pytest.fixture(scope="session")
def odd(spark):
    return table(spark, ODD).cache()


@pytest.fixture(scope="session")
def labels(spark):
    good = [(100 + i, prose(i, 80), 1, 0) for i in range(40)]
    bad = [(200 + i, " ".join(w + "###" for w in prose(i, 60).split()), 0, 0) for i in range(40)]
    toxic = [(300 + i, prose(i, 20) + " wretched " + prose(i + 500, 20) + " wretched scoundrel", 1, 1) for i in range(40)]
    rows = good + bad + toxic
    return table(spark, [(i, t) for i, t, *_ in rows]), spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(100, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_rules_counts(odd, labels):
    docs, lab = labels
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.apply(odd, quality_rules.fit([], {})).collect())
    want = []
    for i, t in ODD:
        w, lines = ws(t), (t or "").split("\n")
        g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        c = Counter(g)
        cover = {j for k, x in enumerate(g) if c[x] > 1 for j in range(k, k + 3)}
        dup = sum(1 for k, x in enumerate(lines) if ws(x) and x in lines[:k])
        want.append((i or 0, len(w), sum(map(len, w)), sum((t or "").count(s) for s in "#*$%&|<>"), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    assert got == sorted(want)
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs, lab).collect()}
    assert sum(kept[100 + i] for i in range(40)) >= 38 and sum(kept[200 + i] for i in range(40)) <= 2


def test_boosting_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((600, 2))
    y = ((x[:, 0] + 0.3 * rng.random(600) < 0.6) ^ (rng.random(600) < 0.1)).astype(float)
    f = boosting.fit(x, y, [-1, 0])
    grid = np.column_stack([np.linspace(0, 1, 50), np.full(50, 0.4)])
    assert (np.diff(f.predict(grid)) <= 1e-12).all() and ((f.predict(x) > 0.5) == y).mean() > 0.8


@pytest.mark.parametrize(("operator", "label"), [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, odd, labels, operator, label):
    docs, lab = labels
    out = operator.classify(docs, lab).toPandas().merge(lab.toPandas().dropna().drop_duplicates(), on="doc_id")
    parts, held = (4, 2) if label == "quality" else (5, 0)
    assert [zlib.crc32(str(int(i)).encode()) % parts == held for i in out.doc_id] == list(out.held_out)
    test = out[out.held_out]
    assert (test.predicted == test[label]).mean() > 0.8
    rest = operator.classify(odd, lab).toPandas()
    assert len(rest) == len(ODD) and rest.score.between(0, 1).all()
    assert len(set(rest[rest.doc_id == 9].score)) == 1
    assert operator.classify(odd.limit(0), lab.limit(0)).count() == 0


def test_keep_filters_in_place(labels):
    docs, lab = labels
    out = quality_classifier.keep(docs, lab)
    ids = {r.doc_id for r in out.collect()}
    assert out.columns == docs.columns and len(ids & set(range(100, 140))) > 30 and len(ids & set(range(200, 240))) < 10


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = ws("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def edited(words, n, seed):
    r, out = random.Random(seed), list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"new{r.random()}"
    return " ".join(out)


def test_jaccard_join_equals_brute_force(spark):
    rows = [(i, t) for i, t in ODD if i is not None and i != 9 and i != 8] + [(9, "x Y z")]
    for size in (3, 5, 6, 9, 14, 24, 40, 150):
        b = prose(size, size).split()
        rows += [(1000 * size + k, edited(b, k % 5, k)) for k in range(12)] + [(1000 * size + 20, " ".join(b).upper()), (1000 * size + 21, " ".join(b[:-1])), (1000 * size + 22, " ".join(b + ["end"]))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(table(spark, rows)).collect())
    assert got == brute_components(rows)


def test_jaccard_join_odd_tables(spark, odd):
    out = jaccard_join.join(odd).toPandas()
    assert len(out) == len(ODD) and out[out.doc_id.isna()].component_id.isna().all()
    assert out[out.doc_id == 7].component_id.tolist() == [6] and out[out.doc_id == 3].n_shingles.tolist() == [0]
    assert jaccard_join.join(odd.limit(0)).count() == 0
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns and 7 not in {r.doc_id for r in kept.collect()}


def test_keys_meet_for_all_linked_sizes():
    rng = np.random.default_rng(3)
    for n in [*range(1, 40), 61, 62, 63, 100, 101, 259, 260, 700]:
        for _ in range(4):
            h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            for gone in {0, n // 10, n // 5}:
                for new in {0, n // 20, n // 10, n // 4}:
                    o = np.unique(np.r_[rng.permutation(h)[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)])
                    same = len(np.intersect1d(h, o))
                    if len(o) and 100 * same >= 80 * (len(h) + len(o) - same):
                        assert len(np.intersect1d(jaccard_join.keys(h), jaccard_join.keys(o)))


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(500, 500)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and 500 not in got
    for u, v in edges[60:-1]:
        if u != v:
            assert got[u] == got[v] <= min(u, v)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_secrets(spark, odd):
    rng = random.Random(1)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    keys = ["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(30)]
    rows = [(i, f'and the token = "{hexes(40)}" was') for i in range(30)] + [(100 + i, f"a key {k} of the") for i, k in enumerate(keys)]
    rows += [(200 + i, f"paid with {rng.randrange(10**15, 10**16)} there") for i in range(30)] + [(300 + i, f"see src/build/part{i}/module-v{i}00200/readme for more") for i in range(30)]
    docs = table(spark, rows)
    out = secret_scan.scan(docs).toPandas()
    hit = set(out[out.is_secret].doc_id)
    assert hit == set(range(30)) | set(range(100, 130))
    first = out[out.doc_id == 100].iloc[0]
    assert rows[30][1][int(first.start) :].startswith(first.candidate)
    red = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert "AKIA" not in red[100] and secret_scan.MASK in red[0] and red[200] == dict(rows)[200]
    assert secret_scan.redact(docs).columns == docs.columns
    assert secret_scan.scan(odd.limit(0)).count() == 0 and secret_scan.redact(odd).count() == len(ODD)
    given = spark.createDataFrame([("zzz999zzz999", "pin = ", "", 1), ("abc123abc123", "of ", " to", 0)] * 5, "candidate string, before string, after string, is_secret int")
    assert secret_scan.scan(docs, given).count() == len(out)


SPECIAL = [(11, "<|endoftext|> x"), (12, "!!! a<|startoftext|>b <|endoftext|>"), (13, "!")]
TEXTS = [t for _, t in ODD if t] + ["a", " a", "a ", "a\n\nb", "it's 'tis 12 3a4", "x\ty", "<|endoftext|> x", "don't!!! a,b. c*** d's", "\n", "日本 語", "a \n b", "ß ẞ ﬁ"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    e = tokens.Encoder(tokenizer(name))
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in Tokenizer.from_file(tokenizer(name)).encode_batch(TEXTS, add_special_tokens=False)]
    assert list(e.ids(TEXTS)) == want and list(e.ids(TEXTS + [""])) == [*want, b""]
    assert [list(e.ids([t])) for t in TEXTS] == [[w] for w in want] and list(e.ids(["", ""])) == [b"", b""] and list(e.ids([])) == []


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (7, 1), (1000, 3), (5000, 50_000)):
        ids = rng.integers(0, top, n).astype("<u4")
        docs, lengths, m = token_store.from_file(token_store.to_file([3, None], [n, 0], ids))
        assert docs == [3, None] and lengths.tolist() == [n, 0] and (m.to_ids() == ids).all()
        for i in range(0, n, max(1, n // 20)):
            assert m.access(i) == ids[i] and m.rank(int(ids[i]), i) == int((ids[:i] == ids[i]).sum())
        for t in set(ids[:5].tolist()) | {top + 9}:
            ends = np.r_[0, rng.integers(0, n + 1, 50), n]
            assert m.ranks(t, ends).tolist() == [m.rank(t, int(x)) for x in ends] == [int((ids[:x] == t).sum()) for x in ends]
            assert m.occurrences(t) == np.flatnonzero(ids == t).tolist() and m.count(t) == int((ids == t).sum())
    with pytest.raises(ValueError):
        token_store.from_file(token_store.to_file([1], [2], np.array([5, 6], "<u4"))[:-1])


def test_token_store(spark, odd):
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    odd = odd.unionByName(table(spark, SPECIAL))
    rows = sorted([(i, t or "") for i, t in ODD + SPECIAL], key=lambda x: (x[0] is not None, x[0] or 0))
    want, at = [], 0
    for i, t in rows:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes()), int((ids == 0).sum())))
        at += len(ids)
    path = base.work_dir(spark) + "-shards"
    got = token_store.read_back(token_store.write(odd, tokenizer("byte_bpe_50k.json"), path, shard_ids=500), path)
    assert sorted((r.doc_id or -1, r.start, r.n_tokens, r.ids_crc32, r.n_end_ids) for r in got.collect()) == sorted((i or -1, *x) for i, *x in want)
    assert token_store.encode(odd.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0


def test_licenses(spark, odd):
    rows = [(1, "Foo bar.\nReleased under the MIT License.\nmore text"), (2, license_scan.TEMPLATES["GPL-3.0"].replace(". ", ".\n")), (3, "released, under the mit license!"), (4, "under the table")]
    got = {(r.doc_id, r.unit, r.first_line, r.license) for r in license_scan.scan(table(spark, rows)).collect()}
    assert {(1, "line", 1, "MIT-grant"), (2, "paragraph", 0, "GPL-3.0"), (3, "line", 0, "MIT-grant")} <= got and not [g for g in got if g[0] == 4]
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(odd.limit(0)).count() == 0 and license_scan.scan(odd, {}).count() == 0


def test_decontamination_both_ways(spark, odd):
    items = [(1, prose(50, 30)), (2, prose(51, 12)), (3, "alpha beta"), (4, ""), (5, None), (None, "alpha")]
    long = prose(52, 5000)
    rows = [(20, long + " " + "".join(c.upper() if c.isascii() else c for c in items[0][1]) + " " + long), (21, items[0][1] + " " + items[1][1]), (22, "an ALPHA  beta there"), (23, edited(items[0][1].split(), 1, 1)), (24, edited(items[0][1].split(), 6, 2)), (25, long), (21, items[1][1])] + ODD
    docs, bench = table(spark, rows), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    want = set()
    for i, t in rows:
        for k, it in items:
            if i is None or k is None:
                continue
            s = decontaminate.shingles_of(it or "")
            shared = sum(x in b" " + b" ".join(hashing.words([t or ""]).bytes_of(0)) + b" " for x in s)
            if s and 100 * shared >= 80 * len(s):
                want.add((i, k, shared, len(s)))
    for limit in (10**9, 0):
        got = {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontaminate.matches(docs, bench, broadcast_chars=limit).collect()}
        assert got == want and {(20, 1), (21, 2), (22, 3)} <= {g[:2] for g in got}
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and 25 in {r.doc_id for r in kept.collect()} and 20 not in {r.doc_id for r in kept.collect()}
    assert decontaminate.matches(odd.limit(0), bench.limit(0)).count() == 0


def test_warc(spark):
    big = "é<p>" * 9000
    pages = [(1, "http://a", "x" * 1000), (2, "http://b", "x" * 1000), (3, None, big), (4, "u", big + "!"), (5, "u v\n", "short"), (6, "u", "short"), (7, "u", None), (8, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n0\r\n\r\n"), (None, "u", "y" * 2000), (9, "u", big)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest long")
    out = warc.archive(df).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == len(pages) and set(got) == {None, *range(1, 10)}
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert [got[i].record_type for i in range(1, 10)] == ["revisit", "response", "revisit", *["response"] * 6] and got[None].record_type == "response"
    assert got[1].refers_to == 2 and got[3].refers_to == 9 and got[2].refers_to is None
    assert warc.archive(df.limit(0)).count() == 0
    twice = warc.archive(df.unionByName(df).unionByName(df.where("page_id = 1").withColumn("html", F.lit("z" * 3000)))).collect()
    assert len(twice) == 2 * len(pages) + 1
    assert sorted(r.record_type for r in twice if r.page_id == 2) == ["response", "revisit"] and {r.refers_to for r in twice if r.page_id == 2} == {None, 2}
    assert sorted((r.payload_bytes, r.record_type) for r in twice if r.page_id == 1) == [(1000, "revisit"), (1000, "revisit"), (3000, "response")]
    assert sorted(r.record_type for r in twice if r.page_id is None) == ["response", "revisit"] and [r.record_type for r in twice if r.page_id == 7] == ["response"] * 2
    path = base.work_dir(spark) + "-warc"
    warc.write(df, path)
    recs = warc.records(spark, path)
    kept = recs.where("not (record like '9/%' and record_type <> 'revisit' and coalesce(number, 1) = 2)")
    broken = warc.payloads(kept.where("record_type <> 'revisit'")).where("failure is not null").collect()
    assert [r.record.split("/")[0] for r in broken] == ["9"]
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.reassembled([(1, b"a"), (3, b"b")], 2)


def test_capacities_find_the_tightest():
    r, tree, held = random.Random(3), packing.Capacities(64), []
    for step in range(500):
        need = r.randint(1, 64)
        found, best = tree.fit(need), min((c for c, _ in held if c >= need), default=None)
        assert (found[0] if found else None) == best
        if found:
            held.remove(found)
        tree.add(room := r.randint(1, 64), step)
        held.append((room, step))


def test_packing(spark, odd):
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in ODD + SPECIAL}
    p = packing.pack(odd.unionByName(table(spark, SPECIAL)), tokenizer("word_bpe_49k.json")).toPandas()
    for r in p[p.doc_id.notna()].itertuples():
        part = ids[int(r.doc_id)][r.start : r.start + 4096]
        assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(np.array(part, "<u4").tobytes())) and r.start == 4096 * r.piece
    total = sum(len(ids[i]) for i, _ in ODD + SPECIAL)
    assert p.length.sum() == total and p.sequence_id.nunique() == -(-total // 4096)
    for _, g in p.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096
    assert p[p.doc_id == 8].sort_values("piece").start.tolist() == [4096 * k for k in range((p.doc_id == 8).sum())]
    assert packing.pack(odd.limit(0), tokenizer("word_bpe_49k.json")).count() == 0
    seqs = packing.pack_texts(table(spark, [(1, "one two"), (2, "three")]), tokenizer("word_bpe_49k.json")).collect()
    assert len(seqs) == 1 and len(seqs[0].ids) == 5
    every = sorted(x for r in packing.pack_texts(odd, tokenizer("word_bpe_49k.json")).collect() for x in r.ids)
    assert every == sorted(x for _, t in ODD for x in [*library.encode(t or "", add_special_tokens=False).ids, 1])
