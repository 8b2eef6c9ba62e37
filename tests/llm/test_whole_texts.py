"""Cases in which an operator must look at the whole text or table."""

import random

import regex

from terralog.llm import license_scan, packing, secret_scan
from terralog.llm.queries import tokenizer
from tests.llm.test_operators import odd, prose, table  # noqa: F401


def brute_windows(text, name):
    """The highest coefficient of any run of words."""
    t = license_scan.Templates(license_scan.TEMPLATES, license_scan.THRESHOLD)
    w = license_scan.words([text], license_scan.LETTERS).bytes_of(0)
    return max(t.dice(w[x:y], name) for x in range(len(w)) for y in range(x + 2, min(len(w), x + 2 * len(t.sets[name])) + 1))


def test_notices_within_texts(spark):
    mit, apache, gpl = (license_scan.TEMPLATES[k] for k in ("MIT", "Apache-2.0", "GPL-3.0"))
    around = prose(1, 300), prose(2, 300)
    split = {1: mit.replace("conditions: ", "conditions:\n\n").replace("SOFTWARE. THE", "SOFTWARE.\n\nTHE").replace("Software. THE", "Software.\n\nTHE"), 2: apache.replace("License. You", "License.\n\nYou").replace("2.0 Unless", "2.0\n\nUnless"), 3: gpl.replace("version. This", "version.\n\nThis").replace("PURPOSE. See", "PURPOSE.\n\nSee")}
    rows = [(i, f"{around[0]}\n\n{t}\n\n{around[1]}") for i, t in split.items()]
    rows += [(4, f"{around[0]} released under the MIT license. {around[1]}"), (5, "# " + (around[0] + " " + apache + " " + around[1]).replace(" ", "\n# ")), (6, f"{mit} {mit}\n\n{around[0]}"), (7, " ".join(around))]
    got = [(r.doc_id, r.unit, r.license, round(r.dice, 6)) for r in license_scan.scan(table(spark, rows)).collect()]
    assert {(1, "MIT"), (2, "Apache-2.0"), (3, "GPL-3.0"), (4, "MIT-grant"), (5, "Apache-2.0")} <= {g[::2][:2] for g in got if g[1] == "window" and g[3] > 0.99}
    assert [g[3] for g in got if g[0] == 6 and g[1] == "window" and g[2] == "MIT"] == [1.0, 1.0]
    assert not [g for g in got if g[0] == 7]


def test_windows_are_the_most_alike(spark):
    words = license_scan.TEMPLATES["GPL-2.0-grant"].split()
    texts = [(k, f"{prose(k, 12)} {' '.join(words[:k] + ['odd'] * (k % 3) + words[k:])} {prose(k + 50, 12)}") for k in range(1, len(words))]
    got = {r.doc_id: r.dice for r in license_scan.scan(table(spark, texts)).where("license = 'GPL-2.0-grant' and unit = 'window'").collect()}
    for k, t in texts:
        want = brute_windows(t, "GPL-2.0-grant")
        assert round(got.get(k, 0.0), 9) == (round(want, 9) if want >= license_scan.THRESHOLD else 0.0)


def test_every_occurrence_is_described(spark, odd):
    key, number = "a1b2c3d4e5f6a7b8", "4929123412341234"
    filler = ["", "é ", f"x{key}y/ ", f"{number} {number}.", "word " * 40]
    rows = [(k, f"{a}{b} {key} {c}\n{key},{number}{a}") for k, (a, b, c) in enumerate((a, b, c) for a in filler for b in filler for c in filler)] + [(900, f"{key} {key} " * 300), (901, f"{key}=={key}")]
    got = sorted((r.doc_id, r.start, r.candidate, r.before, r.after) for r in secret_scan.candidates(table(spark, rows + [(None, f"no id {key}")])).where("doc_id is not null").collect())
    want = []
    for i, t in rows:
        for m in regex.finditer(secret_scan.CANDIDATE, t):
            want.append((i, m.start(), m[0], t[max(0, m.start() - 80) : m.start()], t[m.end() : m.end() + 80]))
    assert got == sorted(want)
    assert secret_scan.candidates(odd.limit(0)).count() == 0


def test_a_later_place_tells_a_secret(spark):
    rng = random.Random(4)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    rows = [(k, f'and the token = "{h}" was') for k, h in enumerate(hexes[:30])] + [(100 + k, f"in the commit sha {h} there") for k, h in enumerate(hexes[30:])]
    rows += [(200, f'in the commit sha {hexes[0]} there, the token = "{hexes[0]}" was')]
    docs = table(spark, rows)
    found = {r.doc_id: (r.start, r.is_secret) for r in secret_scan.scan(docs).collect()}
    assert found[200] == (rows[-1][1].index(hexes[0]), True) and not found[100][1]
    assert hexes[0] not in {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}[200]


def test_repeated_ids_are_dealt_over_groups(spark):
    for rows in ([(None, f"word{k} and more") for k in range(400)], [(7, "the same few words")] * 400):
        p = packing.pack(table(spark, rows), tokenizer("word_bpe_49k.json"), size=64, group_sequences=3).toPandas()
        ids = int(p.length.sum())
        groups = max(1, -(-ids // (3 * 64)))
        of = (p.sequence_id % groups).value_counts()
        assert len(p) == 400 and groups >= 8 and len(of) > groups / 2 and of.max() < 100


def test_groups_of_short_documents_fill_many_sequences(spark):
    p = packing.pack(table(spark, [(k, f"word{k} and more") for k in range(6000)]), tokenizer("word_bpe_49k.json"), size=64).toPandas()
    assert p.sequence_id.nunique() <= 1.01 * -(-int(p.length.sum()) // 64)


def test_the_forest_mends_the_rule_on_held_out_findings(spark):
    """Templates, labels and most of their words are not among those trained on."""
    held = secret_scan.labelled_findings(spark, secret_scan.findings.HELD_OUT)
    scored = secret_scan.score(held.withColumn("rule", secret_scan.by_rule()), secret_scan.train(secret_scan.labelled_findings(spark))).toPandas()
    truth = scored.is_secret == 1

    def ratios(said):
        return (said & truth).sum() / max(1, said.sum()), (said & truth).sum() / truth.sum()

    rule, forest = ratios(scored.rule), ratios(scored.score >= 0.5)
    print("rule", rule, "forest", forest, scored.assign(wrong=(scored.score >= 0.5) != truth).groupby("template").wrong.mean().to_dict())
    assert len(scored) > 0.9 * 60 * len(secret_scan.findings.HELD_OUT)
    assert forest[0] > rule[0] and forest[1] > rule[1] and min(forest) > 0.8


def test_short_values_and_inner_places(spark):
    rows = [(1, "so password = hunter2 it was"), (2, "password: correct-horse-battery-staple\n"), (3, 'id zzabc123def456 and api_key = "abc123def456" end'), (4, None), (5, "")]
    found = {(r.doc_id, r.candidate, r.start) for r in secret_scan.candidates(table(spark, rows)).collect()}
    assert {(1, "hunter2", 14), (2, "correct-horse-battery-staple", 10), (3, "abc123def456", rows[2][1].index('"') + 1)} <= found
    hit = {r.doc_id for r in secret_scan.scan(table(spark, rows)).where("is_secret").collect()}
    assert {1, 2} <= hit and secret_scan.scan(table(spark, rows[3:])).count() == 0


def worn(text, rng, share):
    """A notice as it is found: words changed, dropped or doubled, and lines wrapped at some width."""
    out, width = [], rng.randint(40, 90)
    for w in text.split():
        kind = rng.random() / share
        out += [w] if kind >= 1 else [["other"], [], [w, w]][int(3 * kind)]
    lines, line = [], ""
    for w in out:
        line, full = (w, line) if len(line) + len(w) > width else (f"{line} {w}".strip(), "")
        lines += [full] if full else []
    return "\n".join([*lines, line])


def test_recall_of_planted_notices(spark):
    """Whole notices of every license, a twentieth of their words worn, in longer texts; texts without one stay clear."""
    rng = random.Random(9)
    names = [k for k, t in license_scan.TEMPLATES.items() if len(t.split()) > 20]
    rows = [(1000 * i + k, f"{prose(k, 60)}\n\n{worn(license_scan.TEMPLATES[n], rng, 0.05)}\n\n{prose(k + 90, 60)}") for i, n in enumerate(names) for k in range(12)]
    clear = [(900_000 + k, prose(k + 500, 200)) for k in range(40)]
    found = {(r.doc_id, r.license) for r in license_scan.scan(table(spark, rows + clear)).collect()}
    hit = [(i, names[i // 1000]) in found or (names[i // 1000] == "ISC" and (i, "ISC-full") in found) for i, _ in rows]
    assert sum(hit) >= 0.9 * len(rows) and not [f for f in found if f[0] >= 900_000]


def plain_dice(a, b):
    """Of two texts, word by word."""
    def pairs(t):
        w = regex.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t))
        return {tuple(w[k : k + 2]) for k in range(len(w) - 1)}
    x, y = pairs(a), pairs(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def test_dice_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [(k, worn(t, rng, s).replace("\n", " ")) for k, (t, s) in enumerate((t, s) for t in license_scan.TEMPLATES.values() for s in (1e-9, 0.1, 0.3))]
    got = {r.doc_id: (r.license, r.dice) for r in license_scan.scan(table(spark, texts)).where("unit = 'line'").collect()}
    for k, t in texts:
        best = max((plain_dice(t, x), n) for n, x in license_scan.TEMPLATES.items())
        assert (k in got) == (best[0] >= license_scan.THRESHOLD) and (k not in got or abs(got[k][1] - best[0]) < 1e-9)


def test_flat_trees_equal_a_walk():
    import numpy as np

    from terralog.llm import boosting

    rng = np.random.default_rng(1)
    x = rng.random((500, 4))
    y = ((x[:, 0] > 0.4) & (x[:, 1] < 0.7) ^ (rng.random(500) < 0.05)).astype(float)
    f = boosting.fit(x, y, [1, -1, 0, 0])

    def walked(row):
        total = f.base
        for at in f.roots:
            while f.left[at] != at:
                at = f.left[at] if row[f.feature[at]] <= f.threshold[at] else f.right[at]
            total += f.value[at]
        return 1 / (1 + np.exp(-total))

    assert len(f.roots) > 10 and np.allclose(f.predict(x[:60]), [walked(row) for row in x[:60]])
