"""Reports that cite by section, and JSON of any shape as sources."""

import json
import random

import pytest
from pyspark.sql import functions as F

from terralog.operators import scorecard

CARD = """Preface with 3.
*Source: `a/b`, `plain`*
## One
Seven is 7, nine is 9 (§4), see Phase 2.
*Source: `a/b` and
`c.md`*
## Two
1. It is 5.
*Source: `gone/x`*
## Three
6
## Four
8
*Source: nothing*
"""


def walk(v, path="$", name=None):
    if isinstance(v, dict):
        for k, x in v.items():
            yield from walk(x, f"{path}.{k}", k)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from walk(x, f"{path}[{i}]", name)
    elif v is not None:
        yield path, name, v


def any_json(r, depth):
    kind = r.choice("osanbl" if depth else "snb")
    if kind == "o":
        return {f"k{i}": any_json(r, depth - 1) for i in range(r.randint(0, 3))}
    if kind in "al":
        return [any_json(r, depth - 1) for _ in range(r.randint(0, 3))]
    return {"s": r.choice(["x", "7%", ""]), "n": r.randint(-9, 9), "b": r.choice([True, None])}[kind]


def test_leaves_equal_a_walk(spark):
    r = random.Random(3)
    values = [any_json(r, 5) for _ in range(60)] + [[], {}, None, 4, "a"]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(99, None)], "id int, j string").select("id", F.parse_json("j").alias("v"))
    got = sorted((x.id, x.path, x.last_key or "", x.scalar) for x in scorecard.leaves(rows, "v").collect())
    text = lambda x: {True: "true"}.get(x, str(x)) if isinstance(x, bool) else str(x)
    assert got == sorted((i, p, k or "", text(x)) for i, v in enumerate(values) for p, k, x in walk(v))
    assert scorecard.leaves(rows.limit(0), "v").count() == 0


def test_sections_and_their_status(spark):
    docs = spark.createDataFrame([(1, CARD), (2, None), (3, ""), (4, "## No source line\n4")], "doc int, text string")
    s = scorecard.sections(docs, "doc", "text")
    assert [(x.section, x.heading, x.cited) for x in s.orderBy("section").collect()] == [(0, "", ["a/b"]), (1, "One", ["a/b", "c.md"]), (2, "Two", ["gone/x"]), (4, "Four", [])]
    sources = spark.createDataFrame([("a/b", "n 3"), ("a/b", "m 7"), ("other", "9 5 8")], "name string, text string")
    got = {x.section: (x.n_cited, x.missing, x.n_checked, x.unverified, x.status) for x in scorecard.check(s, sources, "doc").collect()}
    assert got == {0: (1, "", 1, "", "clean"), 1: (2, "c.md", 2, "9", "warning"), 2: (1, "gone/x", 1, "", "unchecked"), 4: (0, "", 1, "", "uncited")}


@pytest.mark.parametrize("payload", ['{"a": {"b": [1.5, {"c": "12%"}]}}', "[[[0.12]], 1.5]", '{"x7": "1.50"}'])
def test_any_shape_is_a_source(spark, payload):
    rows = spark.createDataFrame([("p/q", payload)], "name string, j string").select("name", F.parse_json("j").alias("v"))
    s = scorecard.sections(spark.createDataFrame([(1, "Now 1.5 or 2.5.\n*Source: `p/q`*\n")], "doc int, text string"), "doc", "text")
    assert scorecard.check(s, scorecard.readable(rows, "v"), "doc").first().unverified == "2.5"


def test_sources_are_made_once_however_often_they_are_cited(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        made.add(1)
        return text

    docs = spark.createDataFrame([(k, f"## A\nIt is {k}, or 77.\n*Source: `a/{k}`, `c.md`*\n## B\nIt is 5.\n*Source: `c.md`*\n") for k in range(6)], "doc long, text string")
    sources = spark.createDataFrame([*((f"a/{k}", f"n {k}") for k in range(6)), ("c.md", "m 5"), ("c.md", "m 6")], "name string, text string").select("name", counted("text").alias("text"))
    got = {(r.doc, r.heading): (r.n_cited, r.n_checked, r.unverified) for r in scorecard.check(scorecard.sections(docs, "doc", "text"), sources, "doc").collect()}
    assert got == {(k, "A"): (2, 2, "77") for k in range(6)} | {(k, "B"): (1, 1, "") for k in range(6)}
    assert made.value == 8
