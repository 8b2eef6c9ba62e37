"""The number checker on a labelled set of its own, its rules one by one, and its scanner against the rule for written numbers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from terralog.operators import grounding

STOCK = '{"depot": "north", "pallets": 1234567, "share": 0.318, "change": [-2.5, 4], "per_day": "12,400", "late": "7.5%"}'
NOTE = "Of 48 lorries 31 came before 9.30, which is 64.6% of them; counted on 2023-03-04."
# Labelled reports: text, sources, numbers that are made up, numbers that the sources have.
CASES = [
    ("The north depot holds 1234567 pallets.", [STOCK], "", "1234567"),
    ("A share of 32% is reserved, 0.32 in short.", [STOCK], "", "32% 0.32"),
    ("Stock fell by -2.5 and rose by 4.0 later.", [STOCK], "", "-2.5 4.0"),
    ("Each day 12,400 pallets move, or 12400.", [STOCK], "", "12,400 12400"),
    ("Only 400 of them are late.", [STOCK], "", "400"),  # the last digits of 12,400: taken for a number of its own
    ("Late: 7.5%, that is 0.075; before it was 8.5%.", [STOCK], "8.5%", "7.5% 0.075"),
    ("31 of 48 lorries came early, 65% of all.", [NOTE], "", "31 48 65%"),
    ("32 of 48 lorries came early, 66.6% of all.", [NOTE], "32 66.6%", "48"),
    ("In 2023 the depot was built, and 2100 is far away.", [NOTE], "", ""),
    ("On 2023-03-04 there were 17 drivers.", [NOTE], "17", ""),
    ("At t+2 the share will be 0.4.", [STOCK, NOTE], "0.4", ""),
    ("Lorries: 48; pallets: 1,234,567; depots: 3.", [STOCK, NOTE], "3", "48 1,234,567"),
    ("Some 30% of the pallets are blue.", [STOCK], "30%", ""),
    ("About a third, 0.3, is reserved.", [STOCK], "", "0.3"),
]


def test_labelled_cases(spark):
    cases = spark.createDataFrame([(k, text, bad.split(), good.split()) for k, (text, _, bad, good) in enumerate(CASES)], "report_id int, text string, fabricated array<string>, grounded array<string>")
    sources = spark.createDataFrame([(k, t) for k, (_, given, *_) in enumerate(CASES) for t in given], "report_id int, text string")
    scored = grounding.case_scores(cases, sources, "report_id", "text").cache()
    assert not scored.where(F.size("unlabelled") > 0).count()
    assert {r.report_id for r in scored.where("not passed").collect()} == {5, 12}  # missed: the hundredth of a percentage is compared at the percentage's decimals, which are few
    n = scored.agg(*(F.sum(c).cast("double").alias(c) for c in ("tp", "fp", "fn", "tn")))
    p, r, f1 = n.select(*grounding.ratios(F.col("tp"), F.col("fp"), F.col("fn"))).first()
    assert tuple(n.first()) == (5, 0, 2, 17) and (round(p, 4), round(r, 4), round(f1, 4)) == (1.0, 0.7143, 0.8333)


PIECES = ["1", "23", "456", "7890", "000", ",", ",", ",", ".", ".", "-", "+", " ", "a", "%"]


def test_scanner_reads_what_the_rule_reads():
    r = random.Random(6)
    number = re.compile(grounding.NUMBER, re.A)
    for _ in range(600):
        source = "".join(r.choice(PIECES) for _ in range(r.randint(1, 12)))
        seen = grounding.written(source)
        around = source + " " + "".join(r.choice(PIECES) for _ in range(4))
        for i in range(len(around)):
            for j in range(i + 1, len(around) + 1):
                token = around[i:j]
                if number.fullmatch(token) and not token.endswith("%"):
                    assert (token in seen) == bool(re.search(rf"(?<![\d.]){re.escape(token)}(?!\d)", source, re.A)), (source, token)
    assert {"234,567", "1,234,567", "567", "1"} <= grounding.written("a 1,234,567 b") and "34,567" not in grounding.written("1,234,567")
    assert len(grounding.written(",".join(["123"] * 5000))) < 50


@pytest.mark.parametrize(("report", "source", "bad"), [
    ("over 1980-2015 rainfall fell", "none", ""), ("2000.0 mm", "2000", ""), ("2 of 3.5", "2.5 and 3.5", ""), ("4 days", "4.5", ""), ("-2015", "none", ""), ("on 2024-5 it rained", "none", ""), ("5 mm", "105 mm and 15", "5"),
    ("1,234.5", "of 1,234.5 t", ""), ("26%", "0.262", ""), ("234,567", "1,234,567", ""), ("34,567", "1,234,567", "34,567"), ("+3", "-3", "+3"), ("3", "-3", ""), ("about 3", "2.5", "3"), ("see MODIS 61", "none", "61"), ("1) first\n2. second", "none", ""), ("7 of 8", "7", "8"),
])
def test_rules(spark, report, source, bad):
    rows = lambda t: spark.createDataFrame([(1, t)], "report_id long, text string")
    assert grounding.check(rows(report), rows(source), "report_id", "text").first().unverified == bad


def test_group_leaves_out_the_own_text(spark):
    d = spark.createDataFrame([(1, "a", "7 and 8"), (2, "a", "8"), (3, "b", "7"), (4, "b", None), (5, None, "9")], "report_id long, source string, text string")
    got = {r.report_id: r.unverified for r in grounding.check(d, d, "report_id", "text", "source").collect()}
    assert got == {1: "7", 2: "", 3: "7", 4: "", 5: "9"}
    assert grounding.check(d.limit(0), d.limit(0), "report_id", "text", "source").count() == 0
