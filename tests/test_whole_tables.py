"""Queries that must read their whole tables."""

import os

import pytest
from pyspark.sql import functions as F

from terralog.operators import corpus
from terralog.plans import catalogue, climate

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_part_series_hold_all_lines(spark):
    want = climate.table(spark, SF, "lineitem").agg(F.sum("l_extendedprice")).first()[0]
    rows = catalogue.queries()["series_causal_outliers_whole"](spark, SF)
    assert rows.agg(F.sum("value")).first()[0] == pytest.approx(want, rel=1e-9)
    assert rows.where("value = 0").count() > 0
    train = climate.parted(rows).where("part = 'train'").select("split_id", "entity_id").distinct()
    assert catalogue.queries()["heat_zero_inflation_whole"](spark, SF).count() == train.count()


def test_customer_series_hold_all_orders(spark):
    want = climate.table(spark, SF, "orders").agg(F.sum("o_totalprice")).first()[0]
    rows = catalogue.queries()["series_interpolated_whole"](spark, SF)
    assert rows.agg(F.sum("value")).first()[0] == pytest.approx(want, rel=1e-9)
    assert rows.where("value is null and filled is not null").count() > 0


def test_layers_hold_all_days(spark):
    e = climate.table(spark, SF, "events").select("event_type", F.to_date("ts")).distinct().count()
    assert catalogue.queries()["source_live_union_whole"](spark, SF).count() == e


@pytest.mark.parametrize("n", [2001, 2100, 2120, 4000, 4001, 285_000])
def test_long_sentences_are_kept_whole(n):
    text = "".join(chr(97 + k % 26) for k in range(n))
    got = corpus.pack(text)
    assert "".join(got) == text and all(corpus.LEAST_CHUNK <= len(c) <= corpus.MOST_CHUNK for c in got)
    assert "".join(corpus.pack(f"{text}. {'Next one. ' * 20}")).replace(" ", "") == f"{text}.{'Nextone.' * 20}"
