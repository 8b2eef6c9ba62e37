"""Rows reach Python in batches of bounded bytes where a row holds a text or two whole sets, and workers give memory back."""

import pyarrow as pa
import pytest

from terralog.llm import base, jaccard_join, packing
from terralog.llm.queries import tokenizer
from tests.llm.test_operators import prose

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("usual", [None, "123456"])
def test_batches_are_small_while_a_table_is_stored(spark, usual):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64()), pa.array([b.nbytes], pa.int64())], ["n", "bytes"])

    if usual:
        spark.conf.set(NAME, usual)
    try:
        rows = spark.range(0, 1200, 1, 1).selectExpr("id", "repeat('x', 20000) AS text")
        got = base.stored_in_small_batches(rows.mapInArrow(sizes, "n long, bytes long")).collect()
        assert sum(r.n for r in got) == 1200 and len(got) > 4 and max(r.bytes for r in got) < 1.1 * base.BATCH_BYTES
        assert spark.conf.get(NAME, None) == usual
    finally:
        spark.conf.unset(NAME)


def test_join_sends_small_batches_to_python(spark, monkeypatch):
    """Both steps of the join that send texts or sets store their rows in small batches."""
    stored = []
    small = base.stored_in_small_batches
    monkeypatch.setattr(base, "stored_in_small_batches", lambda df: stored.append(df.columns) or small(df))
    docs = spark.createDataFrame([(k, prose(k % 7, 60)) for k in range(14)] + [(20, prose(1, 60) + " end")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.join(docs).collect()}
    assert got == {**{k: k % 7 for k in range(14)}, 20: 1}
    assert ["u", "v"] in stored and any("keys" in c for c in stored)


def test_packing_forgets_words_and_numbers_pieces_across_batches(spark, monkeypatch):
    """Equal rows are numbered apart whatever a batch holds; a task ends with an empty memory of words."""
    monkeypatch.setattr(base, "BATCH_BYTES", 2000)
    docs = spark.createDataFrame([(1, "some words " * 50)] * 40 + [(2, None)], "doc_id long, text string").coalesce(1)
    p = base.stored_in_small_batches(packing.pieces(docs, tokenizer("word_bpe_49k.json"), 1, 4096))
    assert sorted(r.nth for r in p.where("doc_id = 1").collect()) == list(range(40))

    def known(batches):
        from terralog.llm.tokens import encoder

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encoder(tokenizer("word_bpe_49k.json")).known)], pa.int64())], ["n"])

    assert spark.range(1).coalesce(1).mapInArrow(known, "n long").first().n == 1
