"""Texts go through Python workers in slices, whatever a batch holds."""

import pyarrow as pa
import pytest

from terralog.functions import slices
from terralog.operators import corpus, grounding

TEXTS = [None, "", "short", "word. " * 100_000, "page 3, " * 50, *("Some 1,234.5 of it.\n\n" * 40 for _ in range(3000))]


@pytest.mark.parametrize("most", [1, 100, 10_000, 1 << 20])
def test_slices_are_whole_and_bounded(most):
    parts = list(slices.slices(pa.array(TEXTS), most))
    assert [t for p in parts for t in p.to_pylist()] == TEXTS and all(len(p) for p in parts)
    assert all(sum(len(t or "") for t in p.to_pylist()[:-1]) < most for p in parts)
    assert not list(slices.slices(pa.array([], pa.string())))


def handed_on(udf, of):
    got = list(udf.func(iter([pa.array(TEXTS), pa.array([], pa.string())])))
    assert len(got) > 3 and max(map(len, got)) < len(TEXTS) / 2
    assert [x for a in got for x in a.to_pylist()] == [of(t) for t in TEXTS]


def test_chunks_are_packed_by_slices():
    handed_on(corpus._packed, corpus.pack)


def test_sections_are_cut_by_slices():
    handed_on(corpus._cut, lambda t: corpus.split_long(t) if t is not None and len(t) >= corpus.LEAST_CHUNK else [])


def test_chunks_of_many_slices_stay_with_their_documents(spark):
    texts = [t for t in TEXTS for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = {}
    for r in corpus.chunks(df, "id").orderBy("id", "chunk").collect():
        got.setdefault(r.id, []).append(r.body)
    assert got == {k: c for k, t in enumerate(texts) if (c := corpus.pack(t))}


def test_numbers_are_scanned_by_slices():
    handed_on(grounding._claimed, lambda t: grounding.claimed(t or ""))
    handed_on(grounding._scanned, lambda t: {"written": sorted(grounding.written(t or "")), "given": sorted(grounding.given_values(t or ""))})
