"""Each stage of the pipeline on its own input, against plain versions of what it decides."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    import corpus_pipeline

    from terralog.llm import base, decontaminate
    from tests.llm.test_operators import brute_components

    docs = base.read(spark, SF, "documents")
    bench = base.read(spark, SF, "benchmark").collect()
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = base.stored(stage(spark, docs, SF))
        ids = {r.doc_id for r in out.collect()}
        assert ids <= set(before)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        if name == "quality_classifier":
            assert 0.7 * len(before) < len(ids) < len(before)
        elif name == "ngram_jaccard_join":
            assert ids == {c for *_, c in brute_components(before.items())}
        elif name == "benchmark_decontamination":
            hit = {i for i, t in before.items() for b in bench if (s := decontaminate.shingles_of(b.text)) and 100 * len(s & decontaminate.shingles_of(t)) >= 80 * len(s)}
            assert ids == set(before) - hit
        elif name == "secret_scan":
            assert ids == set(before) and not out.where("text rlike 'AKIA[A-Z0-9]{16}'").count()
            assert out.where("n_chars <> length(text)").count() == 0
        else:
            assert ids == set(before)
        docs = out


ROWS = [(1, "A"), (3, "A"), (3, "B"), (4, "A"), (4, "A"), (5, None), (5, None), (6, ""), (6, "c"), (None, "A"), (None, "A"), (7, "D"), (7, "D'")]


def test_one_of_each_judges_rows(spark):
    from terralog.llm import jaccard_join
    from tests.llm.test_operators import prose

    texts = {"A": prose(1, 80), "B": prose(2, 80), "D": prose(3, 80), "D'": prose(3, 80) + " end"}
    docs = spark.createDataFrame([(i, texts.get(t, t), k, k) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, copy_id long, copy_digest long")
    out = jaccard_join.one_of_each(docs)
    kept = {r.copy_id for r in out.collect()}
    assert out.columns == docs.columns
    assert {0, 2, 8, 9, 10} <= kept and not kept & {1, 3, 4}  # copies of document 1 go, the other text of 3 stays
    assert len(kept & {5, 6}) == 1 and 7 in kept and len(kept & {11, 12}) == 1


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, empty):
    """Nulls in all columns, empty and repeated rows, an empty table, and columns named as the stages' own."""
    import corpus_pipeline

    from terralog.llm import base
    from tests.llm.test_operators import ODD

    names = ["secret_doc", "found_secrets", "leaked_doc", "copy_id", "copy_digest", "node", "score", "key", "component_id"]
    docs = spark.createDataFrame([(i, t, None, "s", len(t or ""), *[k] * len(names)) for k, (i, t) in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} long" for n in names))
    docs = base.stored(docs.limit(0) if empty else docs)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = base.stored(stage(spark, docs, SF))
        assert out.columns == docs.columns and out.count() == (0 if empty else {"ngram_jaccard_join": len(ODD) - 2}.get(name, docs.count())), name
        docs = out
    quality = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert quality.columns == docs.columns and quality.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
