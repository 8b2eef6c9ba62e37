"""Files that are written and read again."""

import json

import pytest
from pyspark.sql import functions as F

from terralog.sources import files


def test_archive_reads_the_buckets_of_its_entities(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = spark.createDataFrame([(f"e{k}", float(k)) for k in range(200)], "entity_id string, value double")
    files.write_archive(rows, path)
    one = files.read_archive(spark, path, rows._jdf.schema().toDDL(), ["e7", "none"])
    assert [tuple(r) for r in one.collect()] == [("e7", 7.0)]
    assert len(one.inputFiles()) == 200 or "PartitionFilters: [isnotnull" in one._jdf.queryExecution().executedPlan().toString() or "entity_bucket" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]
    assert files.read_archive(spark, path, rows._jdf.schema().toDDL()).count() == 200
    files.write_archive(rows.where("entity_id = 'e7'").withColumn("value", F.lit(-1.0)), path)
    assert files.read_archive(spark, path, rows._jdf.schema().toDDL(), ["e7"]).first().value == -1.0


def test_lines_logs_and_metrics(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\nb"), (2, None)], "id long, text string")
    files.write_lines(rows, str(tmp_path / "lines"))
    assert sorted(map(tuple, files.read_lines(spark, str(tmp_path / "lines"), rows.schema).collect())) == [(1, "a\nb"), (2, None)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_lines(spark, str(tmp_path / "absent"), rows.schema).count()
    for _ in range(2):
        files.log_failures(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    for e, v in (("x", 1.0), ("y", 2.0), ("x", 3.0)):
        files.write_metrics(spark.createDataFrame([(e, v)], "experiment string, skill double"), str(tmp_path / "metrics"))
    assert {(r.experiment, r.skill) for r in spark.read.parquet(str(tmp_path / "metrics")).collect()} == {("x", 3.0), ("y", 2.0)}


def test_reference_files(spark, tmp_path):
    table = {"coefficients": [{"id": "k", "crop": "wheat", "risk": "heat", "severity": "severe", "match_band": {"metric": "dep", "min": 4.0, "max": None}, "yield_impact_pct": -5.6, "source": "s", "citation": "c"}], "gaps": [{"crop": "millet", "risk": "drought", "status": "gap", "why_nothing_qualified": "none"}]}
    (tmp_path / "t.json").write_text(json.dumps(table, indent=2))
    entries, gaps = files.reference_table(spark, str(tmp_path / "t.json"))
    e = entries.first()
    assert (e.entry, e.crop, e.metric, e.lo, e.hi, e.impact) == (0, "wheat", "dep", 4.0, None, -5.6) and gaps.first().crop == "millet"
    (tmp_path / "d.md").write_text("# A\n\nsome   text\n## B\n")
    d = files.markdown(spark, str(tmp_path / "d.md")).first()
    assert (d.headings, d.chars) == (2, len("# A some text ## B"))
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "query": "q", "doc_type": "A", "acceptable_sources": ["x", "y"]}], indent=1))
    assert sorted(r.source_id for r in files.labelled_queries(spark, str(tmp_path / "q.json")).collect()) == ["x", "y"]


def test_markdown_in_parts_has_the_figures_of_the_whole(spark, tmp_path):
    text = "\n \t# no heading\r\n# A\x0b b\n\n\n#\n  two   words \rand more\n" + "x" * 5000 + "\n\f\n## Z\n \n"
    lines = [x + "\n" for x in text[:-1].split("\n")]
    for name, cut in (("whole", len(lines)), ("parts", 3)):
        (tmp_path / name).mkdir()
        for k in range(0, len(lines), cut):
            (tmp_path / name / f"{k:02}.txt").write_bytes("".join(lines[k : k + cut]).encode())
    got = {r.path.rsplit("/", 1)[1]: (r.chars, r.headings) for r in files.markdown(spark, f"{tmp_path}/*/*.txt", folders=True).collect()}
    want = (len(" ".join(text.split())), sum(x.startswith("#") for x in text.split("\n")))
    assert got == {"whole": want, "parts": want}


def test_section_chunks_and_recovered_json(spark):
    from terralog.operators import corpus

    long = ". ".join(f"sentence {k} of the section" for k in range(200))
    df = spark.createDataFrame([(1, f"# Short\ntoo short\n## Long\n{long}\n## Whole\n{'x' * 150}"), (2, None)], "id long, text string")
    c = corpus.section_chunks(df, "id").orderBy("section", "chunk").collect()
    assert {r.heading for r in c} == {"Long", "Whole"} and all(corpus.LEAST_CHUNK <= r.chars <= corpus.MOST_CHUNK for r in c) and sum(r.heading == "Long" for r in c) >= 3
    j = spark.createDataFrame([(1, 'so: ```json\n{"k": 3}\n``` ok'), (2, '{"k": 3'), (3, "none"), (4, None)], "id long, text string")
    got = {r.id: (r.value and r.value.k, r.parse_failed) for r in corpus.recovered_json(j, "text", "k LONG").collect()}
    assert got == {1: (3, False), 2: (None, True), 3: (None, True), 4: (None, True)}


def test_paragraphs_end_at_blank_lines():
    from terralog.operators import corpus

    lines = "\n".join("word " * 30 for _ in range(6))
    assert corpus.pack(lines + "\n\n" + lines)[0].count("\n\n") == 1
    assert sum(map(len, corpus.pack("y" * 5000))) == 5000
