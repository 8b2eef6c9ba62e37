"""Exact pruned search against comparing all with all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralog.operators import retrieval


def plain(q, v, k):
    unit = lambda x: np.array(x, float) / max(np.linalg.norm(np.array(x, np.float32).astype(float)), 1e-30)
    out = []
    for i, x in q:
        s = sorted((-round(float(unit(np.array(x, np.float32)) @ unit(np.array(y, np.float32))), 6), j) for j, y in v if j != i)[:k]
        out += [(i, j, round(-c, 6), r) for r, (c, j) in enumerate(s, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "spread"), [(1024, 0.02), (20, 0.02), (20, 5.0)])
def test_equal_to_brute_force(spark, block, spread):
    rng = np.random.default_rng(block)
    middle = rng.standard_normal((12, 16))
    hot = [(i, (middle[0] + spread * rng.standard_normal(16)).tolist()) for i in range(300)]  # a cell with a third of all
    rest = [(300 + i, (middle[i % 12] + spread * rng.standard_normal(16)).tolist()) for i in range(500)]
    odd = [(900, [0.0] * 16), (901, rest[0][1]), (902, rest[0][1]), (903, (-np.array(rest[1][1])).tolist()), (904, (3 * np.array(rest[0][1])).tolist())]
    v = hot + rest + odd
    schema = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame([(i, x, 0) for i, x in v] + [(999, None, 0), (None, v[0][1], 0)], schema).repartition(5)
    q = df.where("vec_id % 7 = 0 or vec_id >= 900")
    got = retrieval.top_k(q, df, 4, block)
    want = plain([r for r in v if r[0] % 7 == 0 or r[0] >= 900], v, 4)
    assert sorted((r.query_id, r.vec_id, round(r.score, 6) + 0.0, r["rank"]) for r in got.collect()) == [(a, b, c + 0.0, d) for a, b, c, d in want]
    report = retrieval.plan(q, df, 4, block).report().first()
    assert 0 <= report.skipped < 1 and (spread > 1 or report.skipped > 0.5)


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(1, [1.0, 0.0])], schema)
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], schema)
    assert retrieval.top_k(one, one, 3).count() == 0
    assert [tuple(r) for r in retrieval.top_k(one, two, 3).collect()] == [(1, 2, 0.0, 1)]
    assert retrieval.top_k(one, two.limit(0), 3).count() == 0 and retrieval.top_k(one.where(F.lit(False)), two, 3).count() == 0


def test_blocks_reach_python_a_few_at_a_time(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)])], ["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    got = [r.n for r in retrieval._stored_in_small_batches(spark.range(0, 100, 1, 1).mapInArrow(sizes, "n long")).collect()]
    assert sum(got) == 100 and max(got) <= retrieval.BLOCK_ROWS and spark.conf.get(name) == usual
