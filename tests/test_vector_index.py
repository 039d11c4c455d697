"""Search through cells gives the rows of a full scan and leaves cells out."""

import numpy as np
import pytest

from opinionlake.operators import vector_index

SCHEMA = "vec_id bigint, embedding array<double>"


def brute(vectors, query, limit):
    scored = [(-float(np.dot(v, query)), i) for i, v in vectors if v and len(v) == len(query)]
    return [(i, round(-s, 9)) for s, i in sorted(scored)[:limit]]


def clustered(rng, n, dim=16, centres=20):
    middle = rng.normal(size=(centres, dim))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    rows = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * 0.03
    return (rows * rng.uniform(0.9, 1.1, (n, 1))).tolist()


@pytest.mark.parametrize("pivots", [1, 40])
def test_same_rows_as_a_full_scan(spark, pivots):
    rng = np.random.default_rng(3)
    rows = clustered(rng, 3000)
    copy = rows[7]
    vectors = [(i, copy if i % 3 == 0 else v) for i, v in enumerate(rows)]  # a third are copies of one vector
    vectors += [(5000, [0.0] * 16), (5001, None), (5002, []), (5003, [1.0, 2.0]), (5004, [0.0, 0.0]), (5005, [40 * x for x in copy]), (7, copy)]
    asked = [(i, v) for i, v in enumerate(clustered(rng, 30) + [copy, [-x for x in copy], [0.0] * 16])]
    asked += [(100, [1.0, -1.0]), (101, [3.0]), (102, None), (103, [])]
    path = vector_index.build(spark.createDataFrame(vectors, SCHEMA).repartition(4), pivots=pivots)
    got = {}
    for r in vector_index.search(spark, path, spark.createDataFrame(asked, "query_id bigint, embedding array<double>"), 12).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    for q, v in asked:
        want = brute(vectors, v, 12) if v else []
        mine = got.get(q, [])
        assert [s for _, s in mine] == pytest.approx([s for _, s in want], abs=1e-8), q
        assert all(dict(vectors)[i] is not None for i, _ in mine)
        if q == 30:
            assert [i for i, _ in mine] == [i for i, _ in want]  # equal scores by id


def test_cells_are_left_out(spark):
    rng = np.random.default_rng(4)
    # Queries near the data, as a stored text's vector is.
    rows = clustered(rng, 4000)
    path = vector_index.build(spark.createDataFrame(list(enumerate(rows)), SCHEMA), pivots=60)
    asked = spark.createDataFrame(list(enumerate(rows[:40])), "query_id bigint, embedding array<double>")
    report = vector_index.searched(spark, path, asked, 10).collect()
    assert len(report) == 40 and {r.n_vectors for r in report} == {4000}
    assert sum(r.n_scored for r in report) < 0.35 * 40 * 4000


def test_empty(spark):
    path = vector_index.build(spark.createDataFrame([], SCHEMA))
    asked = spark.createDataFrame([(1, [1.0])], "query_id bigint, embedding array<double>")
    assert vector_index.search(spark, path, asked).count() == 0 == vector_index.searched(spark, path, asked).count()
    full = vector_index.build(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA))
    assert vector_index.search(spark, full, asked.limit(0)).count() == 0
