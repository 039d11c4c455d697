"""Copies of a (source, size) group that is cut into many blocks."""

import collections

from opinionlake.llm import mixing
from opinionlake.llm.queries import prepare


def test_blocks_lose_no_copy(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(mixing, "BLOCK", 10)
    rows = [(i, z, s) for i, (s, z) in enumerate([("a", 5)] * 1000 + [(None, 7)] * 400)]
    frame = spark.createDataFrame(rows, "id bigint, size bigint, source string")
    groups = spark.createDataFrame([("a", 5, 1000, 37, 1.0, 1), (None, 7, 400, 933, 1.0, 1)], "source string, size bigint, n bigint, k bigint, target double, source_size bigint")
    got, most = collections.Counter(), collections.Counter()
    for r in mixing._dealt(frame, groups, [frame["id"]]).collect():
        got[r.source] += r.copies
        most[r.source] = max(most[r.source], r.copies)
    assert got == {"a": 37, None: 933} and most == {"a": 1, None: 3}
