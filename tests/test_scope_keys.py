import json

from opinionlake.operators import scope as S
from opinionlake.plans import storage
from opinionlake.sources.binding import items

DIR = "/root/testdata/sf0.001"


def test_exports_join_their_scope_rows(spark):
    rows = items(spark, DIR)
    known = {r["report_id"]: r["scope_key"] for r in S.scope_rows(rows.withColumn("relative_date", S.F.lit(None).cast("string")), storage._WEEKLY, storage._META, list(S.CONTENT)).collect()}
    trend = {(r["report_id"], r["scope_key"]) for r in storage.trend_csv(spark, DIR).collect()}
    assert trend and trend <= set(known.items())
    member = S.with_scope_key(rows.select("report_id").distinct(), rows, storage._WEEKLY, S.F.lit("topic")).collect()
    assert not {r["scope_key"] for r in member} & set(known.values()) and json.loads(storage._WEEKLY.as_json())
