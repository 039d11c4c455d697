from pyspark.sql import functions as F

from opinionlake.functions import text
from opinionlake.operators import hygiene


def test_nested_strings_are_masked_like_plain_ones_and_cross_to_python_only_if_affected(spark):
    values = ["plain  text", "Ｆull ０９１２３４５６７８", "mail a@b.org", "@handle_1 x", "id 123456789", "www.x.org/a b", "", "é​ e"]
    rows = spark.createDataFrame([(i, v, [v, "x"]) for i, v in enumerate(values)], "n int, one string, many array<string>")
    got = hygiene.model_boundary(rows)
    assert all(r["many"] == [r["one"], "x"] for r in got.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    sent = plan[plan.index("_nfkc_each(") :]
    assert sent.startswith("_nfkc_each(CASE WHEN exists")
    each = rows.select(text.normalize_all(F.array("one")).alias("a"), text.normalize(F.col("one")).alias("b")).collect()
    assert all(r["a"] == [r["b"]] for r in each)
