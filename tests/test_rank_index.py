"""Deep pages from the rank index: the rows of a whole sort, read from one or two ranges."""

import random
import re

from pyspark.sql import functions as F

from opinionlake.operators import rank_index

def order():
    return [F.desc_nulls_last("day"), F.col("id")]


def table(spark):
    rng = random.Random(2)
    rows = [("big", rng.choice([None, 1, 2, 2, 2]), i) for i in range(4000)]
    rows += [(f"small{i}", 1, i) for i in range(300)] + [(None, 3, i) for i in range(40)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "report string, day int, id bigint").repartition(3)


def ordered(rows, key):
    return [i for k, d, i in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))]


def test_pages_are_those_of_a_sort(spark):
    rows, df = table(spark)
    path = rank_index.build(df, ["report"], order(), ranges=16)
    for number, size in ((1, 25), (2, 25), (40, 100), (3, 1000), (401, 10)):
        got = {}
        for r in rank_index.page(spark, path, ["report"], order(), number, size).orderBy("position").collect():
            got.setdefault(r.report, []).append((r.position, r.id, r.total))
        for key in {r[0] for r in rows}:
            whole = ordered(rows, key)
            want = [(p, i, len(whole)) for p, i in enumerate(whole, 1) if (number - 1) * size < p <= number * size]
            assert got.get(key, []) == want, (key, number, size)


def test_deep_page_reads_one_or_two_ranges(spark):
    rows, df = table(spark)
    path = rank_index.build(df, ["report"], order(), ranges=16)
    deep = rank_index.page(spark, path, ["report"], order(), 391, 10, only=["big"])
    assert [r.id for r in deep.orderBy("position").collect()] == ordered(rows, "big")[3900:3910]
    summary = spark.read.parquet(f"{path}/summary").filter("report = 'big'")
    wanted = {r[0] for r in summary.filter("_before < 3910 and _before + _n > 3900").select("_range").collect()}
    assert summary.count() >= 10 and len(wanted) <= 2
    plan = deep._jdf.queryExecution().executedPlan().toString()
    listed = re.search(r"PartitionFilters: \[[^\n]*?_range#\d+ (?:IN|=) \(?([\d, ]+)", plan)
    assert {int(x) for x in listed.group(1).split(",")} == wanted


def test_empty(spark):
    empty = spark.createDataFrame([], "report string, day int, id bigint")
    path = rank_index.build(empty, ["report"], order())
    assert rank_index.page(spark, path, ["report"], order(), 1, 10).count() == 0
