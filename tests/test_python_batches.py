import pandas as pd
from pyspark.sql import functions as F

from opinionlake import plans


def test_python_workers_get_batches_of_few_megabytes(spark):
    """What a worker makes of a batch is many times its text, so batches are bounded in bytes and not only in rows."""
    plans.load_all()
    plans.QUERIES["agg.source_counts"](spark, "/root/testdata/sf0.001")
    rows = spark.range(2000).select(F.repeat(F.lit("x"), 10_000).alias("t")).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"size": [int(batch["t"].str.len().sum())]})

    got = [r["size"] for r in rows.mapInPandas(sizes, "size long").collect()]
    assert sum(got) == 20_000_000 and max(got) < 9 << 20
