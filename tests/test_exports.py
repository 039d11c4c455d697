"""CSV exports: byte-order mark, quoting, and only whole exports are seen."""

import csv
import io
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from opinionlake.session import scratch
from opinionlake.sources import exports

SCHEMA = "report_id string, id string, text string, n bigint, ok boolean"
ROWS = [("r1", "1", 'a "b", c\nline', 1, True), ("r1", "2", "  服務 ", None, False), ("r2", "3", None, 3, None)]


def files(folder):
    return sorted(Path(folder.removeprefix("file:")).glob("part-*.csv"))


def test_files_begin_with_the_mark_and_read_back(spark):
    path, rows = scratch(spark, "csv"), spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    folder = exports.write_csv(rows, path)
    assert files(folder) and all(f.read_bytes().startswith(b"\xef\xbb\xbfreport_id,id,text,n,ok\n") for f in files(folder))
    seen = [r for f in files(folder) for r in csv.DictReader(io.StringIO(f.read_bytes().decode("utf-8-sig"), newline=""))]
    assert sorted((r["id"], r["text"]) for r in seen) == [("1", 'a "b", c\nline'), ("2", "  服務 "), ("3", "")]
    back = exports.read_csv(spark, path, rows.schema)
    assert sorted(map(tuple, back.collect())) == sorted(ROWS)


def test_a_failed_export_stays_unseen(spark):
    path, rows = scratch(spark, "csv"), spark.createDataFrame(ROWS, SCHEMA)
    broken = rows.withColumn("n", F.when(F.col("id") == "3", F.raise_error(F.lit("lost"))).otherwise(F.col("n")))
    assert exports.read_csv(spark, path, rows.schema).count() == 0
    with pytest.raises(Exception, match="lost"):
        exports.write_csv(broken, path)
    assert exports.read_csv(spark, path, rows.schema).count() == 0
    exports.write_csv(rows, path)
    with pytest.raises(Exception, match="lost"):
        exports.write_csv(broken, path)
    assert exports.read_csv(spark, path, rows.schema).count() == 3
    exports.write_csv(rows.filter("id = '1'"), path)
    assert [r["id"] for r in exports.read_csv(spark, path, rows.schema).collect()] == ["1"]
    exports.write_csv(rows.filter("id = 'none'"), path)
    assert exports.read_csv(spark, path, rows.schema).count() == 0
