"""Export tables and their writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionlake.functions import identity
from opinionlake.functions.text import formula_safe

# Columns of the export layouts, in their order.
ITEM_COLUMNS = (
    "id", "source", "content_type", "title", "board", "thread_source_id", "source_url", "rating", "text", "relative_date",
    "sentiment", "confidence", "rating_text_conflict", "aspects", "key_points",
)
TREND_COLUMNS = (
    "period", "period_end", "count", "classified_count", "positive_count", "neutral_count", "negative_count", "rating_only_count",
    "unknown_count", "negative_ratio", "pn_ratio", "scope_key",
)
EVIDENCE_COLUMNS = ("id", "source", "title", "text", "board", "published_at_estimated", "date_precision", "sentiment")

_CSV = {
    "header": True, "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def _cells(df: DataFrame, columns) -> list:
    types = dict(df.dtypes)
    out = []
    for name in columns:
        col = F.col(name) if name in types else F.lit(None).cast("string")
        kind = types.get(name, "string")
        if kind.startswith("array"):
            out.append(formula_safe(F.array_join(col, "|")).alias(name))
        elif kind == "string":
            out.append(formula_safe(col).alias(name))
        else:
            out.append(col.alias(name))
    return out


def item_rows(items: DataFrame) -> DataFrame:
    """Fifteen detail columns per item, arrays joined, spreadsheet-safe. ``report_id`` names the file."""
    shaped = items.withColumn("source_url", identity.safe_url(F.col("source_url")))
    return shaped.select("report_id", *_cells(shaped, ITEM_COLUMNS))


def trend_rows(series: DataFrame) -> DataFrame:
    return series.select("report_id", *_cells(series, TREND_COLUMNS))


def evidence_rows(items: DataFrame) -> DataFrame:
    shaped = items.withColumn("published_at_estimated", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return shaped.select("report_id", *_cells(shaped, EVIDENCE_COLUMNS))


MARK = "\ufeff"
_RUNS = "n bigint, run string"


def _published(spark, path: str) -> str | None:
    """Folder of the last export that was written to its end."""
    try:
        last = spark.read.schema(_RUNS).parquet(f"{path}/manifest").orderBy(F.desc("n")).first()
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return f"{path}/{last['run']}" if last else None


def write_csv(rows: DataFrame, path: str) -> str:
    """CSV files with a byte-order mark, a header and RFC 4180 quoting, written in parallel; blanks at the ends are kept.

    Spark's writer shows a task's file only when the task commits, and the folder counts only once the manifest, written
    last, names it: an export that fails leaves the one before it in force. The mark is the first letter of the header.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    first, *others = rows.columns
    marked = rows.withColumnsRenamed({first: MARK + first}).select(F.col(f"`{MARK}{first}`"), *[F.col(f"`{c}`") for c in others])
    marked.write.options(**_CSV).csv(f"{path}/{run}")
    before = 0 if _published(spark, path) is None else spark.read.schema(_RUNS).parquet(f"{path}/manifest").agg(F.max("n")).first()[0]
    spark.createDataFrame([(before + 1, run)], _RUNS).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return f"{path}/{run}"


def read_csv(spark, path: str, schema) -> DataFrame:
    """The rows of the last whole export."""
    found = _published(spark, path)
    if found is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(**_CSV, multiLine=True).csv(found)


def write_json(rows: DataFrame, scope_rows: DataFrame, path: str) -> None:
    """Items as JSON lines with the scope record of each report beside them."""
    rows.write.json(f"{path}/items")
    scope_rows.write.json(f"{path}/scope")
