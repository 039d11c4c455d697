"""Item, label and message relations derived from the analytic test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.session import spread

ASPECTS = list(C.ASPECT_LABELS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def labels_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_labels: one row per labelled document."""
    labels = table(spark, sf_dir, "labels")
    return labels.select(
        F.col("doc_id").alias("label_doc"),
        F.when(F.col("toxic") == 1, "negative")
        .when(F.col("quality") == 1, "positive")
        .when(F.col("quality") == 0, "neutral")
        .alias("label_sentiment"),
    )


def text_table(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """A text table for CPU-heavy text work, spread over all cores when it arrives in few splits."""
    return spread(table(spark, sf_dir, name), key)


def bare_items(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """The item relation before labels are joined. ``heavy`` announces work on the texts."""
    d = text_table(spark, sf_dir) if heavy else table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    source = F.when(n % 3 == 0, "google_maps").when(n % 3 == 1, "ptt").otherwise("dcard")
    maps = n % 3 == 0
    thread = F.expr("doc_id div 15")
    report = F.concat(F.lit("r"), (thread % 4).cast("string"))
    board = F.when(n % 11 != 0, F.col("source"))
    precision = (
        F.when(n % 13 == 0, "unknown")
        .when(n % 8 <= 4, "day")
        .when(n % 8 == 5, "week")
        .when(n % 8 == 6, "month")
        .otherwise("year")
    )
    return d.select(
        report.alias("report_id"),
        n.cast("string").alias("id"),
        n.alias("ordinal"),
        source.alias("source"),
        F.when(maps, "review").when(n % 5 == 0, "post").otherwise("comment").alias("content_type"),
        F.substring("text", 1, 40).alias("title"),
        F.col("text"),
        F.col("lang").alias("language"),
        board.alias("board"),
        F.when(maps, F.concat(F.lit("Brand "), report)).otherwise(board).alias("channel_label"),
        F.when(~maps, F.concat(F.lit("t"), thread.cast("string"))).alias("thread_source_id"),
        F.concat(F.lit("https://www.dcard.tw/f/"), F.col("source"), F.lit("/p/"), (thread + 1000000).cast("string")).alias(
            "source_url"
        ),
        F.when(maps & (n % 7 != 0), 1 + n % 5).alias("rating"),
        F.when(
            n % 13 != 0, F.timestamp_seconds(F.lit(1704067200) + n * 97 * 60)
        ).alias("published_at"),
        precision.alias("date_precision"),
        F.when(n % 9 != 0, F.col("n_chars") % 97).alias("reply_count"),
        (n % 23).alias("reaction_count"),
        _pick(["push", "boo", "neutral"], n % 3).alias("signal"),
    )


def items(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """Snapshot items: one row per (report_id, id), labels attached."""
    base = bare_items(spark, sf_dir, heavy)
    labels = labels_for(spark, sf_dir)
    n = F.col("ordinal")
    joined = base.join(labels, n == labels["label_doc"], "left").drop("label_doc")
    sentiment = F.coalesce("label_sentiment", F.when(n % 4 == 0, F.lit("rating_only")))
    first, second = _pick(ASPECTS, n % 11), _pick(ASPECTS, (n * 7 + 3) % 11)
    rated = F.when(F.col("rating") <= 2, "negative").when(F.col("rating") == 3, "neutral").when(F.col("rating") > 3, "positive")
    empty = F.array().cast("array<string>")
    return joined.select(
        *base.columns,
        "label_sentiment",
        sentiment.alias("sentiment"),
        ((n % 100) / F.lit(100.0)).alias("confidence"),
        F.array(first, second).alias("aspects"),
        F.when(n % 6 == 0, F.array(first)).otherwise(empty).alias("negative_aspects"),
        F.array(
            F.concat(F.lit("kp"), (n % 17).cast("string")), F.concat(F.lit("kp"), (n % 5).cast("string"))
        ).alias("key_points"),
        F.when(n % 6 == 0, F.array(F.concat(F.lit("topic"), (n % 9).cast("string")))).otherwise(empty).alias("topic_keys"),
        F.when(n % 3 == 0, rated).alias("rating_sentiment"),
        F.coalesce((sentiment != "rating_only") & (sentiment != rated), F.lit(False)).alias("rating_text_conflict"),
        F.when(F.col("label_sentiment").isNotNull(), F.concat(F.lit("m"), (n % 2).cast("string"))).alias("local_model_id"),
    )


_ASPECT_LIST = "[" + ",".join(f"'{a}'" for a in ASPECTS) + "]"

# The same derivation for the SQL check: a comma-terminated list of common table expressions.
BARE_SQL = """bare AS (
 SELECT 'r' || ((doc_id // 15) % 4) AS report_id, CAST(doc_id AS VARCHAR) AS id, doc_id AS ordinal,
  CASE doc_id % 3 WHEN 0 THEN 'google_maps' WHEN 1 THEN 'ptt' ELSE 'dcard' END AS source,
  CASE WHEN doc_id % 3 = 0 THEN 'review' WHEN doc_id % 5 = 0 THEN 'post' ELSE 'comment' END AS content_type,
  substr(text, 1, 40) AS title, text, lang AS language,
  CASE WHEN doc_id % 11 <> 0 THEN source END AS board,
  CASE WHEN doc_id % 3 = 0 THEN 'Brand r' || ((doc_id // 15) % 4)
       WHEN doc_id % 11 <> 0 THEN source END AS channel_label,
  CASE WHEN doc_id % 3 <> 0 THEN 't' || (doc_id // 15) END AS thread_source_id,
  'https://www.dcard.tw/f/' || source || '/p/' || (1000000 + doc_id // 15) AS source_url,
  CASE WHEN doc_id % 3 = 0 AND doc_id % 7 <> 0 THEN 1 + doc_id % 5 END AS rating,
  CASE WHEN doc_id % 13 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(97 * doc_id) END AS published_at,
  CASE WHEN doc_id % 13 = 0 THEN 'unknown' WHEN doc_id % 8 <= 4 THEN 'day' WHEN doc_id % 8 = 5 THEN 'week'
       WHEN doc_id % 8 = 6 THEN 'month' ELSE 'year' END AS date_precision,
  CASE WHEN doc_id % 9 <> 0 THEN n_chars % 97 END AS reply_count, doc_id % 23 AS reaction_count,
  ['push','boo','neutral'][CAST(doc_id % 3 + 1 AS INT)] AS signal
 FROM documents)"""

ITEMS_SQL = BARE_SQL + """, lab AS (
 SELECT doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive'
   WHEN quality = 0 THEN 'neutral' END AS s FROM labels), items0 AS (
 SELECT bare.*, coalesce(lab.s, CASE WHEN ordinal % 4 = 0 THEN 'rating_only' END) AS sentiment,
  lab.s AS label_sentiment,
  (ordinal % 100) / 100.0::DOUBLE AS confidence,
  [@ASPECTS@[CAST(ordinal % 11 + 1 AS INT)], @ASPECTS@[CAST((7 * ordinal + 3) % 11 + 1 AS INT)]] AS aspects,
  CASE WHEN ordinal % 6 = 0 THEN [@ASPECTS@[CAST(ordinal % 11 + 1 AS INT)]] ELSE []::VARCHAR[] END AS negative_aspects,
  ['kp' || (ordinal % 17), 'kp' || (ordinal % 5)] AS key_points,
  CASE WHEN ordinal % 6 = 0 THEN ['topic' || (ordinal % 9)] ELSE []::VARCHAR[] END AS topic_keys,
  CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' WHEN rating > 3 THEN 'positive' END AS rated
 FROM bare LEFT JOIN lab ON bare.ordinal = lab.doc_id), items AS (
 SELECT *, CASE WHEN ordinal % 3 = 0 THEN rated END AS rating_sentiment,
  coalesce(sentiment <> 'rating_only' AND sentiment <> rated, false) AS rating_text_conflict,
  CASE WHEN label_sentiment IS NOT NULL THEN 'm' || (ordinal % 2) END AS local_model_id,
  CAST(published_at + INTERVAL 8 HOUR AS DATE) AS day,
  coalesce(sentiment, 'unknown') AS sent,
  replace(lower(coalesce(title, '') || ' ' || coalesce(text, '')), 'ß', 'ss') AS folded
 FROM items0)""".replace("@ASPECTS@", _ASPECT_LIST)


def with_items(sql: str) -> str:
    """SQL over the derived ``items``; ``sql`` may begin with further ``, name AS (...)`` parts."""
    return f"WITH {ITEMS_SQL} {sql}"
