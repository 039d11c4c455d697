"""Report aggregate and text-mining queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.functions import segment, text
from opinionlake.operators import keywords, reportagg
from opinionlake.operators import scope as S
from opinionlake.plans import query
from opinionlake.plans.scoped import TOKENS_SQL
from opinionlake.session import scratch, spread
from opinionlake.sources.binding import items, table, with_items

_BLOCK_COLS = ", ".join(
    ["count(*) AS sample_size", "count(*) FILTER (text <> '') AS text_count"]
    + [f"count(*) FILTER (sentiment = '{s}') AS {s}_count" for s in reportagg.LABELLED]
    + [f"count(*) FILTER (content_type = '{t}') AS {t}_count" for t in C.CONTENT_TYPES]
    + [f"count(*) FILTER (signal = '{s}') AS signal_{s}" for s in C.SIGNALS]
    + [f"count(*) FILTER (source = 'google_maps' AND rating = {r}) AS rating_{r}" for r in range(1, 6)]
    + ["count(*) FILTER (source = 'google_maps' AND rating_text_conflict) AS conflict_count",
       "count(*) FILTER (sentiment IS NULL) AS unlabelled_count"]
)
_BLOCKS = f""", blk AS (SELECT report_id, 'overall' AS block, {_BLOCK_COLS} FROM items GROUP BY report_id
 UNION ALL SELECT report_id, source AS block, {_BLOCK_COLS} FROM items GROUP BY report_id, source)"""


@query("agg.report", with_items(_BLOCKS + " SELECT * FROM blk"))
def report(spark, d):
    return reportagg.blocks(items(spark, d))


@query("agg.ratings", with_items("""SELECT report_id, CAST(rating AS BIGINT) AS rating, count(*) AS count FROM items
 WHERE source = 'google_maps' AND rating <> 0 GROUP BY ALL"""))
def ratings(spark, d):
    rows = items(spark, d).filter((F.col("source") == "google_maps") & (F.col("rating") != 0))
    return rows.groupBy("report_id", "rating").count()


@query("agg.sentiment_dist", with_items("SELECT report_id, sentiment, count(*) AS count FROM items WHERE sentiment IS NOT NULL GROUP BY ALL"))
def sentiment_dist(spark, d):
    return items(spark, d).filter("sentiment is not null").groupBy("report_id", "sentiment").count()


@query("agg.conflicts", with_items("""SELECT report_id, count(*) FILTER (source = 'google_maps' AND rating_text_conflict) AS conflicts
 FROM items GROUP BY 1"""))
def conflicts(spark, d):
    hit = (F.col("source") == "google_maps") & F.col("rating_text_conflict")
    return items(spark, d).groupBy("report_id").agg(F.count_if(hit).alias("conflicts"))


_LABEL = "CASE aspect " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.ASPECT_LABELS.items()) + " ELSE aspect END"
_ASPECTS = f""", asp AS (SELECT report_id, aspect, {_LABEL} AS label,
 {", ".join(f"count(*) FILTER (sent = '{s}') AS {s}_count" for s in C.SENTIMENTS)}
 FROM (SELECT report_id, sent, unnest(aspects) AS aspect FROM items) GROUP BY ALL)"""


@query("agg.aspect_sentiment", with_items(_ASPECTS + " SELECT * FROM asp"))
def aspect_sentiment(spark, d):
    return reportagg.aspect_sentiment(items(spark, d))


@query("agg.points", with_items(""", p AS (SELECT report_id, CASE sentiment WHEN 'positive' THEN 'praise' ELSE 'complaint' END AS kind,
 unnest(key_points) AS point FROM items WHERE sentiment IN ('positive', 'negative')), c AS (
 SELECT report_id, kind, point, count(*) AS count FROM p GROUP BY ALL)
 SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY report_id, kind ORDER BY count DESC, point) <= 8"""))
def points(spark, d):
    return reportagg.points(items(spark, d))


@query("agg.monthly", with_items("""SELECT report_id, strftime(published_at, '%Y-%m') AS month, sent AS sentiment, count(*) AS count
 FROM items WHERE published_at IS NOT NULL AND date_precision IN ('day', 'week', 'month') GROUP BY ALL"""))
def monthly(spark, d):
    return reportagg.monthly(items(spark, d))


@query("agg.representatives", with_items("""SELECT report_id, sentiment, id, source, content_type, title, CAST(rating AS BIGINT) AS rating,
 substr(text, 1, 300) AS text, confidence, CAST(row_number() OVER w AS INT) AS position FROM items WHERE sentiment IN ('positive', 'negative') AND text <> ''
 WINDOW w AS (PARTITION BY report_id, sentiment ORDER BY confidence DESC, ordinal) QUALIFY row_number() OVER w <= 5"""))
def representatives(spark, d):
    return reportagg.representatives(items(spark, d))


@query("agg.top_threads", with_items(f""", t AS (SELECT report_id, source, thread_source_id, coalesce(nullif(title, ''), '{C.UNTITLED_THREAD}') AS title,
 count(*) AS item_count, CAST(sum(reaction_count) AS BIGINT) AS interaction_count, arg_max(source_url, ordinal) AS source_url,
 arg_max(struct_pack(b := board), ordinal).b AS board FROM items WHERE thread_source_id <> '' GROUP BY ALL)
 SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY interaction_count DESC, item_count DESC, source DESC,
  thread_source_id DESC, title DESC) <= 10"""))
def top_threads(spark, d):
    return reportagg.top_threads(items(spark, d))


@query("agg.label_status", with_items("""SELECT 'r' || n.n_nationkey AS report_id,
 CASE WHEN s.n IS NULL THEN 'no_data' WHEN s.o = 0 THEN 'completed' ELSE 'partial' END AS status, coalesce(s.models, '') AS models
 FROM nation n LEFT JOIN (SELECT report_id, count(*) AS n, count(*) FILTER (sentiment IS NULL) AS o,
  string_agg(DISTINCT local_model_id, ',' ORDER BY local_model_id) AS models FROM items GROUP BY 1) s ON s.report_id = 'r' || n.n_nationkey"""))
def label_status(spark, d):
    reports = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_nationkey").alias("report_id"))
    return reportagg.label_status(items(spark, d), reports)


@query("agg.headline", with_items(_BLOCKS + _ASPECTS + """, o AS (SELECT *, greatest(positive_count + neutral_count + negative_count + rating_only_count, 1) AS n
 FROM blk WHERE block = 'overall') SELECT o.report_id, sample_size, positive_count::DOUBLE / n AS positive_share,
 negative_count::DOUBLE / n AS negative_share, top_issue, source_sizes FROM o
 JOIN (SELECT report_id, arg_min(label, struct_pack(a := -negative_count, b := aspect)) AS top_issue FROM asp GROUP BY 1) w USING (report_id)
 JOIN (SELECT report_id, string_agg(block || ':' || sample_size, ',' ORDER BY block) AS source_sizes FROM blk WHERE block <> 'overall' GROUP BY 1) z
 USING (report_id)"""))
def headline(spark, d):
    rows = items(spark, d)
    return reportagg.headline(reportagg.blocks(rows), reportagg.aspect_sentiment(rows))


@query("agg.denominator_share", with_items("""SELECT report_id, sentiment, n::DOUBLE / sum(n) OVER (PARTITION BY report_id) AS share FROM (
 SELECT report_id, sentiment, count(*) AS n FROM items WHERE sentiment IS NOT NULL GROUP BY report_id, sentiment)"""))
def denominator_share(spark, d):
    dist = items(spark, d).filter("sentiment is not null").groupBy("report_id", "sentiment").count()
    total = dist.groupBy("report_id").agg(F.sum("count").alias("n"))
    share = F.try_divide(F.col("count").cast("double"), F.col("n"))
    return dist.join(total, "report_id").select("report_id", "sentiment", share.alias("share"))


# ---- text mining --------------------------------------------------------------------------
@query("tok.tokens", with_items(f"SELECT id, array_to_string({TOKENS_SQL}, ' ') AS tokens FROM items"))
def tokens(spark, d):
    return keywords.with_tokens(items(spark, d, heavy=True)).select("id", F.array_join("tokens", " ").alias("tokens"))


def brand_frame(spark, d):
    """Subject names per report: customer segments and nation names act as brand words."""
    c = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("k"))
    report = F.concat(F.lit("r"), (F.length("c_mktsegment") % 4).cast("string"))
    return c.groupBy(report.alias("report_id")).agg(
        F.array_distinct(F.concat(F.array_sort(F.collect_set(F.lower("c_mktsegment"))), F.array(F.lit("th"), F.lit("鼎泰豐二店")))).alias("brand_terms")
    )


@query("tok.dictionary", """WITH b AS (SELECT DISTINCT 'r' || (length(c_mktsegment) % 4) AS report_id, lower(c_mktsegment) AS w FROM customer),
 t AS (SELECT report_id, w FROM b UNION SELECT DISTINCT report_id, unnest(['th', '鼎泰豐二店']) FROM b)
 SELECT report_id, count(*) AS brand_words, string_agg(w, ',' ORDER BY w) AS words FROM t GROUP BY 1""")
def dictionary(spark, d):
    b = brand_frame(spark, d)
    return b.select(
        "report_id", F.size("brand_terms").cast("bigint").alias("brand_words"), F.array_join(F.array_sort("brand_terms"), ",").alias("words")
    )


@query("udf.tokenize", with_items(f" SELECT id, len({TOKENS_SQL})::BIGINT AS n, '{C.TOKENIZER_VERSION}' AS tokenizer_version FROM items"))
def tokenize(spark, d):
    out = keywords.with_brand_tokens(items(spark, d, heavy=True), brand_frame(spark, d))
    return out.select("id", F.size("tokens").cast("bigint").alias("n"), F.lit(C.TOKENIZER_VERSION).alias("tokenizer_version"))


# Letters stand for Han letters here, one for one, so that the words of the benchmark make a dictionary and documents without blanks need it.
_LETTERS, _HAN_LETTERS = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + i) for i in range(26))


@query("tok.dictionary_words", f"""SELECT translate(w, '{_LETTERS}', '{_HAN_LETTERS}') AS word, count(*) AS freq FROM (
 SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) WHERE length(w) BETWEEN 2 AND 6 GROUP BY 1""")
def dictionary_words(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w"))
    counted = words.filter("length(w) between 2 and 6").groupBy(F.translate("w", _LETTERS, _HAN_LETTERS).alias("word")).agg(F.count("*").alias("freq"))
    return segment.dictionary_rows(counted)


@query("tok.best_path")
def best_path(spark, d):
    """Documents without blanks, cut by the dictionary above: beyond SQL, tested against all paths of small texts."""
    tokenizer = segment.write_dictionary(dictionary_words(spark, d), scratch(spark, "dictionary"))
    body = F.translate(F.replace(F.lower("text"), F.lit(" "), F.lit("")), _LETTERS, _HAN_LETTERS)
    cut = spread(table(spark, d, "documents"), "doc_id").withColumn("tokens", tokenizer.tokens(F.coalesce(body, F.lit(""))))
    return cut.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


_TFDF = f""", tok AS (SELECT report_id, id, unnest({TOKENS_SQL}) AS term FROM items), tf AS (
 SELECT report_id, term, count(*) AS term_frequency, count(DISTINCT id) AS document_frequency FROM tok GROUP BY ALL)"""


@query("kw.tf_df", with_items(_TFDF + " SELECT * FROM tf"))
def tf_df(spark, d):
    return keywords.tf_df(keywords.with_tokens(items(spark, d, heavy=True)))


@query("kw.rank", with_items(_TFDF + """ SELECT * FROM tf WHERE term NOT IN ('th', 'der')
 QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY document_frequency DESC, term) <= 30"""))
def rank(spark, d):
    rows = items(spark, d, heavy=True)
    hidden = rows.select("report_id").distinct().select("report_id", F.explode(F.array(F.lit("th"), F.lit("der"))).alias("term"))
    return keywords.rank(keywords.tf_df(keywords.with_tokens(rows)), "document_frequency", 30, hidden)


@query("kw.cluster_labels", with_items(""", w AS (SELECT report_id, topic, unnest(list_distinct(CASE WHEN ordinal % 12 = 0 THEN key_points
  ELSE list_transform(list_filter(regexp_extract_all(text, '([a-zA-Z]{3,}|[一-鿿]{2,})', 1), lambda x: x NOT IN ('這個','真的','但是','覺得')),
  lambda x: substr(x, 1, 16)) END)) AS word FROM (SELECT *, unnest(topic_keys) AS topic FROM items)), c AS (
 SELECT report_id, topic, word, count(*) AS count FROM w GROUP BY ALL)
 SELECT *, CAST(row_number() OVER r AS INT) AS position FROM c WINDOW r AS (PARTITION BY report_id, topic ORDER BY count DESC, word)
 QUALIFY row_number() OVER r <= 5"""))
def cluster_labels(spark, d):
    points = F.when(F.col("ordinal") % 12 == 0, F.col("key_points"))
    members = items(spark, d).select("report_id", F.explode("topic_keys").alias("topic"), points.alias("key_points"), "text")
    return keywords.cluster_labels(members, ["report_id", "topic"])


_QUESTION = "The THON of der und"
_SCORE = " + ".join(f"((length(t) - length(replace(t, '{w}', ''))) // {len(w)})" for w in keywords.question_terms(_QUESTION))


@query("kw.query_rank", with_items(f""", c AS (SELECT report_id, id, ordinal, lower(text) AS t FROM items WHERE text <> ''), s AS (SELECT report_id, id, ordinal, CAST({_SCORE} AS BIGINT) AS score FROM c),
 r AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY score DESC, ordinal) AS position, max(score) OVER (PARTITION BY report_id) AS best FROM s)
 SELECT report_id, id, CAST(position AS INT) AS position, score FROM r WHERE position <= 20 AND (score > 0 OR best = 0)"""))
def query_rank(spark, d):
    return keywords.query_rank(items(spark, d), _QUESTION)
