"""Sentiment labelling, vectors and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.functions import sentiment as rules
from opinionlake.functions import text, values
from opinionlake.operators import labelling, report_job, retrieval, topics, vector_index
from opinionlake.operators import scope as S
from opinionlake.plans import query
from opinionlake.plans.hygiene import norm_sql
from opinionlake.plans.reporting import _BLOCKS as BLOCK_SQL
from opinionlake.session import scratch, stored
from opinionlake.sources.binding import bare_items, items, table, text_table, with_items

_CLASSES = labelling.CLASSES


def _hits(words):
    return " + ".join(f"(length(lo) - length(replace(lo, '{w}', ''))) // {len(w)}" for w in words)


_LEX = f""", lx AS (SELECT *, lower(text) AS lo FROM items), lg AS (SELECT *, {_hits(C.POSITIVE_WORDS)} AS g, {_hits(C.NEGATIVE_WORDS)} AS b FROM lx), ll AS (
 SELECT *, CASE WHEN g = 0 AND b = 0 THEN 'neutral' WHEN g >= b THEN 'positive' ELSE 'negative' END AS l FROM lg), lex AS (
 SELECT * , CASE WHEN l = 'neutral' THEN 0.5::DOUBLE ELSE least(0.55::DOUBLE + 0.08::DOUBLE * abs(g - b), 0.85::DOUBLE) END AS conf FROM ll), lexs AS (
 SELECT *, {", ".join(f"CASE WHEN l = '{c}' THEN conf ELSE (1 - conf) / 2 END AS s_{c}" for c in _CLASSES)} FROM lex)"""


@query("sen.lexicon", with_items(_LEX + f""" SELECT id, l AS sentiment, round(conf, 9) AS confidence,
 {", ".join(f"round(s_{c}, 9) AS {c}" for c in _CLASSES)} FROM lexs"""))
def lexicon(spark, d):
    out = rules.add_lexicon(items(spark, d, heavy=True).select("id", "text"), F.col("text"))
    return out.select("id", "sentiment", *[F.round(c, 9).alias(c) for c in ("confidence", *_CLASSES)])


def mixed_items(spark, d):
    """Items where every eleventh text is blank and short board comments vote."""
    n = F.col("ordinal")
    body = F.when(n % 11 == 0, F.lit("  ")).when(n % 10 == 1, F.lit("推")).otherwise(F.col("text"))
    return items(spark, d, heavy=True).withColumn("text", body)


_MIXED = """, mixed AS (SELECT * REPLACE (CASE WHEN ordinal % 11 = 0 THEN '  ' WHEN ordinal % 10 = 1 THEN '推' ELSE text END AS text) FROM items)"""


@query("sen.rating_only", with_items(_MIXED + """ SELECT id, CASE WHEN trim(text) = '' THEN 'rating_only' END AS sentiment,
 CASE WHEN trim(text) = '' THEN 1.0::DOUBLE END AS confidence FROM mixed"""))
def rating_only(spark, d):
    blank = text.normalize(F.col("text")) == ""
    return mixed_items(spark, d).select(
        "id", F.when(blank, F.lit("rating_only")).alias("sentiment"), F.when(blank, F.lit(1.0)).alias("confidence")
    )


@query("sen.rating", with_items("SELECT id, rated AS sentiment FROM items"))
def star(spark, d):
    return items(spark, d).select("id", rules.star_sentiment(F.col("rating")).alias("sentiment"))


@query("sen.vote_rule", with_items(_MIXED + """ SELECT id, CASE WHEN source = 'ptt' AND content_type = 'comment' AND length(text) <= 4 THEN
 CASE signal WHEN 'push' THEN 'positive' WHEN 'boo' THEN 'negative' END END AS sentiment FROM mixed"""))
def vote_rule(spark, d):
    rule = rules.vote_rule(F.col("source"), F.col("content_type"), F.col("text"), F.col("signal"))
    return mixed_items(spark, d).select("id", rule.alias("sentiment"))


def _groups(patterns):
    # The look-behind of the first praise group becomes an explicit previous character.
    return " + ".join(f"CAST(regexp_matches(nt, '(?i){p.replace('(?<!不)', '(?:^|[^不])')}') AS INT)" for p in patterns)


_CAL = _LEX.replace("FROM items)", "FROM mixed)", 1) + f""", pre AS (SELECT *, {norm_sql('text')} AS nt,
  source = 'ptt' AND content_type = 'comment' AND length(text) <= 4 AND signal IN ('push', 'boo') AS vote FROM lexs), raw AS (
 SELECT *, CASE WHEN vote THEN CASE signal WHEN 'push' THEN 'positive' ELSE 'negative' END WHEN nt = '' THEN 'rating_only' ELSE l END AS l0,
  CASE WHEN vote THEN 0.95::DOUBLE WHEN nt = '' THEN 1 ELSE conf END AS c0,
  CASE WHEN vote THEN CASE signal WHEN 'push' THEN 0.95::DOUBLE ELSE 0 END ELSE s_positive END AS r_positive, CASE WHEN vote THEN 0.05::DOUBLE ELSE s_neutral END AS r_neutral,
  CASE WHEN vote THEN CASE signal WHEN 'boo' THEN 0.95::DOUBLE ELSE 0 END ELSE s_negative END AS r_negative,
  CASE WHEN vote THEN '{C.VOTE_MODEL}' ELSE '{C.LEXICON_MODEL}' END AS m0,
  {_groups(C.POSITIVE_PHRASES)} AS ph, {_groups(C.NEGATIVE_PHRASES)} AS nh FROM pre), mx AS (SELECT *,
  r_positive + 0.62::DOUBLE * ph + CASE rating WHEN 5 THEN 0.52::DOUBLE WHEN 4 THEN 0.34::DOUBLE ELSE 0 END AS x_positive,
  r_neutral + CASE rating WHEN 3 THEN 0.18::DOUBLE ELSE 0 END AS x_neutral,
  r_negative + 0.62::DOUBLE * nh + CASE rating WHEN 1 THEN 0.52::DOUBLE WHEN 2 THEN 0.34::DOUBLE ELSE 0 END AS x_negative FROM raw), nm AS (
 SELECT *, greatest(x_positive + x_neutral + x_negative, 1.0::DOUBLE) AS tot FROM mx), cal AS (SELECT *, CASE WHEN l0 = 'rating_only' THEN l0
  WHEN x_positive / tot >= x_neutral / tot AND x_positive / tot >= x_negative / tot THEN 'positive' WHEN x_neutral / tot >= x_negative / tot THEN 'neutral' ELSE 'negative' END AS label,
  CASE WHEN l0 = 'rating_only' THEN c0 ELSE greatest(x_positive, x_neutral, x_negative) / tot END AS cc,
  CASE WHEN l0 <> 'rating_only' AND (ph > 0 OR nh > 0 OR rating IS NOT NULL) THEN m0 || '{C.CONTEXT_SUFFIX}' ELSE m0 END AS model FROM nm)"""


@query("sen.calibrate", with_items(_MIXED + _CAL + """ SELECT id, label AS sentiment, round(cc, 9) AS confidence, model AS local_model_id FROM cal"""))
def calibrate(spark, d):
    out = labelling.label_items(mixed_items(spark, d))
    return out.select("id", "sentiment", F.round("confidence", 9).alias("confidence"), "local_model_id")


@query("sen.conflict", with_items(_MIXED + _CAL + """ SELECT id, rated AS rating_sentiment,
 coalesce(label <> 'rating_only' AND label <> rated, false) AS rating_text_conflict FROM cal"""))
def conflict(spark, d):
    return labelling.label_items(mixed_items(spark, d)).select("id", "rating_sentiment", "rating_text_conflict")


@query("sen.fallback_count", with_items(_MIXED + _CAL + f""" SELECT report_id, count(*) AS fallback FROM cal WHERE text <> '' AND m0 = '{C.LEXICON_MODEL}' GROUP BY 1"""))
def fallback_count(spark, d):
    rows = mixed_items(spark, d)
    return labelling.fallback_count(labelling.label_items(rows), rows)


def length_model():
    """Deterministic stand-in classifier: scores from the text length."""
    return lambda texts: [
        [("LABEL_2", (len(t) % 10) / 20), ("neu", (len(t) % 7) / 20), ("Negative", (len(t) % 4) / 20), ("pos_extra", 0.05)] for t in texts
    ]


length_scorer = labelling.scorer_udf(length_model)
_P, _U, _N = "((n % 10) / 20.0::DOUBLE + 0.05::DOUBLE)", "((n % 7) / 20.0::DOUBLE)", "((n % 4) / 20.0::DOUBLE)"


@query("sen.model_scores", f"""SELECT doc_id, CASE WHEN {_P} >= {_U} AND {_P} >= {_N} THEN 'positive' WHEN {_U} >= {_N} THEN 'neutral' ELSE 'negative' END AS sentiment,
 round(greatest({_P}, {_U}, {_N}), 9) AS confidence FROM (SELECT doc_id, length(text) AS n FROM documents)""")
def model_scores(spark, d):
    scored = table(spark, d, "documents").select("doc_id", length_scorer("text").alias("s"))
    return scored.select("doc_id", labelling.picked(F.col("s")).alias("p")).select("doc_id", "p.sentiment", F.round("p.confidence", 9).alias("confidence"))


@query("udf.sentiment", with_items("""SELECT label, count(*) AS rows FROM (SELECT CASE WHEN p >= u AND p >= g THEN 'positive' WHEN u >= g THEN 'neutral' ELSE 'negative' END AS label FROM (
 SELECT (n % 10) / 20.0::DOUBLE + 0.05::DOUBLE AS p, (n % 7) / 20.0::DOUBLE AS u, (n % 4) / 20.0::DOUBLE AS g FROM (SELECT length(text) AS n FROM items))) GROUP BY 1"""))
def udf_sentiment(spark, d):
    scored = items(spark, d).select(length_scorer("text").alias("s"))
    return scored.select(labelling.picked(F.col("s"))["sentiment"].alias("label")).groupBy("label").agg(F.count("*").alias("rows"))


@query("sen.chunked", f"""WITH t AS (SELECT doc_id, string_split({norm_sql('text')}, ' ') AS w FROM documents), s AS (
 SELECT doc_id, w, unnest(CASE WHEN len(w) <= {C.CHUNK_TOKENS} THEN [0] ELSE generate_series(0, len(w) - 1, {C.CHUNK_STRIDE}) END) AS st FROM t), c AS (
 SELECT doc_id, greatest(length(array_to_string(w[st + 1:st + {C.CHUNK_TOKENS}], ' ')), 1) AS wt, length(array_to_string(w[st + 1:st + {C.CHUNK_TOKENS}], ' ')) AS n FROM s)
 SELECT doc_id, count(*) AS chunks, round(sum({_P} * wt) / sum(wt), 6) AS positive, round(sum({_U} * wt) / sum(wt), 6) AS neutral, round(sum({_N} * wt) / sum(wt), 6) AS negative FROM c GROUP BY 1""")
def chunked(spark, d):
    words = F.split(text.normalize(F.col("text")), " ")
    out = labelling.chunked_scores(text_table(spark, d), "doc_id", words, length_scorer)
    return out.select("doc_id", "chunks", *[F.round(c, 6).alias(c) for c in _CLASSES])


# ---- vectors ------------------------------------------------------------------------------
def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding")


QUERY = [round(((i * 37) % 19 - 9) / 40, 3) for i in range(64)]
_DOT = "list_sum(list_transform(list_zip(embedding, " + str(QUERY) + "), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


@query("vec.topk", f"SELECT vec_id, round({_DOT}, 6) AS score FROM embeddings WHERE len(embedding) = 64 ORDER BY {_DOT} DESC, vec_id LIMIT 20")
def topk(spark, d):
    return retrieval.topk(vectors(spark, d), QUERY).select("vec_id", F.round("score", 6).alias("score"))


@query("vec.scoped", with_items(f"""SELECT report_id, vec_id, round({_DOT}, 6) AS score FROM embeddings JOIN items ON ordinal = vec_id WHERE source <> 'ptt'
 QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY {_DOT} DESC, vec_id) <= 20"""))
def scoped(spark, d):
    allowed = S.select(items(spark, d).filter("source <> 'ptt'"), S.Scope()).select("report_id", F.col("ordinal").alias("vec_id"))
    rows = vectors(spark, d).join(allowed, "vec_id")
    return retrieval.topk(rows, QUERY, keys=["report_id"]).select("report_id", "vec_id", F.round("score", 6).alias("score"))


def label_queries(spark, d):
    """One query vector per label: the mean of its vectors."""
    e = table(spark, d, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return parts.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(packed.alias("embedding"))


_BATCH_SQL = """WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), q AS (
 SELECT label::BIGINT AS query_id, list(x ORDER BY i) AS qv FROM (SELECT label, i, avg(x) AS x FROM p GROUP BY ALL) GROUP BY 1), s AS (
 SELECT query_id, vec_id, list_dot_product(qv, embedding::DOUBLE[]) AS score FROM q CROSS JOIN embeddings)
 SELECT query_id, vec_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""


@query("vec.batch_topk", _BATCH_SQL)
def batch_topk(spark, d):
    out = retrieval.batch_topk(vectors(spark, d), label_queries(spark, d))
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("vec.index_topk", _BATCH_SQL)
def index_topk(spark, d):
    out = vector_index.search(spark, vector_index.build(vectors(spark, d)), label_queries(spark, d))
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"))


def broken_vectors(spark, d):
    """Vectors with zero, missing and non-finite entries mixed in by id."""
    n = F.col("vec_id") % 10
    bad = F.transform("embedding", lambda x, i: F.when(i == 3, F.lit(float("nan")).cast("float")).otherwise(x))
    made = (
        F.when(n == 1, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).when(n == 2, bad).when(n == 3, None).otherwise(F.col("embedding"))
    )
    return vectors(spark, d).select("vec_id", made.alias("embedding"))


@query("vec.valid", """SELECT vec_id, round(embedding[1] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first,
 round(embedding[64] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS last FROM embeddings WHERE vec_id % 10 NOT IN (1, 2, 3)""")
def valid(spark, d):
    out = retrieval.valid_vectors(broken_vectors(spark, d))
    pick = lambda i: F.round(F.element_at("embedding", i), 6)
    return out.select("vec_id", pick(1).alias("first"), pick(64).alias("last"))


_SLOT = "CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64"


@query("udf.embed", f"""WITH t AS (SELECT doc_id, unnest(list_concat(['passage'], regexp_extract_all(lower(text), '[a-z0-9]+'))) AS t FROM documents), c AS (
 SELECT doc_id, {_SLOT} AS slot, count(*)::DOUBLE AS n FROM t GROUP BY ALL)
 SELECT doc_id, 64::BIGINT AS dim, round(sum(slot * n) / sqrt(sum(n * n)), 6) AS moment, round(max(n) / sqrt(sum(n * n)), 6) AS peak FROM c GROUP BY 1""")
def embed(spark, d):
    v = text_table(spark, d).select("doc_id", labelling.encode_passages("text").alias("v"))
    weighted = F.aggregate(F.transform("v", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return v.select("doc_id", F.size("v").cast("bigint").alias("dim"), F.round(weighted, 6).alias("moment"), F.round(F.array_max("v"), 6).alias("peak"))


# ---- topics -------------------------------------------------------------------------------
MODEL = "hashing-64"


def item_vectors(spark, d):
    """Vectors of the complaint texts - the only rows that are clustered. Stored, since every reader would encode the texts again."""
    return stored(complaints(spark, d).select("id", labelling.encode_passages("text").alias("embedding")), "item-vectors")


def complaints(spark, d):
    return items(spark, d, heavy=True).filter(S.complaint())


def assigned(spark, d, vectors):
    return topics.cluster(complaints(spark, d), vectors)


_CLUSTERS = f""", cm AS (SELECT report_id, id, key_points, text FROM items WHERE coalesce(sentiment = 'negative' OR len(negative_aspects) > 0, false) AND trim(text) <> ''),
 tk AS (SELECT id, {_SLOT} AS slot FROM (SELECT id, unnest(list_concat(['passage'], regexp_extract_all(lower(text), '[a-z0-9]+'))) AS t FROM cm)),
 cn AS (SELECT id, slot, count(*)::DOUBLE AS n FROM tk GROUP BY ALL),
 dn AS (SELECT id, list_transform(range(64), lambda s: coalesce(list_extract(map_extract(m, s), 1), 0)) AS c FROM (SELECT id, map(list(slot), list(n)) AS m FROM cn GROUP BY id)),
 vv AS MATERIALIZED (SELECT id, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS v FROM dn),
 pt AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY id) AS n FROM (SELECT report_id, v, min(id) AS id FROM cm JOIN vv USING (id) GROUP BY ALL)),
 ad AS MATERIALIZED (SELECT b.report_id, b.n, list(a.n) AS before FROM pt a JOIN pt b ON a.report_id = b.report_id AND a.n < b.n AND round(list_dot_product(a.v, b.v), 9) >= {C.CLUSTER_JOIN} GROUP BY ALL),
 rec AS (SELECT report_id, n, [n] AS ld FROM pt WHERE n = 1 UNION ALL
  SELECT p.report_id, p.n, CASE WHEN list_has_any(ld, coalesce(before, [])) THEN ld ELSE list_append(ld, p.n) END
  FROM rec r JOIN pt p ON p.report_id = r.report_id AND p.n = r.n + 1 LEFT JOIN ad ON ad.report_id = p.report_id AND ad.n = p.n),
 ld AS (SELECT report_id, unnest(ld) AS n FROM (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY n DESC) = 1)),
 ls AS MATERIALIZED (SELECT pt.* FROM pt JOIN ld USING (report_id, n)),
 bl AS (SELECT p.report_id, p.v, l.id AS leader FROM pt p JOIN ls l ON l.report_id = p.report_id AND l.n <= p.n
  QUALIFY row_number() OVER (PARTITION BY p.report_id, p.n ORDER BY l.n = p.n DESC, round(list_dot_product(l.v, p.v), 9) DESC, l.id) = 1),
 cl AS MATERIALIZED (SELECT report_id, id, leader, v, key_points, text FROM cm JOIN vv USING (id) JOIN bl USING (report_id, v))"""
_MATCHED = f""", ce AS (SELECT report_id, leader, i, sum(x) AS x FROM (SELECT report_id, leader, unnest(v) AS x, unnest(range(64)) AS i FROM cl) GROUP BY ALL),
 cv AS (SELECT report_id, leader, list(x ORDER BY i) AS s FROM ce GROUP BY ALL),
 ck AS MATERIALIZED (SELECT report_id, leader, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS v, sha256(report_id || '|' || leader) AS own,
  (SELECT count(*) FROM cl WHERE cl.report_id = cv.report_id AND cl.leader = cv.leader) AS count FROM cv),
 mt AS (SELECT a.report_id, a.leader, b.own AS k, list_dot_product(a.v, b.v) AS s FROM ck a JOIN ck b ON b.report_id = 'r' || (substr(a.report_id, 2)::INT - 1)),
 mb AS (SELECT *, lead(s) OVER w AS second FROM mt WINDOW w AS (PARTITION BY report_id, leader ORDER BY s DESC, k DESC) QUALIFY row_number() OVER w = 1),
 mw AS (SELECT report_id, k, min(leader) AS leader FROM mb WHERE s >= {C.TOPIC_MATCH} AND (second IS NULL OR s - second >= {C.TOPIC_MARGIN}) GROUP BY ALL),
 md AS (SELECT ck.report_id, ck.leader, coalesce(k, own) AS topic_key, CASE WHEN k IS NULL THEN 'new' ELSE 'matched' END AS mapping, count FROM ck LEFT JOIN mw USING (report_id, leader))"""


def _recursive(sql):
    return with_items(sql).replace("WITH ", "WITH RECURSIVE ", 1)


@query("topic.cluster", _recursive(_CLUSTERS + " SELECT report_id, id, leader FROM cl"))
def topic_cluster(spark, d):
    return assigned(spark, d, item_vectors(spark, d))


def matched(found, vectors):
    """Reports of one subject in order r0 < r1 < r2 < r3; topics of the report before are the previous ones."""
    mine = stored(topics.centroids(found, vectors, MODEL), "centroids")
    previous = mine.select("report_id", F.col("own_key").alias("topic_key"), "centroid", "embedding_model")
    number = F.substring("report_id", 2, 9).cast("int")
    lineage = mine.select("report_id").distinct().select("report_id", F.concat(F.lit("r"), (number - 1).cast("string")).alias("previous"))
    return topics.match_previous(mine, previous, lineage)


@query("topic.match_previous", _recursive(_CLUSTERS + _MATCHED + " SELECT * FROM md"))
def match_previous(spark, d):
    known = item_vectors(spark, d)
    return matched(assigned(spark, d, known), known).select("report_id", "leader", "topic_key", "mapping", "count")


@query("topic.rows", _recursive(_CLUSTERS + _MATCHED + f""", w AS (SELECT report_id, leader, unnest(list_distinct(key_points)) AS word FROM cl), wc AS (
 SELECT *, row_number() OVER (PARTITION BY report_id, leader ORDER BY n DESC, word) AS position FROM (SELECT report_id, leader, word, count(*) AS n FROM w GROUP BY ALL)),
 wl AS (SELECT report_id, leader, list(word ORDER BY position) AS ws FROM wc WHERE position <= 5 GROUP BY ALL)
 SELECT report_id, topic_key, leader, coalesce(ws[1], '{C.UNNAMED_TOPIC}') AS name, coalesce(array_to_string(ws, ','), '') AS keywords, md.count, md.count < 2 AS provisional, mapping,
  list_transform(ck.v, lambda x: round(x, 6)) AS centroid, '{MODEL}' AS embedding_model, '{C.TOPIC_VERSION}' AS version, item_ids FROM md JOIN ck USING (report_id, leader)
  JOIN (SELECT report_id, leader, list(id ORDER BY id) AS item_ids FROM cl GROUP BY ALL) USING (report_id, leader) LEFT JOIN wl USING (report_id, leader)"""))
def topic_rows(spark, d):
    known = item_vectors(spark, d)
    found = assigned(spark, d, known)
    out = topics.rows(matched(found, known), found, items(spark, d)).join(topics.members(found), ["report_id", "leader"])
    out = out.withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 6)))
    return out.orderBy("report_id", F.desc("count"), "leader")


@query("topic.coverage", with_items("""SELECT report_id, count(*) FILTER (c) AS complaints, count(*) FILTER (c AND v.vec_id IS NULL) AS missing_embeddings,
 CASE WHEN count(*) FILTER (c AND v.vec_id IS NULL) > 0 THEN 'partial' ELSE 'completed' END AS status FROM (
 SELECT *, coalesce(sentiment = 'negative' OR len(negative_aspects) > 0, false) AND trim(text) <> '' AS c FROM items)
 LEFT JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 10 NOT IN (1, 2, 3)) v ON v.vec_id = ordinal GROUP BY 1"""))
def coverage(spark, d):
    known = broken_vectors(spark, d).select(F.col("vec_id").cast("string").alias("id"), "embedding")
    return topics.coverage(items(spark, d), known)


# ---- the report job -----------------------------------------------------------------------
_JOB_ITEMS = _CAL.replace("FROM mixed)", "FROM items)", 1) + """, job AS MATERIALIZED (SELECT * REPLACE (coalesce(label_sentiment, label) AS sentiment,
 CASE WHEN label_sentiment IS NULL THEN []::VARCHAR[] ELSE negative_aspects END AS negative_aspects,
 CASE WHEN label_sentiment IS NULL THEN []::VARCHAR[] ELSE key_points END AS key_points,
 CASE WHEN label_sentiment IS NULL THEN coalesce(label <> 'rating_only' AND label <> rated, false) ELSE rating_text_conflict END AS rating_text_conflict) FROM cal)"""


@query("job.report", _recursive(_JOB_ITEMS + (_CLUSTERS + BLOCK_SQL).replace("FROM items", "FROM job") + """ SELECT blk.*, complaints, topics, topic_items FROM blk
 JOIN (SELECT report_id, count(*) AS complaints FROM cm GROUP BY 1) USING (report_id)
 JOIN (SELECT report_id, count(DISTINCT leader) AS topics, count(*) AS topic_items FROM cl GROUP BY 1) USING (report_id) WHERE block = 'overall'"""))
def report_job_run(spark, d):
    """Labels that are missing are made, complaints get vectors and topics, all is frozen and counted from the frozen items."""
    rows = items(spark, d)
    # Texts come from the relation without labels: joining those moves every text once more.
    stored_items = bare_items(spark, d, heavy=True).select(
        "id", "source", "content_type", "title", "text", "board", "thread_source_id", "source_url", "rating", "published_at", "date_precision", "signal",
        F.create_map(F.lit("reply_count"), F.col("reply_count").cast("double")).alias("metrics"),
    )
    known = rows.filter("label_sentiment is not null").select("report_id", "id", *report_job.LABEL_COLUMNS)
    reports = rows.select("report_id").distinct().select("report_id", F.concat(F.lit("Brand "), "report_id").alias("subject_name"))
    none = spark.createDataFrame([], "id string, embedding array<double>")
    models = report_job.Models(labelling.encode_passages, MODEL)
    out = report_job.run(stored_items, rows.select("report_id", "id", "ordinal"), reports, known, none, models, scratch(spark, "report-job"))
    return out["blocks"].filter("block = 'overall'").join(out["status"].select("report_id", "complaints", "topics", "topic_items"), "report_id")
