"""Cleaning, masking, identity, URL, number and date columns."""

from __future__ import annotations

import hashlib


from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.functions import dates, identity, text, values
from opinionlake.operators import hygiene, ranks

from opinionlake.plans import query
from opinionlake.plans.scoped import dates_as_text
from opinionlake.sources.binding import items, table, text_table, with_items

AUTHOR_KEY = hashlib.sha256(b"test author key").digest()  # tests only; a cluster passes its own secret
_SPACE = (r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def norm_sql(col):
    return f"trim(regexp_replace(replace(coalesce({col}, ''), chr(8203), ''), '{_SPACE}+', ' ', 'g'))"


_DIGITS = r"(?:\+?886[- ]?)?(?:0?9\p{Nd}{2}|0\p{Nd}{1,2})[- ]?\p{Nd}{3,4}[- ]?\p{Nd}{3,4}"


def mask_sql(kind, col):
    label, pattern = C.MASKS[kind]
    if kind == "url" or kind == "long_id":
        pattern = pattern if kind == "url" else r"\p{Nd}{8,}"
        return f"regexp_replace({col}, '{pattern}', '{label}', 'g')"
    if kind == "email":
        return f"regexp_replace({col}, '[{C.W}.+-]+@[{C.W}-]+(?:\\.[{C.W}-]+)+', '{label}', 'g')"
    if kind == "phone":
        once = f"regexp_replace({col}, '(^|[^\\p{{Nd}}])(?:{_DIGITS})($|[^\\p{{Nd}}])', '\\1{label}\\2', 'g')"
        return f"regexp_replace({once}, '(^|[^\\p{{Nd}}])(?:{_DIGITS})($|[^\\p{{Nd}}])', '\\1{label}\\2', 'g')"
    return f"regexp_replace({col}, '(^|[^{C.W}])@[A-Za-z0-9_.-]{{2,}}', '\\1{label}', 'g')"


def redact_sql(col):
    out = norm_sql(col)
    for kind in C.MASKS:
        out = mask_sql(kind, out)
    return out


def docs(spark, d):
    return text_table(spark, d).select("doc_id", "text", "lang")


@query("txt.normalize", f"SELECT doc_id, {norm_sql('text')} AS text FROM documents")
def normalize(spark, d):
    return docs(spark, d).select("doc_id", text.normalize(F.col("text")).alias("text"))


@query("txt.fold", "SELECT doc_id, replace(lower(text), 'ß', 'ss') AS folded FROM documents")
def fold(spark, d):
    return docs(spark, d).select("doc_id", text.fold(F.col("text")).alias("folded"))


for _kind in C.MASKS:
    def _one(spark, d, kind=_kind):
        return docs(spark, d).select("doc_id", text.mask(text.normalize(F.col("text")), kind).alias("masked"))

    query(f"txt.redact_{_kind}", f"SELECT doc_id, {mask_sql(_kind, norm_sql('text'))} AS masked FROM documents")(_one)

_LABEL_COUNTS = ", ".join(
    f"CAST((length(masked) - length(replace(masked, '{label}', ''))) // {len(label)} AS BIGINT) AS {kind}"
    for kind, (label, _) in C.MASKS.items()
)


@query("txt.redact_pii", f"SELECT doc_id, masked, {_LABEL_COUNTS} FROM (SELECT doc_id, {redact_sql('text')} AS masked FROM documents)")
def redact_pii(spark, d):
    rows = docs(spark, d).select("doc_id", F.col("text").alias("masked"))
    return text.add_masked(rows, "masked", counts="c").select("doc_id", "masked", "c.*")


@query("prj.model_boundary", with_items(
    f""" SELECT id, {redact_sql('title')} AS title, rating, {redact_sql("'see ' || source_url")} AS note, 'title,rating,note,inner,tags,extra' AS fields, 'inner_text' AS inner_fields,
 {redact_sql('title')} AS inner_text, {redact_sql("'x' || ordinal || '@mail.org'")} || '|' || {redact_sql('text')} AS tags, 'note' AS extra_keys, {redact_sql("'call 0912345678 ' || text")} AS extra_note FROM items"""))
def model_boundary(spark, d):
    nested = items(spark, d, heavy=True).select(
        "id", "title", "rating", F.concat(F.lit("see "), "source_url").alias("note"), "source_url", "board",
        F.struct(F.col("title").alias("inner_text"), F.col("board").alias("forum"), F.col("source_url").alias("address")).alias("inner"),
        F.array(F.concat(F.lit("x"), F.col("ordinal").cast("string"), F.lit("@mail.org")), F.col("text")).alias("tags"),
        F.create_map(F.lit("author"), F.lit("Bob"), F.lit("note"), F.concat(F.lit("call 0912345678 "), "text")).alias("extra"),
    )
    out = hygiene.model_boundary(nested)
    inner = ",".join(out.schema["inner"].dataType.names)
    outer = ",".join(c for c in out.columns if c != "id")
    return out.select(
        "id", "title", "rating", "note", F.lit(outer).alias("fields"), F.lit(inner).alias("inner_fields"), F.col("inner.inner_text").alias("inner_text"),
        F.array_join("tags", "|").alias("tags"), F.array_join(F.map_keys("extra"), ",").alias("extra_keys"), F.col("extra")["note"].alias("extra_note"),
    )


@query("prj.anonymized", with_items(f""" SELECT report_id, id AS review_key, rating,
 strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, {redact_sql('text')} AS text,
 CASE WHEN source <> 'google_maps' THEN source END AS source,
 CASE WHEN source <> 'google_maps' THEN content_type END AS content_type,
 CASE WHEN source <> 'google_maps' THEN {redact_sql('title')} END AS thread_title FROM items WHERE text <> ''"""))
def anonymized(spark, d):
    out = hygiene.anonymized(items(spark, d, heavy=True)).drop("ordinal")
    return out.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


@query("prj.opaque_keys", with_items(
    "SELECT report_id, id, format('e{:03d}', row_number() OVER (PARTITION BY report_id ORDER BY ordinal) - 1) AS opaque FROM items"))
def opaque_keys(spark, d):
    ranked = ranks.block_rank(items(spark, d).select("report_id", "id", "ordinal"), ["report_id"], "ordinal", "n")
    return ranked.select("report_id", "id", F.format_string("e%03d", F.col("n") - 1).alias("opaque"))


_INNER = bytes(b ^ 0x36 for b in AUTHOR_KEY.ljust(64, b"\0")).hex()
_OUTER = bytes(b ^ 0x5C for b in AUTHOR_KEY.ljust(64, b"\0")).hex()


@query("id.author_hash", f"""SELECT event_id, CASE WHEN user_id % 10 <> 0 THEN sha256(unhex('{_OUTER}') ||
 unhex(sha256(unhex('{_INNER}') || encode(event_type || chr(0) || 'user ' || user_id)))) END AS author_hash FROM events""")
def author_hash(spark, d):
    events = table(spark, d, "events")
    author = F.when(F.col("user_id") % 10 != 0, F.concat(F.lit(" user  "), "user_id")).otherwise(" ")
    keys = identity.key_frame(spark, AUTHOR_KEY)
    return events.select("event_id", identity.author_hash(keys, F.col("event_type"), author).alias("author_hash"))


@query("id.content_hash", with_items(
    f"SELECT id, sha256(source || chr(0) || coalesce(board, '') || chr(0) || {norm_sql('text')}) AS content_hash FROM items"))
def content_hash(spark, d):
    return items(spark, d, heavy=True).select("id", identity.content_hash(F.col("source"), F.col("board"), F.col("text")).alias("content_hash"))


_PLACE = "https://www.google.com/maps/place/p"


@query("id.review_hash", with_items(f"""SELECT id, sha256('{_PLACE}' || report_id || '|' || board || '|' ||
 coalesce(CAST(rating AS VARCHAR), '') || '|' || {norm_sql('text')}) AS review_hash
 FROM (SELECT * REPLACE (coalesce(board, '') AS board) FROM items WHERE source = 'google_maps')"""))
def review_hash(spark, d):
    rows = items(spark, d, heavy=True).filter("source = 'google_maps'")
    url = F.concat(F.lit(_PLACE), "report_id", F.lit("/data=x?hl=en"))
    parts = [identity.canonical_place(url), text.normalize(F.col("board")), F.col("rating"), text.normalize(F.col("text"))]
    present = F.coalesce(F.col("board"), F.col("rating").cast("string"), F.col("text"), F.col("id")).isNotNull()
    return rows.filter(present).select("id", identity.joined_hash("|", *parts).alias("review_hash"))


@query("id.subject_key", """SELECT c_custkey, sha256('business|' || lower(c_name) || '|' || lower(c_mktsegment)) AS subject_key FROM customer""")
def subject_key(spark, d):
    c = table(spark, d, "customer")
    key = identity.subject_key(F.lit("Business "), F.col("c_name"), F.concat(F.lit(" "), "c_mktsegment"))
    return c.select("c_custkey", key.alias("subject_key"))


@query("id.legacy_source_id", with_items(
    "SELECT id, CASE WHEN source = 'google_maps' THEN id ELSE substr(source || ':' || id, 1, 500) END AS legacy_id FROM items"))
def legacy_source_id(spark, d):
    tagged = F.substring(F.concat_ws(":", "source", "id"), 1, 500)
    return items(spark, d).select("id", F.when(F.col("source") == "google_maps", F.col("id")).otherwise(tagged).alias("legacy_id"))


_URL_SQL = """, u AS (SELECT id, ordinal, board, CASE ordinal % 8 WHEN 0 THEN source_url WHEN 1 THEN source_url || '?utm_source=x&cid=1'
 WHEN 2 THEN source_url || '/' WHEN 3 THEN replace(source_url, 'https', 'http') WHEN 4 THEN source_url || '?page=2'
 WHEN 5 THEN replace(replace(source_url, '/p/', '/p/00'), 'src', 'SRC') WHEN 6 THEN replace(source_url, 'https://', 'https://u:p@')
 ELSE replace(source_url, '.tw', '.tw:443') END AS url, source_url FROM items)"""


def forum_urls(spark, d):
    n, url = F.col("ordinal") % 8, F.col("source_url")
    made = (
        F.when(n == 0, url)
        .when(n == 1, F.concat(url, F.lit("?utm_source=x&cid=1")))
        .when(n == 2, F.concat(url, F.lit("/")))
        .when(n == 3, F.replace(url, F.lit("https"), F.lit("http")))
        .when(n == 4, F.concat(url, F.lit("?page=2")))
        .when(n == 5, F.replace(F.replace(url, F.lit("/p/"), F.lit("/p/00")), F.lit("src"), F.lit("SRC")))
        .when(n == 6, F.replace(url, F.lit("https://"), F.lit("https://u:p@")))
        .otherwise(F.replace(url, F.lit(".tw"), F.lit(".tw:443")))
    )
    return items(spark, d).select("id", "ordinal", "source_url", made.alias("url"))


@query("url.canonical_article", with_items(_URL_SQL + """ SELECT id, CASE WHEN ordinal % 8 NOT IN (3, 4, 6) THEN source_url END AS url,
 CASE WHEN ordinal % 8 IN (3, 6) THEN 'not_a_public_article' WHEN ordinal % 8 = 4 THEN 'unknown_query_field' END AS reason FROM u"""))
def canonical_article(spark, d):
    return forum_urls(spark, d).select("id", identity.canonical_article(F.col("url")).alias("c")).select("id", "c.*")


@query("url.discovered_article", with_items(_URL_SQL + """ SELECT id, CASE WHEN ordinal % 8 NOT IN (3, 6) THEN source_url END AS url FROM u"""))
def discovered_article(spark, d):
    rows = forum_urls(spark, d)
    href = F.when(F.col("ordinal") % 8 == 0, F.replace(F.col("url"), F.lit("https://www.dcard.tw"), F.lit(""))).otherwise(F.col("url"))
    return rows.select("id", identity.discovered_article(href).alias("url"))


@query("url.place", "SELECT page_id, rtrim(split_part(split_part(url, '?', 1), '/data=', 1), '/') AS url FROM pages")
def place_url(spark, d):
    return table(spark, d, "pages").select("page_id", identity.canonical_place(F.col("url")).alias("url"))


@query("url.place_allowed", """SELECT page_id, page_id % 5 IN (0, 2, 3) AS allowed FROM pages""")
def place_allowed(spark, d):
    n = F.col("page_id") % 5
    url = (
        F.when(n == 0, F.lit("https://www.google.com.tw/maps/place/x"))
        .when(n == 1, F.lit("https://www.google.com/search?q=x"))
        .when(n == 2, F.lit("https://maps.app.goo.gl/abc"))
        .when(n == 3, F.lit("http://maps.google.com/maps?cid=1"))
        .otherwise(F.col("url"))
    )
    return table(spark, d, "pages").select("page_id", identity.place_allowed(url).alias("allowed"))


@query("url.safe", with_items(_URL_SQL + " SELECT id, CASE WHEN ordinal % 8 <> 6 THEN url END AS url FROM u"))
def safe_url(spark, d):
    return forum_urls(spark, d).select("id", identity.safe_url(F.col("url")).alias("url"))


@query("map.metrics", with_items("""SELECT id, CASE WHEN reply_count IS NOT NULL THEN 'reply_count=' || reply_count || ';' ELSE '' END ||
 'reaction_count=' || reaction_count || ';' || CASE WHEN ordinal % 4 <> 0 THEN 'floor=' || (ordinal % 4) || ';' ELSE '' END AS metrics,
 CASE WHEN ordinal % 2 = 0 THEN signal END AS signal FROM items"""))
def metrics(spark, d):
    floor = F.when(F.col("ordinal") % 4 == 0, F.lit(-1)).otherwise(F.col("ordinal") % 4)
    raw = F.create_map(
        F.lit("reply_count"), F.col("reply_count").cast("double"), F.lit("reaction_count"), F.col("reaction_count").cast("double"),
        F.lit("floor"), floor.cast("double"), F.lit("ip_address"), F.lit(1.0),
    )
    kept = F.map_entries(values.metrics(raw))
    shown = F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("bigint").cast("string"), F.lit(";")))
    signal = values.signal(F.when(F.col("ordinal") % 2 == 0, F.col("signal")).otherwise("shout"))
    return items(spark, d).select("id", F.array_join(shown, "").alias("metrics"), signal.alias("signal"))


@query("map.diagnostics", """SELECT c_custkey, 'pages_fetched=' || (c_custkey % 10) || ';' || CASE WHEN c_custkey % 5 <> 0
 THEN 'duplicate_items=' || (c_custkey % 5) || ';' ELSE '' END AS counters,
 CASE WHEN c_custkey % 2 = 0 THEN 'page_limit,unknown_date' ELSE 'unknown_date' END AS reasons FROM customer""")
def diagnostics(spark, d):
    c, n = table(spark, d, "customer"), F.col("c_custkey")
    raw = F.create_map(
        F.lit("pages_fetched"), n % 10, F.lit("cursor"), n, F.lit("duplicate_items"), F.when(n % 5 == 0, -1).otherwise(n % 5)
    )
    shown = F.transform(
        F.map_entries(values.diagnostics(raw)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"), F.lit(";"))
    )
    reasons = F.array(F.when(n % 2 == 0, "page_limit").otherwise("secret"), F.lit("unknown_date"), F.lit("unknown_date"))
    return c.select(
        "c_custkey", F.array_join(shown, "").alias("counters"), F.array_join(values.known_reasons(reasons), ",").alias("reasons")
    )


@query("csv.formula_safe", """SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN '''' ELSE '' END || v AS safe FROM (
 SELECT doc_id, [' =', '@', '-', 'x-'][CAST(doc_id % 4 + 1 AS INT)] || lang AS v FROM documents)""")
def formula_safe(spark, d):
    lead = F.element_at(F.array(*[F.lit(x) for x in (" =", "@", "-", "x-")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs(spark, d).select("doc_id", text.formula_safe(F.concat(lead, "lang")).alias("safe"))


@query("num.first_int", """SELECT o_orderkey, o_orderkey AS n, (o_orderkey % 50) / 10.0::DOUBLE AS x FROM orders""")
def first_int(spark, d):
    o = table(spark, d, "orders")
    grouped = F.format_number("o_orderkey", 0)
    stars = F.format_string("%.1f 顆星", (F.col("o_orderkey") % 50) / F.lit(10.0))
    return o.select(
        "o_orderkey", values.first_int(F.concat(F.lit("共 "), grouped, F.lit(" 則"))).alias("n"), values.first_decimal(stars).alias("x")
    )


@query("num.counter", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS n FROM orders")
def counter(spark, d):
    value = F.when(F.col("o_orderkey") % 3 != 0, F.format_number("o_orderkey", 0)).otherwise(F.concat(F.lit("+"), "o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", values.counter(value).alias("n"))


_UNITS = ("minute", "hour", "day", "week", "month", "year")
_ZH_UNITS = ("分鐘", "小時", "天", "星期", "月", "年")
_TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def _shown(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def relative_dates(spark, d):
    """'<n> <unit>s ago' or its Chinese form by turn; every seventh row is unparseable."""
    e, n = table(spark, d, "events"), F.col("event_id") % 50
    pick = lambda words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("event_id") % 6 + 1).cast("int"))
    english = F.concat(n.cast("string"), F.lit(" "), pick(_UNITS), F.lit("s ago"))
    chinese = F.concat(n.cast("string"), F.lit(" 個"), pick(_ZH_UNITS), F.lit("前（已編輯）"))
    phrase = F.when(F.col("event_id") % 7 == 0, "yesterday-ish").when(F.col("event_id") % 2 == 0, english).otherwise(chinese)
    return e.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("now"), phrase.alias("relative_date"))


_REL = f"""rel AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 7 <> 0 THEN
  ts - to_minutes((event_id % 50) * [1, 60, 1440, 10080, 43200, 525600][CAST(event_id % 6 + 1 AS INT)]) END AS est,
  CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE ['day','day','day','week','month','year'][CAST(event_id % 6 + 1 AS INT)] END AS precision
  FROM events)"""


@query("dt.relative", f"WITH {_REL} SELECT event_id, {_TS.format('est')} AS instant, precision FROM rel")
def relative(spark, d):
    rows = relative_dates(spark, d).withColumn("r", dates.relative(F.col("relative_date"), F.col("now")))
    return rows.select("event_id", _shown("r.at").alias("instant"), F.col("r.precision").alias("precision"))


@query("dt.estimate", f"""WITH {_REL} SELECT event_id, {_TS.format("CASE WHEN user_id % 2 = 0 THEN ts ELSE est END")} AS published_at,
 CASE WHEN user_id % 2 = 0 THEN 'week' ELSE precision END AS date_precision FROM rel""")
def estimate(spark, d):
    rows = relative_dates(spark, d).withColumns(
        {"published_at": F.when(F.col("user_id") % 2 == 0, F.col("now")), "date_precision": F.lit("week")}
    )
    out = hygiene.estimate_date(rows, F.col("now"))
    return out.select("event_id", _shown("published_at").alias("published_at"), "date_precision")


@query("dt.absolute", f"""SELECT event_id, {_TS.format('utc')} AS utc, {_TS.format('forum')} AS forum FROM (SELECT event_id,
 CASE event_id % 6 WHEN 5 THEN NULL WHEN 4 THEN date_trunc('second', ts) - INTERVAL 9 HOUR
  WHEN 2 THEN ts - INTERVAL 8 HOUR WHEN 3 THEN date_trunc('second', ts) ELSE ts END AS utc,
 CASE event_id % 6 WHEN 5 THEN NULL WHEN 4 THEN date_trunc('second', ts) - INTERVAL 9 HOUR WHEN 0 THEN ts
  WHEN 2 THEN ts - INTERVAL 8 HOUR WHEN 3 THEN date_trunc('second', ts) ELSE ts - INTERVAL 8 HOUR END AS forum FROM events)""")
def absolute(spark, d):
    n, ts = F.col("event_id") % 6, F.col("ts")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rfc = F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss")
    value = (
        F.when(n == 0, F.concat(iso, F.lit("Z"))).when(n == 1, iso).when(n == 2, F.concat(iso, F.lit("+08:00")))
        .when(n == 3, F.concat(rfc, F.lit(" GMT"))).when(n == 4, F.concat(rfc, F.lit(" +0900"))).otherwise("soon")
    )
    return table(spark, d, "events").select(
        "event_id", _shown(dates.absolute(value)).alias("utc"), _shown(dates.absolute(value, "+08:00")).alias("forum")
    )


@query("dt.local_day", "SELECT event_id, CAST(CAST(ts + INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS day FROM events")
def local_day(spark, d):
    day = dates.local_day(F.col("ts").cast("timestamp"))
    return dates_as_text(table(spark, d, "events").select("event_id", day.alias("day")))


@query("dt.bucket_end", """SELECT l_orderkey, l_linenumber, CAST(CAST(l_shipdate AS DATE) + 1 AS VARCHAR) AS day_end,
 CAST(CAST(date_trunc('week', l_shipdate) AS DATE) + 7 AS VARCHAR) AS week_end,
 CAST(CAST(date_trunc('month', l_shipdate) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS month_end FROM lineitem""")
def bucket_end(spark, d):
    day = F.to_date("l_shipdate")
    ends = [dates.next_bucket(dates.bucket(day, i), i).alias(f"{i}_end") for i in ("day", "week", "month")]
    return dates_as_text(table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber"), *ends))


# ---- the cleaning job ---------------------------------------------------------------------
def landed(spark, d):
    """Landed rows: authors by thread, every twelfth without one; every fifth URL unsafe."""
    n = F.col("ordinal")
    rows = items(spark, d, heavy=True).select("id", "source", "title", "text", "source_url", "published_at", "date_precision", "ordinal")
    return rows.withColumns(
        {
            "author": F.when(n % 12 != 0, F.concat(F.lit("user "), (n % 50).cast("string"))),
            "source_url": F.when(n % 5 == 0, F.concat(F.lit("javascript:"), "source_url")).otherwise(F.col("source_url")),
            "relative_date": F.lit(None).cast("string"),
        }
    ).drop("ordinal")


def cleaned(spark, d):
    return hygiene.clean(landed(spark, d), identity.key_frame(spark, AUTHOR_KEY), F.lit("2024-06-01 00:00:00").cast("timestamp"))


@query("job.clean", with_items(f"""SELECT id, source, {redact_sql('text')} AS text, {redact_sql('title')} AS title, md5(folded) AS folded,
 CASE WHEN ordinal % 12 <> 0 THEN sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(source || chr(0) || 'user ' || ordinal % 50)))) END AS author_hash,
 sha256(source || chr(0) || id || chr(0) || {norm_sql('text')}) AS content_hash, CASE WHEN ordinal % 5 <> 0 THEN source_url END AS source_url,
 {_TS.format('published_at')} AS published_at, CASE WHEN published_at IS NULL THEN 'unknown' ELSE date_precision END AS date_precision FROM items"""))
def job_clean(spark, d):
    return cleaned(spark, d).select(
        "id", "source", "text", "title", F.md5("folded").alias("folded"), "author_hash", "content_hash", "source_url", _shown("published_at").alias("published_at"), "date_precision"
    )


_SUMMED = ", ".join(f"CAST(sum((length(m) - length(replace(m, '{label}', ''))) // {len(label)}) AS BIGINT) AS masked_{kind}" for kind, (label, _) in C.MASKS.items())


@query("job.clean_metrics", with_items(f""", m AS (SELECT source, ordinal, published_at, {redact_sql('text')} AS m FROM items)
 SELECT source, count(*) AS rows, {_SUMMED}, count(*) FILTER (published_at IS NULL) AS undated, count(*) FILTER (ordinal % 5 = 0) AS invalid_url FROM m GROUP BY source"""))
def job_clean_metrics(spark, d):
    return hygiene.clean_metrics(cleaned(spark, d))
