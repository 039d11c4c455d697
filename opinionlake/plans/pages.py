"""Saved-page extraction. Pages are the ``pages`` table or are built by Spark from the documents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.functions import identity
from opinionlake.plans import query
from opinionlake.plans.hygiene import AUTHOR_KEY, _INNER, _OUTER, norm_sql
from opinionlake.plans.landing import shown
from opinionlake.sources import pages
from opinionlake.sources.binding import table, text_table

_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def now():
    return F.to_timestamp(F.lit("2026-01-01 00:00:00"))


def keys(spark):
    return identity.key_frame(spark, AUTHOR_KEY)


def escaped(value):
    """Text as a page's markup holds it."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(sign), F.lit(name))
    return value


def docs(spark, d):
    """Documents with their thread; a thread has fifteen documents at any table size."""
    return table(spark, d, "documents").withColumns({"t": F.expr("doc_id div 15"), "k": F.col("doc_id") % 15, "h": escaped(F.col("text"))})


def page_of(rows, fragment):
    """One page per thread: its fragments in document order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", fragment.alias("f")))), lambda s: s["f"]), "\n")
    return rows.groupBy("t").agg(joined.alias("body"))


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# ---- links --------------------------------------------------------------------------------
def board_search_pages(spark, d):
    n, t = F.col("doc_id"), F.col("t")
    board = F.when(n % 4 == 0, "other").otherwise(_cat("b", t % 5))
    one = _cat('<div class="title"><a class="x" href="/bbs/', board, "/M.", n, '.A.html">post <b>', n, "</b></a></div>")
    body = page_of(docs(spark, d), F.when(n % 5 == 0, F.concat(one, one)).otherwise(one))
    own = _cat("b", t % 5)
    back = F.when(t % 3 == 0, _cat("<A HREF='/bbs/", own, "/search?page=2&amp;q=", t, "'>‹ 上頁</A>")).otherwise(_cat('<a href="/bbs/', own, '/index.html">上頁</a>'))
    return body.select(F.col("t").alias("page_id"), own.alias("board"), F.concat("body", back).alias("html"))


@query("page.search_links", """SELECT page_id, kind, href FROM (SELECT DISTINCT doc_id // 15 AS page_id, 'article' AS kind, '/bbs/b' || (doc_id // 15 % 5) || '/M.' || doc_id || '.A.html' AS href FROM documents WHERE doc_id % 4 <> 0
 UNION ALL SELECT DISTINCT doc_id // 15, 'previous', '/bbs/b' || (doc_id // 15 % 5) || '/search?page=2&q=' || (doc_id // 15) FROM documents WHERE doc_id // 15 % 3 = 0)""")
def search_links(spark, d):
    return pages.search_links(board_search_pages(spark, d)).select("page_id", "kind", "href")


def forum_search_pages(spark, d):
    n, t = F.col("doc_id"), F.col("t")
    forum = F.when(n % 3 == 0, "Travel").otherwise("food")
    href = F.when(n % 7 == 0, _cat("https://elsewhere.example/f/food/p/", n)).otherwise(_cat("/f/", forum, "/p/00", n + 1, "?ref=x"))
    body = page_of(docs(spark, d), _cat('<a href="', href, '">t</a>'))
    base = _cat(f"https://{C.FORUM_HOST}/search?query=q", t, "&forum=food")
    onward = (
        F.when(t % 3 == 0, _cat('<a href="/search?query=q', t, '&amp;forum=food&amp;page=2">下一頁</a>'))
        .when(t % 3 == 1, '<a href="/search?query=other&amp;forum=food">next</a><p>No more results</p>')
        .otherwise("<p>沒有更多結果</p>")
    )
    return body.select(F.col("t").alias("page_id"), base.alias("url"), F.concat("body", onward).alias("html"))


@query("page.search_links_json", """SELECT * FROM (SELECT doc_id // 15 AS page_id, 'article' AS kind, 'https://www.dcard.tw/f/food/p/' || (doc_id + 1) AS href FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 3 <> 0
 UNION ALL SELECT DISTINCT doc_id // 15, 'next', 'https://www.dcard.tw/search?query=q' || (doc_id // 15) || '&forum=food&page=2' FROM documents WHERE doc_id // 15 % 3 = 0
 UNION ALL SELECT DISTINCT doc_id // 15, 'exhausted', NULL FROM documents WHERE doc_id // 15 % 3 <> 0)""")
def search_links_json(spark, d):
    return pages.forum_search_links(forum_search_pages(spark, d), ("food",)).select("page_id", "kind", "href")


@query("page.blocked", """SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'blocked' ELSE 'readable' END AS status FROM pages""")
def blocked(spark, d):
    p, n = table(spark, d, "pages"), F.col("page_id") % 9
    quoted = F.concat(F.col("html"), F.lit("<p>Access Denied</p>"))
    markup = F.when(n == 0, F.concat(F.lit("<html><title>Just a moment...</title>"), "html")).when(n == 1, quoted).otherwise(F.col("html"))
    return p.select("page_id", pages.block_status(markup).alias("status"))


# ---- board articles -----------------------------------------------------------------------
def _lines(col):
    skips = " AND ".join(f"NOT starts_with(x, '{p}')" for p in C.BODY_SKIP_PREFIXES)
    all_lines = f"list_transform(string_split(replace({col}, chr(13), ''), chr(10)), lambda x: trim(x))"
    cut = f"(CASE WHEN list_position({all_lines}, '--') > 0 THEN {all_lines}[1:list_position({all_lines}, '--') - 1] ELSE {all_lines} END)"
    return norm_sql(f"array_to_string(list_filter({cut}, lambda x: x <> '' AND {skips}), chr(10))")


_RAW = "(CASE WHEN doc_id % 3 = 0 THEN '> quoted' || chr(10) || text || chr(10) || '--' || chr(10) || 'signature' ELSE text || chr(10) || '※ 編輯: me' END)"


@query("page.body_clean", f"SELECT doc_id, {_lines('raw')} AS body FROM (SELECT doc_id, {_RAW} AS raw FROM documents)")
def body_clean(spark, d):
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("> quoted\n"), "text", F.lit("\n--\nsignature"))).otherwise(F.concat("text", F.lit("\n※ 編輯: me")))
    return text_table(spark, d).select("doc_id", pages.clean_body(raw).alias("body"))


@query("page.thread_time", f"""SELECT event_id, {_TS.format("CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) - INTERVAL 8 HOUR WHEN 1 THEN make_timestamp((1700000000 + event_id) * 1000000) END")} AS posted FROM events""")
def thread_time(spark, d):
    n = F.col("event_id") % 3
    header = F.when(n == 0, F.date_format("ts", "EEE MMM dd HH:mm:ss yyyy")).otherwise("someday")
    thread = F.when(n == 2, "X.1.A").otherwise(_cat("M.", F.col("event_id") + 1700000000, ".A.123"))
    return table(spark, d, "events").select("event_id", shown(pages.thread_time(header, thread)).alias("posted"))


@query("page.comment_year", f"""SELECT event_id, {_TS.format("CASE WHEN event_id % 11 <> 0 THEN date_trunc('minute', ts + to_days(CAST(event_id % 300 AS INT))) END")} AS said FROM events""")
def comment_year(spark, d):
    at = F.col("ts").cast("timestamp")
    local = at + F.make_dt_interval((F.col("event_id") % 300).cast("int"), F.lit(8))
    stamp = F.when(F.col("event_id") % 11 == 0, "02/30 10:00").otherwise(_cat("1.2.3.4 ", F.date_format(local, "MM/dd HH:mm")))
    return table(spark, d, "events").select("event_id", shown(pages.comment_time(stamp, at, now())).alias("said"))


def board_pages(spark, d):
    """Per thread: the first document is the article, the others its comments."""
    n, t = F.col("doc_id"), F.col("t")
    sign = F.element_at(F.array(F.lit("推 "), F.lit("噓 "), F.lit("→ ")), (n % 3 + 1).cast("int"))
    said = F.when(n % 6 == 0, "+1").when(n % 13 == 0, "(本文已被刪除)").otherwise(F.col("h"))
    line = _cat(
        '<div class="push"><span class="hl push-tag">', sign, '</span><span class="f3 push-userid">u', n % 2, '</span><span class="f3 push-content">: ', said,
        '</span><span class="push-ipdatetime"> 1.2.3.4 03/05 10:20\n</span></div>',
    )
    meta = lambda tag, value: _cat(f'<div class="article-metaline"><span class="article-meta-tag">{tag}</span><span class="article-meta-value">', value, "</span></div>")
    head = F.concat(
        F.lit('<html><body><div id="main-content" class="bbs-screen">'), meta("作者", _cat("writer", t % 7, " (nick)")), meta("看板", _cat("b", t % 5)),
        meta("標題", _cat("Title &amp; ", t)), meta("時間", F.lit("Tue Mar 05 10:00:00 2024")), F.lit("\n> quote\n"), F.col("h"), F.lit("<br>second line\n--\nsignature\n"),
    )
    body = page_of(docs(spark, d), F.when(F.col("k") == 0, head).otherwise(line))
    url = _cat(f"https://{C.BOARD_HOST}/bbs/b", t % 5, "/M.", t + 1700000000, ".A.ABC.html")
    return body.select(F.col("t").alias("page_id"), url.alias("url"), F.concat("body", F.lit("</div></body></html>")).alias("html"))


def _hmac(source, author):
    return f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode('{source}' || chr(0) || {author}))))"


_BOARD = f"""dc AS (SELECT *, doc_id // 15 AS t, doc_id % 15 AS k, {norm_sql('text')} AS h FROM documents), cm AS (SELECT t, k, CASE WHEN doc_id % 6 = 0 THEN '+1' ELSE regexp_replace(regexp_replace(': ' || text, '\\s+$', ''), '^[:： ]+', '') END AS said, ['push', 'boo', 'neutral'][CAST(doc_id % 3 + 1 AS INT)] AS signal,
 {_hmac('ptt', "'u' || (doc_id % 2)")} AS a, 'M.' || (1700000000 + t) || '.A.ABC' AS th FROM dc WHERE k > 0 AND (doc_id % 6 = 0 OR doc_id % 13 <> 0)), ci AS (SELECT *, sha256(concat_ws(chr(0), 'ptt-comment', th, a, signal, '03/05 10:20', {norm_sql('said')})) AS same FROM cm), cn AS (
 SELECT *, sha256(same || chr(0) || row_number() OVER (PARTITION BY t, same ORDER BY k)) AS id FROM ci)"""


@query("page.thread", f"""WITH {_BOARD} SELECT t AS page_id, 'post' AS content_type, 'M.' || (1700000000 + t) || '.A.ABC' AS id, h || ' second line' AS text, 'b' || (t % 5) AS board, 'Title & ' || t AS title, {_hmac('ptt', "'writer' || (t % 7)")} AS author_hash,
 '2024-03-05 02:00:00' AS published_at, NULL::VARCHAR AS signal, NULL::BIGINT AS floor FROM dc WHERE k = 0
 UNION ALL SELECT t, 'comment', id, said, 'b' || (t % 5), 'Title & ' || t, a, '2024-03-05 02:20:00', signal, k FROM cn""")
def thread(spark, d):
    out = pages.board_items(board_pages(spark, d), keys(spark), now())
    return out.select("page_id", "content_type", "id", "text", "board", "title", "author_hash", shown("published_at").alias("published_at"), "signal", "floor")


# ---- forum articles -----------------------------------------------------------------------
def forum_pages(spark, d):
    """Per thread: an article record twice (short and full) and comments with and without ids."""
    t = F.col("t")
    # The text as a JSON string, as a page's script holds it.
    as_json = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    at = F.lit("2024-03-05T10:00:00")
    quoted = lambda name, value: _cat(f'"{name}":"', value, '",')
    gone = lambda n: F.when(n % 9 == 0, '"isDeleted":true,').otherwise("")

    def one(s):
        n = s["doc_id"]
        no_id = F.when(n % 4 != 0, _cat('"id":"c', n, '",')).otherwise("")
        return F.concat(F.lit("{"), no_id, gone(n), F.concat(F.lit('"content":'), s["f"], F.lit(",")), quoted("author", _cat("u", n % 3)), quoted("createdAt", at), _cat('"floor":"', n % 15, '","likeCount":', n % 12, "}"))

    def again(s):
        """JSON-LD repeats every comment without its id; those that have one elsewhere must not double."""
        n = s["doc_id"]
        return F.concat(F.lit('{"@type":"Comment",'), gone(n), F.concat(F.lit('"text":'), s["f"], F.lit(",")), quoted("author", _cat("u", n % 3)), quoted("dateCreated", at), _cat('"floor":"', n % 15, '"}'))

    rows = docs(spark, d)
    # A text moves once; both records of it are made from the gathered ones.
    said = F.array_sort(F.collect_list(F.when(F.col("k") > 0, F.struct("doc_id", as_json(F.col("text")).alias("f")))))
    grouped = rows.groupBy("t").agg(said.alias("said"), F.min_by("text", "doc_id").alias("first"), F.count("*").alias("n"))
    packed = lambda f: F.array_join(F.transform("said", f), ",")
    grouped = grouped.select("t", "first", "n", packed(one).alias("full"), packed(again).alias("ld"))
    thread = t + 1000000
    full = F.concat(
        _cat('{"props":{"post":{"id":', thread, ',"likeCount":"1,2', t % 10, '0","commentCount":', F.when(t % 2 == 0, F.col("n") - 1).otherwise(F.col("n") + 5), ',"content":'),
        as_json(F.concat("first", F.lit(" full text"))), F.lit(',"comments":['), "full", F.lit("]}}}"),
    )
    ld = F.concat(_cat('[{"@type":"Article","url":"https://www.dcard.tw/f/Food/p/0', thread, '","articleBody":'), as_json(F.col("first")), F.lit(',"comment":['), "ld", F.lit("]}]"))
    markup = F.concat(
        _cat('<html><head><meta property="og:title" content="Title ', t, '"><meta property="article:published_time" content="2024-03-05T09:00:00"></head><script type="application/ld+json">'),
        ld, F.lit("</script><script>var x = 1;</script><script>"), full, F.lit("</script>"), F.when(t % 7 == 0, "<button>查看更多留言</button>").otherwise(""),
    )
    url = _cat("https://www.dcard.tw/f/Food/p/", thread, "?ref=x")
    return grouped.select(t.alias("page_id"), url.alias("url"), markup.alias("html"))


_FORUM = f"""dc AS (SELECT *, doc_id // 15 AS t, doc_id % 15 AS k, {norm_sql('text')} AS h FROM documents), pg AS (SELECT t, arg_min(h, doc_id) AS h0, count(*) AS n FROM dc GROUP BY 1), cm AS (
 SELECT t, k, doc_id, h, doc_id % 9 = 0 AS gone, CASE WHEN doc_id % 4 <> 0 THEN 'c' || doc_id ELSE sha256(concat_ws(chr(0), 'dcard-comment', CAST(t + 1000000 AS VARCHAR), k, {_hmac('dcard', "'u' || (doc_id % 3)")}, '2024-03-05 02:00:00', h)) END AS id FROM dc WHERE k > 0)"""


@query("page.embedded_json", f"""WITH {_FORUM} SELECT t AS page_id, CAST(t + 1000000 AS VARCHAR) AS thread, h0 || ' full text' AS text, 1200 + t % 10 * 10 AS reaction_count, 'https://www.dcard.tw/f/food/p/' || (t + 1000000) AS source_url FROM pg""")
def embedded_json(spark, d):
    out = pages.forum_articles(pages.forum_records(forum_pages(spark, d)))
    return out.select("page_id", "thread", "text", "reaction_count", "source_url")


@query("page.meta_fallback", f"""WITH {_FORUM} SELECT t AS page_id, 'Title ' || t AS title, '2024-03-05 01:00:00' AS published_at FROM pg""")
def meta_fallback(spark, d):
    out = pages.forum_articles(pages.forum_records(forum_pages(spark, d)))
    return out.select("page_id", "title", shown("published_at").alias("published_at"))


@query("page.record_fields", f"""WITH {_FORUM} SELECT t AS page_id, CASE WHEN ld THEN NULL WHEN doc_id % 4 <> 0 THEN 'c' || doc_id END AS record_id, text AS body, doc_id % 9 = 0 AS deleted, 'u' || (doc_id % 3) AS author, CAST(k AS VARCHAR) AS floor,
 CASE WHEN NOT ld THEN CAST(nullif(doc_id % 12, 0) AS VARCHAR) END AS likes FROM dc CROSS JOIN (VALUES (true), (false)) v(ld) WHERE k > 0""".replace("nullif(doc_id % 12, 0)", "(doc_id % 12)"))
def record_fields(spark, d):
    out = pages.forum_records(forum_pages(spark, d)).filter("kind = 'comment'")
    return out.select("page_id", "record_id", "body", "deleted", "author", "floor", "likes")


@query("page.comments_merge", f"""WITH {_FORUM} SELECT t AS page_id, CAST(t + 1000000 AS VARCHAR) AS thread, id, CAST(t + 1000000 AS VARCHAR) AS parent_source_id, h AS text, k AS floor, NOT gone AS kept FROM cm""")
def comments_merge(spark, d):
    records = pages.forum_records(forum_pages(spark, d))
    out = pages.forum_comments(records, pages.forum_articles(records), keys(spark))
    return out.select("page_id", "thread", "id", "parent_source_id", "text", "floor", "kept")


@query("page.completeness", f"""WITH {_FORUM} SELECT t AS page_id, CAST(t + 1000000 AS VARCHAR) AS thread, CASE WHEN t % 2 = 0 THEN n - 1 ELSE n + 5 END AS declared_comments, n - 1 AS loaded_comments, t % 7 <> 0 AND t % 2 = 0 AS complete FROM pg""")
def completeness(spark, d):
    records = pages.forum_records(forum_pages(spark, d))
    articles = pages.forum_articles(records)
    return pages.completeness(articles, pages.forum_comments(records, articles, keys(spark)))


# ---- map pages ----------------------------------------------------------------------------
def map_pages(spark, d):
    n = F.col("doc_id")
    card = _cat(
        '<div class="jftiEf x" data-review-id="', F.when(n % 5 == 0, "same").otherwise(_cat("rev", n)), '"><div class="d4r55"> User  ', n % 50, '</div><span class="kvMYJc" role="img" aria-label="', 1 + n % 5,
        ' 顆星"></span><span class="rsqaWe">2 週前</span><div><span class="wiI7pd">', F.col("h"), " <b>bold</b></span></div></div>",
    )
    body = page_of(docs(spark, d), card)
    return body.select(F.col("t").alias("page_id"), _cat("https://www.google.com/maps/place/p", F.col("t"), "/data=!x?hl=en").alias("url"), F.col("body").alias("html"))


@query("page.review_cards", f"""WITH c AS (SELECT doc_id, doc_id // 15 AS t, CASE WHEN doc_id % 5 = 0 THEN 'same' ELSE 'rev' || doc_id END AS key, 'User ' || (doc_id % 50) AS author, 1 + doc_id % 5 AS rating, {norm_sql('text')} || ' bold' AS text FROM documents), u AS (
 SELECT key, arg_min(struct_pack(t := t, a := author, r := rating, x := text), doc_id) AS b FROM c WHERE key NOT IN (SELECT 'rev' || vec_id FROM embeddings) GROUP BY 1)
 SELECT key, b.t AS page_id, b.a AS author, b.r AS rating, b.x AS text, '2 週前' AS relative_date, sha256(concat_ws('|', 'https://www.google.com/maps/place/p' || b.t, b.a, b.r, b.x)) AS content_hash FROM u""")
def review_cards(spark, d):
    seen = table(spark, d, "embeddings").select(_cat("rev", F.col("vec_id")).alias("key"))
    out = pages.unseen_reviews(pages.review_cards(map_pages(spark, d)), seen)
    return out.select("key", "page_id", "author", "rating", "text", "relative_date", "content_hash")


_STRIP = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"
_NAME = _STRIP.format("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")
_GUESS = f"""list_filter(list_transform(string_split(regexp_replace(html, '(?s)<[^>]+>', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND x <> nm AND NOT regexp_full_match(x, '[\\d.,() ]+')
 AND ({" OR ".join(f"contains(x, '{t}')" for t in C.ADDRESS_TOKENS)}))[1]"""


@query("page.place_meta", f"""SELECT page_id, coalesce(nullif(nm, ''), '未命名商家') AS name, regexp_replace(regexp_replace(split_part(url, '?', 1), '/data=.*$', ''), '/+$', '') AS maps_url, CASE WHEN page_id % 3 = 0 THEN page_id || ' 信義路' WHEN page_id % 3 = 1 THEN '12 Main Street'
 ELSE {_GUESS} END AS address, CASE WHEN page_id % 3 = 0 THEN 4.5::DOUBLE END AS average_rating, CASE WHEN page_id % 3 = 0 THEN 1234 + page_id END AS total_review_count FROM (SELECT *, {_NAME} AS nm FROM pages)""")
def place_meta(spark, d):
    n = F.col("page_id")
    extra = F.when(
        n % 3 == 0,
        _cat('<button data-item-id="address" aria-label="地址: ', n, ' 信義路"></button><div class="F7nice"><span aria-hidden="true">4.5</span></div><button jsaction="x.moreReviews" aria-label="', F.format_number(n + 1234, 0), ' 則評論"></button>'),
    ).when(n % 3 == 1, "<p>12 Main Street</p>").otherwise("")
    first = F.when(n % 3 == 1, F.concat(extra, "html")).otherwise(F.concat("html", extra))
    return pages.place_meta(table(spark, d, "pages").withColumn("html", first))
