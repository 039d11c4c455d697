"""The registered query of each operator, with the SQL that checks it where SQL can express it."""

from __future__ import annotations

import functools
import os
from pathlib import Path

from pyspark.sql import functions as F

from opinionlake.llm import bpe_stream, chat_format, decontaminate, license_scan, mixing, prefix_trie, quality_rules, ranked_search, secret_scan, simhash, token_output, url_filter, warc
from opinionlake.llm.common import written

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def register(function):
        @functools.wraps(function)
        def run(spark, sf_dir):
            prepare(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def prepare(spark) -> None:
    """UTC; batches of few texts for Python, as texts may be long; workers find the package whatever their working directory is."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (root, known) if p)


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_entropy_balanced_mixing")
def op1(spark, sf_dir):
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", "taken", "copies")


def _url_sql() -> str:
    def walk(name, a, b, seed):
        steps = [f"{name}_0 AS MATERIALIZED (SELECT host, floor({seed}::DOUBLE * {1 - url_filter.DAMPING!r}) AS own, floor({seed}::DOUBLE * {1 - url_filter.DAMPING!r}) AS score FROM hosts WHERE {seed} > 0)",
                 f"{name}_w AS MATERIALIZED (SELECT {a} AS a, {b} AS b, n, sum(n) OVER (PARTITION BY {a}) AS s FROM graph)"]
        for k in range(url_filter.ROUNDS):
            steps.append(
                f"{name}_{k + 1} AS MATERIALIZED (SELECT host, sum(p)::HUGEINT::DOUBLE AS score FROM (SELECT host, own::HUGEINT AS p FROM {name}_0 UNION ALL "
                f"SELECT b, floor(score * {url_filter.DAMPING} * n / s)::HUGEINT FROM {name}_w JOIN {name}_{k} ON host = a) GROUP BY host)"
            )
        return ", ".join(steps)

    rules = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for r, v in url_filter.RULES)
    link = url_filter._LINK.replace("'", "''")
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    last = url_filter.ROUNDS
    return f"""
WITH u AS MATERIALIZED (SELECT page_id, coalesce(html, '') AS html, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{up}', '{low}') AS host,
                  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rhost, rpath, rule, v) AS (VALUES {rules}),
f AS (SELECT host, path, arg_max(rule, [length(rule), v = 'block']) AS rule, arg_max(v, [length(rule), v = 'block']) AS v
      FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
j AS MATERIALIZED (SELECT page_id, u.host, u.path, rule, v FROM u LEFT JOIN f USING (host, path)),
graph AS MATERIALIZED (SELECT a, b, count(*) AS n FROM (
        SELECT host AS a, translate(b, '{up}', '{low}') AS b FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS b FROM u)
        UNION ALL SELECT host, regexp_extract(host, '^[^.]*[.](.+)$', 1) FROM u) WHERE a <> '' AND b <> '' AND a <> b GROUP BY ALL),
hosts AS MATERIALIZED (SELECT host, {url_filter.MASS} * count(*) FILTER (v = 'allow') // count(*) AS good, {url_filter.MASS} * count(*) FILTER (v = 'block') // count(*) AS bad
          FROM j WHERE host <> '' GROUP BY host),
{walk('t', 'a', 'b', 'good')}, {walk('d', 'b', 'a', 'bad')},
s AS (SELECT host, coalesce(t.score, 0)::BIGINT AS trust, coalesce(d.score, 0)::BIGINT AS distrust FROM hosts LEFT JOIN t_{last} t USING (host) LEFT JOIN d_{last} d USING (host))
SELECT page_id, j.host, path, rule, coalesce(v, CASE WHEN distrust >= {url_filter.THRESHOLD} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM j LEFT JOIN s USING (host)
"""


@query("op2_url_filters", _url_sql())
def op2(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query("op3_simhash_near_dedup")
def op3(spark, sf_dir):
    return simhash.assign(table(spark, sf_dir, "documents"))


@query("op4_license_scans")
def op4(spark, sf_dir):
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    places = F.transform(base, lambda s: s["word"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), "score",
    )


@query("op5_token_id_output")
def op5(spark, sf_dir):
    return token_output.read(token_output.write(table(spark, sf_dir, "documents"), tokenizer_path()))


@query("op6_chat_formatting")
def op6(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{text}'), (-7L, 1L, 'assistant', '{text}') AS t(conv_id, turn, role, text)")
    return chat_format.digests(chat_format.format_chats(rows.unionAll(more), tokenizer=tokenizer_path()))


@query("op7_warc")
def op7(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op8_benchmark_decontamination", r"""
WITH d AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
           FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
b AS (SELECT item_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
      FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)),
m AS (SELECT doc_id, item_id, count(*) AS n_shared
      FROM (SELECT doc_id, unnest(s) AS x FROM d) JOIN (SELECT item_id, unnest(s) AS x FROM b) USING (x) GROUP BY ALL)
SELECT doc_id, item_id, len(s)::BIGINT AS n_item, n_shared, round(n_shared / len(s), 6) AS containment
FROM m JOIN b USING (item_id) WHERE n_shared >= len(s) * 0.8
""")
def op8(spark, sf_dir):
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _secret_sql() -> str:
    """Brute force: every window of every candidate is counted anew."""
    table_ = "[" + ", ".join(map(str, secret_scan.clog())) + "]"
    window, full = secret_scan.WINDOW, secret_scan.clog()[-1]

    def starts(found, gaps):
        return f"list_transform(range(1, len({found}) + 1), lambda i: list_sum(list_transform({gaps}[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform({found}[1:i-1], lambda g: length(g))), 0))"

    parts = []
    for i, (kind, pattern, group, least) in enumerate(secret_scan.BASE):
        p = pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {i} AS o, '{kind}' AS kind, s, s + length(m) AS e FROM (SELECT doc_id, unnest(f) AS m, unnest(g) AS g, unnest({starts('f', 'gap')}) AS s FROM "
            f"(SELECT doc_id, regexp_extract_all(t, '{p}') AS f, regexp_extract_all(t, '{p}', {group}) AS g, string_split_regex(t, '{p}') AS gap FROM d)) WHERE length(g) >= {least}"
        )
    for i, c in enumerate(secret_scan.CLASSES, len(secret_scan.BASE)):
        needs = "".join(f" AND regexp_matches(m, '{n}')" for n in c.needs)
        listed = " OR ".join(f"contains(lower(p), '{w}')" for w in secret_scan.ALLOW)
        kept = f"string_split(array_to_string(list_transform(string_split(m, '/'), lambda p: CASE WHEN {listed} THEN ' ' ELSE p END), '/'), ' ')"
        sums = f"list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: ({table_})[length(v) - length(replace(v, c, '')) + 1]))"
        parts.append(
            f"SELECT doc_id, {i} AS o, '{c.kind}' AS kind, s, s + length(m) AS e FROM (SELECT doc_id, unnest(f) AS m, unnest({starts('f', 'gap')}) AS s FROM "
            f"(SELECT doc_id, regexp_extract_all(t, '{c.pattern}') AS f, string_split_regex(t, '{c.pattern}') AS gap FROM d)) WHERE true{needs} AND "
            f"list_max(list_transform(flatten(list_transform({kept}, lambda k: list_transform(range(1, length(k) - {window - 2}), lambda j: k[j:j+{window - 1}]))), lambda v: {full} - {sums})) >= {round(window * c.min_bits * 1e6)}"
        )
    joined = "coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, o){}, '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS ({' UNION ALL '.join(parts)})
SELECT d.doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
       sha256({joined.format(' FILTER (o < 3)')}) AS base_sha256, {joined.format('')} AS spans
FROM d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id
"""


@query("op9_secret_scans", _secret_sql())
def op9(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["order"] == k)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.listed(F.filter(spans, lambda s: s["order"] < len(secret_scan.BASE))), 256).alias("base_sha256"),
        secret_scan.listed(spans).alias("spans"),
    )


QUALITY_SQL = r"""
WITH t AS (SELECT *, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
s AS (SELECT *, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [] END AS s FROM w),
r AS (SELECT doc_id, p FROM (SELECT doc_id, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS p FROM s) QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
c AS (SELECT doc_id, sum(least(5, coalesce(nxt - p, 5)))::BIGINT AS c FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM r) GROUP BY doc_id),
m AS (SELECT s.doc_id, lang, source, text, n_chars, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(c, 0)::BIGINT AS n_repeat_words FROM s LEFT JOIN c ON c.doc_id = s.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words > 0 AND 100 * n_symbols > 10 * n_words AS f1,
             100 * n_dup_lines > 30 * n_lines AS f2, n_words > 0 AND NOT word_chars BETWEEN 3 * n_words AND 12 * n_words AS f3 FROM m),
h AS (SELECT source, r, count(*) AS n, count(*) FILTER (v) AS k
      FROM (SELECT source, unnest([1, 2, 3]) AS r, unnest([f1, f2, f3]) AS v FROM f) GROUP BY ALL),
g AS (SELECT r, sum(n) AS a, sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) AS q, count(*) AS hosts FROM h GROUP BY r),
e AS (SELECT *, mean * (1 - mean) AS sp, q - mean * mean - mean * (1 - mean) * hosts / a AS bt FROM g),
v AS (SELECT source, bool_or(round((k + st * mean) / (n + st), 9) > 0.5) AS bad
      FROM (SELECT h.*, e.mean, CASE WHEN sp > 0 AND bt > sp * 1e-6 THEN greatest(sp / bt - 1, 10.0) ELSE 1e6 END AS st FROM h JOIN e USING (r)) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (bad AND n_soft > 0) AS kept, n_soft, bad AS host_bad
FROM (SELECT *, (f1::INT + f2::INT + f3::INT)::BIGINT AS n_soft FROM f) x JOIN v ON v.source IS NOT DISTINCT FROM x.source
"""


@query("op10_quality_rules", QUALITY_SQL)
def op10(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])


def rebuilt(rows):
    """Turns (conv, depth, role, text) and conversations (conv) of op11: up to 8 first turns of conversation c - c % 5, then c's own from there on."""
    turns = written(prefix_trie.ordered(rows), "ordered")
    counts = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("_n"))
    convs = counts.select("conv", (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).alias("_h"), (F.col("conv") - F.col("conv") % 5).alias("_base"))
    of_base = counts.select(F.col("conv").alias("_b"), F.col("_n").alias("_m"))
    plan = written(convs.join(of_base, F.col("_base") == F.col("_b"), "left").select("conv", "_h", "_base", F.coalesce("_m", F.lit(0)).alias("_m")), "plan")
    heads = turns.filter(F.col("depth") <= 8).withColumnRenamed("conv", "_b").join(plan, (F.col("_b") == F.col("_base")) & (F.col("depth") <= F.col("_h")))
    own = turns.join(plan.withColumnRenamed("conv", "_c"), F.col("conv") == F.col("_c")).filter(F.col("depth") > F.col("_h"))
    own = own.withColumn("depth", F.least("_h", "_m") + F.col("depth") - F.col("_h"))
    names = ["conv", F.col("depth").cast("bigint").alias("depth"), "role", "text"]
    return heads.select(*names).unionByName(own.select(*names)), plan.select("conv")


_TRIE_SQL = """
WITH o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS p, {'role': role, 'text': text} AS t
           FROM (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
step AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS step),
k AS (SELECT c, n, c - c % 5 AS b, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
             lambda x, y: xor(x >> 8, step[(xor(x, y) & 255) + 1])), 4294967295) % 9 AS h FROM (SELECT c, count(*) AS n FROM o GROUP BY c), step),
m AS (SELECT k.*, coalesce(b.n, 0) AS m FROM k LEFT JOIN (SELECT c AS bc, n FROM k) b ON b.bc = k.b),
r AS (SELECT m.c, p AS d, t FROM m JOIN o ON o.c = m.b AND p <= h UNION ALL SELECT m.c, least(h, m) + p - h, t FROM m JOIN o ON o.c = m.c AND p > h),
w AS (SELECT c, d, list(t) OVER (PARTITION BY c ORDER BY d) AS path FROM r UNION ALL SELECT c, 0, [] FROM m),
l AS (SELECT c, max(d) AS l FROM w GROUP BY c),
n AS MATERIALIZED (SELECT path, d, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = l), '')) AS ends FROM w JOIN l USING (c) GROUP BY path, d),
ch AS (SELECT path[1:d-1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n - 1) * strlen(path[d].text) ELSE 0 END AS saved FROM n LEFT JOIN ch USING (path)),
s AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT path[1:unnest(range(0, d + 1))] AS path, n_children, saved FROM f) GROUP BY path)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, u.c AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, saved_tokens, f.ends AS ends_sha256
FROM f JOIN s USING (path) LEFT JOIN n u ON f.d > 0 AND u.path = f.path[1:f.d-1]
"""


@query("op11_prefix_trie", _TRIE_SQL)
def op11(spark, sf_dir):
    return prefix_trie.trie(*rebuilt(table(spark, sf_dir, "conversations")))


@query("op12_bpe_round_trip")
def op12(spark, sf_dir):
    path = tokenizer_path("word_bpe_49k.json")
    decoded = bpe_stream.decode(bpe_stream.encode(table(spark, sf_dir, "documents"), path), path)
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return decoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


_RANKED_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(w) AS t FROM b) GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(w) > 0) AS big_n, sum(len(w))::BIGINT AS big_l FROM d),
p AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY t, big_n),
m AS (SELECT doc_id, 75 + (25 * len(w)::BIGINT * big_n) // big_l AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN f USING (t) JOIN p USING (t) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""


@query("op13_ranked_search", _RANKED_SQL)
def op13(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
