import datetime as dt
import hashlib
import hmac
import unicodedata

from pyspark.sql import functions as F

from opinionlake.functions import dates, identity, segment, text, values


def one(spark, column, *rows, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_normalize_matches_python(spark):
    samples = ["ＡＢＣ　１２３", " a​b \n c ", "ﬁne ①", "plain", "", "éclair", "\x1cx\x1f", None]
    got = one(spark, text.normalize(F.col("v")), *samples)
    want = [" ".join(unicodedata.normalize("NFKC", s or "").replace("​", "").split()) for s in samples]
    assert got == want


def test_fold_matches_python(spark):
    samples = ["Straße", "ΣΑΣ", "İstanbul", "ＦＵＬＬ", "naïve É", "麵包", "ﬃ"]
    assert one(spark, text.fold(F.col("v")), *samples) == [unicodedata.normalize("NFKC", s).casefold() for s in samples]


def test_masks_in_order(spark):
    samples = {
        "請寄 a.b+c@mail.example.com 或 https://x.y/z?q=1 謝謝": "請寄 [電子郵件已遮罩] 或 [網址已遮罩] 謝謝",
        "電話 0912-345-678 或 +886 912345678": "電話 [電話已遮罩] 或 [電話已遮罩]",
        "找 @some_one 訂單 1234567890123": "找 [帳號已遮罩] 訂單 [識別碼已遮罩]",
        "x@y 12345": "x@y 12345",
    }
    assert one(spark, text.redact(F.col("v")), *samples) == list(samples.values())
    df = spark.createDataFrame([(s,) for s in samples], "v string")
    staged = text.add_masked(df, "v", counts="c").collect()
    assert [r["v"] for r in staged] == list(samples.values())
    assert [sum(r["c"]) for r in staged] == [2, 2, 2, 0]


def test_relative_dates(spark):
    now = dt.datetime(2026, 8, 1, 12)
    cases = {
        "2 週前": (14 * 24 * 60, "week"), "a month ago": (30 * 24 * 60, "month"), "3 years ago": (3 * 365 * 24 * 60, "year"),
        "5 天前（已編輯）": (5 * 24 * 60, "day"), "剛剛": (0, "day"), "幾分鐘前": (2, "day"), "一個月前": (30 * 24 * 60, "month"), "someday": (None, "unknown"),
    }
    got = one(spark, dates.relative(F.col("v"), F.lit(now)), *cases)
    for (minutes, precision), row in zip(cases.values(), got):
        assert row["precision"] == precision
        assert row["at"] == (None if minutes is None else now - dt.timedelta(minutes=minutes))


def test_absolute_dates(spark):
    cases = {
        "2026-08-02T16:00:00+00:00": dt.datetime(2026, 8, 2, 16), "2026-08-02T16:00:00": dt.datetime(2026, 8, 2, 8), "2026-08-02": dt.datetime(2026, 8, 1, 16),
        "Sun, 02 Aug 2026 16:00:00 +0800": dt.datetime(2026, 8, 2, 8), "Sun Aug  2 16:00:00 2026": dt.datetime(2026, 8, 2, 8), "2026-13-40": None, "": None,
    }
    assert one(spark, dates.absolute(F.col("v"), "+08:00"), *cases) == list(cases.values())


def test_local_day_crosses_midnight(spark):
    at = dt.datetime(2026, 8, 2, 16)
    day = spark.createDataFrame([(at,)], "t timestamp").select(dates.local_day(F.col("t"))).first()[0]
    assert day == dt.date(2026, 8, 3)


def test_author_hash_is_hmac_and_key_stays_out_of_the_plan(spark):
    key = bytes(range(40))
    df = spark.createDataFrame([("ptt", " Ａlice  x "), ("ptt", "  "), ("ptt", None)], "s string, a string")
    out = df.select(identity.author_hash(identity.key_frame(spark, key), F.col("s"), F.col("a")).alias("h"))
    assert [r["h"] for r in out.collect()] == [hmac.new(key, "ptt\0Alice x".encode(), hashlib.sha256).hexdigest(), None, None]
    plan = out._jdf.queryExecution().toString()
    assert bytes(b ^ 0x36 for b in key).hex() not in plan.lower()


def test_article_urls(spark):
    cases = {
        "https://www.dcard.tw/f/Food/p/00123?utm_source=x": ("https://www.dcard.tw/f/food/p/123", None), "https://WWW.dcard.tw:443/f/a_b/p/7/": ("https://www.dcard.tw/f/a_b/p/7", None),
        "http://www.dcard.tw/f/a/p/7": (None, "not_a_public_article"), "https://u@www.dcard.tw/f/a/p/7": (None, "not_a_public_article"),
        "https://www.dcard.tw/f/a/p/7?page=2": (None, "unknown_query_field"), "https://www.dcard.tw/f/a/p/x": (None, "not_a_public_article"),
    }
    got = one(spark, identity.canonical_article(F.col("v")), *cases)
    assert [(r["url"], r["reason"]) for r in got] == list(cases.values())


def test_numbers_and_tokens(spark):
    assert one(spark, values.counter(F.col("v")), "1,234", "x", "", "1234567890123") == [1234, None, None, None]
    assert one(spark, values.first_int(F.col("v")), "共 1,234 則", None, "無") == [1234, None, None]
    tokens = one(spark, F.array_join(segment.DEFAULT.tokens(text.fold(F.col("v"))), " "), "珍珠奶茶好吃 The SERVICE 服務員 123 a", "燙青菜牛肉麵", "Élan vital, наука")
    assert tokens == ["珍珠奶茶 好吃 service 服務員", "燙青菜 牛肉麵", "élan vital наука"]


def test_brand_tokens(spark):
    from opinionlake.operators import keywords

    items = spark.createDataFrame([("r1", "1", "", "Green Tea 鼎泰豐二店好吃 evergreen teas C++ x"), ("r2", "2", "", "green tea")], "report_id string, id string, title string, text string")
    brands = spark.createDataFrame([("r1", ["green tea", "鼎泰豐二店", "c++ x"])], "report_id string, brand_terms array<string>")
    got = {r["id"]: r["tokens"] for r in keywords.with_brand_tokens(items, brands).collect()}
    assert got == {"1": ["green tea", "鼎泰豐二店", "好吃", "evergreen", "teas", "c++ x"], "2": ["green", "tea"]}


def test_subject_keys_casefold_all_letters(spark):
    names = ["Straße", "ΣΊΣΥΦΟΣ ς", "ﬁsh", "Ｆull", "İstanbul", "ŉ", "MÜLLER", "", "  A b "]
    got = one(spark, identity.subject_key(F.lit("business"), F.col("v"), F.lit(None).cast("string")), *names)
    assert got == [hashlib.sha256("|".join(p.strip().casefold() for p in ("business", n, "")).encode()).hexdigest() for n in names]
