"""The tokenizer: best paths against all paths, dictionaries as data, brand names, filter and ranking alike."""

import itertools
import math
import random

import pandas as pd
from pyspark.sql import functions as F

from opinionlake.functions import segment
from opinionlake.operators import keywords
from opinionlake.operators import scope as S
from opinionlake.session import scratch


def all_paths(piece):
    for cuts in itertools.product([0, 1], repeat=len(piece) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(piece)]
        yield [piece[a:b] for a, b in zip([0, *ends], ends)]


def test_best_path_is_the_best_of_all_paths():
    rng = random.Random(3)
    for _ in range(60):
        words = {"".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(12)}
        held = segment.Words(words.items())
        piece = "".join(rng.choice("甲乙丙丁戊") for _ in range(9))
        weight = lambda p: math.log(words[p] / held.total) if p in words else -math.log(held.total)
        allowed = [p for p in all_paths(piece) if all(w in words or len(w) == 1 for w in p)]
        best = max(sum(map(weight, p)) for p in allowed)
        found, parts = held.path(piece)
        assert "".join(p for p, _ in parts) == piece and math.isclose(found, best) and math.isclose(sum(weight(p) for p, _ in parts), best)


def test_counts_decide_between_overlapping_words(spark):
    texts = spark.createDataFrame([("研究生命起源",), ("T恤好看 卡拉OK",), ("三百 3 ok",), ("",), (None,)], "t string")
    words = lambda n: spark.createDataFrame([("研究", 500), ("研究生", n), ("生命", 400), ("命", 30), ("起源", 90), ("T恤", 9), ("卡拉ok", 9), ("ascii", 9), ("起源", 0)], "word string, freq int")
    few, many = (segment.write_dictionary(words(n), scratch(spark, "words")) for n in (3, 10**6))
    assert few.version != many.version and few.version.startswith(segment.C.TOKENIZER_VERSION)
    cut = lambda t: [r[0] for r in texts.select(t.tokens(F.lower("t"))).collect()]
    assert cut(few) == [["研究", "生命", "起源"], ["t恤", "卡拉ok"], ["ok"], [], None]
    assert cut(many)[0] == ["研究生", "起源"]
    assert sorted(r["word"] for r in spark.read.parquet(few.dictionary).collect()) == sorted(["研究", "研究生", "生命", "命", "起源", "t恤", "卡拉ok"])


def test_added_words_win_over_their_parts():
    words = segment.Words([("春水", 900), ("水堂", 900), ("春", 50), ("堂", 50)]).add(["春水堂"])
    assert words.path("春水堂")[1] == [("春水堂", True)]
    assert segment.Words(base=words).add(["大春水堂"]).path("去大春水堂")[1] == [("去", False), ("大春水堂", True)]


def test_filter_and_ranking_use_one_tokenizer_with_the_reports_brands(spark):
    rows = [("r1", "1", "我在阿宗-二店等候 Green Tea"), ("r1", "2", "阿宗麵線好吃"), ("r2", "3", "阿宗麵線好吃 green tea"), ("r3", "4", "green tea")]
    items = spark.createDataFrame(rows, "report_id string, id string, text string").withColumns({"title": F.lit(None).cast("string"), "published_at": F.lit(None).cast("timestamp"), "date_precision": F.lit("unknown")})
    brands = spark.createDataFrame([("r1", ["ＧREEN TEA", "阿宗-二店", "阿宗麵線"]), ("r3", ["ｇreen TEA"])], "report_id string, brand_terms array<string>")
    named = keywords.with_brands(items, brands)
    got = {r["id"]: r["tokens"] for r in keywords.with_tokens(named).collect()}
    assert got == {"1": ["我在", "阿宗-二店", "等候", "green tea"], "2": ["阿宗麵線", "好吃"], "3": ["阿宗麵線", "好吃", "green", "tea"], "4": ["green tea"]}
    for keyword, ids in {"阿宗-二店": ["1"], "green tea": ["1", "4"], "好吃": ["2", "3"], "tea": ["3"]}.items():
        assert sorted(r["id"] for r in S.select(named, S.Scope(keyword=keyword)).collect()) == ids
        assert ids == sorted(i for i, t in got.items() if keyword in t)


def test_another_tokenizer_can_take_its_place(spark):
    def by_comma(bodies: pd.Series, brands: pd.Series) -> pd.Series:
        return bodies.str.split(",")

    mine = segment.Tokenizer(version="commas", cut=by_comma)
    items = spark.createDataFrame([("1", "a b,c d,the")], "id string, text string").withColumn("title", F.lit(None).cast("string"))
    assert [t.strip() for t in keywords.with_tokens(items, mine).first()["tokens"]] == ["a b", "c d"]
