import unicodedata

from pyspark.sql import functions as F

from opinionlake.functions import text
from opinionlake.operators import labelling


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fallback_count_normalises_each_text_once(spark):
    rows = [("r0", str(i), "ptt", "comment", t, 5, "push") for i, t in enumerate(["讚 great", "bad", "推", "  ", "", None, "Ｆｉｎｅ"])]
    items = spark.createDataFrame(rows, "report_id string, id string, source string, content_type string, text string, rating bigint, signal string")
    counted = labelling.fallback_count(labelling.label_items(items), items)
    assert plan_of(counted).count("ArrowEvalPython") == 1
    # "bad", "推" and "  " are short voted comments or blank; a blank text still names the word list.
    assert [tuple(r) for r in counted.collect()] == [("r0", labelled(labelling.label_items(items)))]
    assert labelling.fallback_count(labelling.label_items(items.filter("text = '推'")), items).count() == 0


def labelled(labels):
    return labels.filter(F.col("local_model_id").startswith(labelling.C.LEXICON_MODEL)).filter("id not in ('4', '5')").count()


def test_blanks_and_stable_characters_are_those_of_the_definition(spark):
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    frame = spark.createDataFrame([(chr(c),) for c in points], "c string")
    got = {r["c"]: r for r in frame.select("c", text.is_blank(F.col("c")).alias("blank"), text.normalize(F.concat(F.lit("a "), "c", F.lit("  b"))).alias("n")).collect()}
    for c in map(chr, points):
        # The JVM's white space is the separators of Unicode, TAB to CR and NEL; 1C to 1F count too.
        blank = unicodedata.category(c) in ("Zs", "Zl", "Zp") or "\t" <= c <= "\r" or "\x1c" <= c <= "\x1f" or c == "\x85"
        assert got[c]["blank"] == blank, hex(ord(c))
        if blank:
            assert got[c]["n"] == "a b", hex(ord(c))


def test_tests_for_unstable_characters_skip_stable_runs(spark):
    pattern = text._compat_class()
    texts = ["stable " * 50, "一二三" * 50, "Ｆ", "a" * 100 + "ﬁ", "é", "é", "😀"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").rlike(pattern)).collect()]
    assert got == [False, False, True, True, False, True, True]
    assert pattern.startswith(r"(?s)\A(?:[\x{0}-\x{9f}]++|")
