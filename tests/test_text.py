from pyspark.sql import functions as F

from lexigraph.functions import text as T
from lexigraph.functions.arrays import explode_counts


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr("t").alias("r")).first()["r"]


def test_word_tokeniser_matches_word_boundary_rule(spark):
    s = "café abc1 b2b don't foo_bar Über x résumé naïve end"
    assert one(spark, T.tokens_words, s) == ["don", "end"]


def test_normalised_tokeniser_strips_accents_and_digits(spark):
    s = "Über café naïve résumé abc1def x_y _under ab ÇA veryveryverylongword"
    assert one(spark, T.tokens_normalised, s) == ["uber", "cafe", "naive", "resume", "abc", "def", "x_y"]


def test_lexicon_tokeniser_keeps_single_letters(spark):
    assert one(spark, T.tokens_lexicon, "Fire, fire! Safe exit a b2b") == ["fire", "fire", "safe", "exit", "a"]


def test_python_whitespace_split_and_strip(spark):
    s = "  one two\tthree\n four 　"
    assert one(spark, T.word_count, s) == 4
    assert one(spark, T.strip_ws, s) == "one two\tthree\n four"


def test_previews(spark):
    s = "line one\n<b>" + "x" * 100
    assert one(spark, T.preview_hover, s) == ("line one &lt;b>" + "x" * 68 + "...")
    assert one(spark, T.preview_export, "a\nb") == "a b"


def test_ngrams_after_stop_removal(spark):
    df = spark.createDataFrame([(["a", "the", "b", "c"],)], "t array<string>")
    r = df.select(T.ngrams_1_2(T.remove_words("t", ["the"])).alias("g")).first()["g"]
    assert r == ["a", "b", "c", "a b", "b c"]
    empty = spark.createDataFrame([([],), (["x"],)], "t array<string>")
    assert [x["g"] for x in empty.select(T.ngrams_1_2("t").alias("g")).collect()] == [[], ["x"]]


def test_value_counts_in_row(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "c", "b"]), (2, [])], "d long, t array<string>")
    rows = sorted((r["d"], r["term"], r["tf"]) for r in explode_counts(df, "t", ["d"]).collect())
    assert rows == [(1, "a", 1), (1, "b", 3), (1, "c", 1)]


def test_series_rules(spark):
    from lexigraph.functions import fixed
    df = spark.createDataFrame([("TBUK_1.txt",), ("VF:x",), ("VF_NEW_2",), ("TWA",), ("other",)], "s string")
    got = [r[0] for r in df.select(T.series_of("s", fixed.SERIES_PREFIXES, fixed.DEFAULT_SERIES)).collect()]
    assert got == ["TBUK", "VF_NEW", "VF_NEW", "TWA", "WESA"]
