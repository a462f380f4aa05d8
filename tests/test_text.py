import math
import random
import re

import pytest
from pyspark.sql import functions as F

from rawharbor.functions import matching, text


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r["o"] for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


NAMES = ["Retail Sales 2024!!", "  a  b ", "", "Élan/vital_x-1", "日本 data", "a\tb\nc", "--__", "½ cup²", "UPPER.CSV"]


def test_slug_and_stem(spark):
    slugs = ["retail_sales_2024_", "_a_b_", "", "_lan_vital_x-1", "_data", "a_b_c", "--__", "_cup_", "upper_csv"]
    assert apply(spark, text.topic_slug, NAMES) == slugs
    stems = ["retail_sales_2024", "a__b", "", "élanvital_x-1", "日本_data", "abc", "--__", "½_cup²", "uppercsv"]
    assert apply(spark, text.safe_stem, NAMES) == stems
    assert apply(spark, text.raw_file_name, NAMES) == [s + "_raw.csv" for s in stems]


def test_host_key(spark):
    values = ["HTTPS://WWW.Example.com/a/b", "openml", "http://a<b>:c|d?e* f/x", "www.www.x", r"a\b"]
    assert apply(spark, text.host_key, values) == ["example.com", "openml", "a_b_c_d_e_f", "www.x", r"a\b"]


def test_zero_pad_like_zfill(spark):
    values = ["320193", "12345678901", "", "-42", "+7", "0"]
    assert apply(spark, text.zero_pad, values) == [v.zfill(10) for v in values]


def test_dataset_name(spark):
    values = ["/a/b/sales_raw.csv", "x.tar.gz", ".hidden", "..a.b", "no_ext_raw_raw", "/p/_raw.csv", "a.", "d.x/y"]
    assert apply(spark, text.dataset_name, values) == ["sales", "x.tar", ".hidden", "..a", "no_ext", "", "a", "y"]


def test_sheet_name_counts_characters(spark):
    assert apply(spark, text.sheet_name, ["a" * 40, "é" * 40, "short"]) == ["a" * 31, "é" * 31, "short"]


def test_list_and_topic(spark):
    assert apply(spark, text.parse_list, [" Kaggle, SEC ", "all", "a,,b"]) == [["kaggle", "sec"], ["all"], ["a", "", "b"]]
    assert apply(spark, text.default_topic, ["  ", None, " gdp "]) == ["finance", "finance", "gdp"]


def test_strip_takes_every_blank(spark):
    values = [f"{chr(c)}a{chr(c)} b{chr(c)}{chr(c)}" for c in [*range(0x300), *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x3000, 0xFEFF]]
    assert apply(spark, text.strip, values) == [v.strip() for v in values]


def test_row_limit(spark):
    values = [" Y ", "yes", "n", "NO", "500", "007", "-1", "1.5", "", "9" * 30]
    got = [tuple(r) for r in apply(spark, text.row_limit, values)]
    assert got == [
        ("all", 0), ("all", 0), ("abort", None), ("abort", None), ("limit", 500), ("limit", 7),
        ("invalid", None), ("invalid", None), ("invalid", None), ("limit", 2**63 - 1),
    ]


def test_identity_size_percent(spark):
    assert apply(spark, lambda c: text.agent_identity(c, "app"), ["me@x.org", "k1"]) == ["me@x.org", "app/1.0 (k1)"]
    assert apply(spark, lambda c: text.size_text(c, c * 2), [150.0, None], "double") == ["150 rows, 300 columns", None]
    assert apply(spark, text.percent_text, [0.9, 0.66666, None, 1.0], "double") == ["90.00%", "66.67%", None, "100.00%"]


def test_percent_rounds_the_exact_value(spark):
    rng = random.Random(1)
    values = [n / d for d in (7, 8, 16, 32, 64, 200, 2000, 20000) for n in range(0, 3 * d // 2, max(1, d // 60))]
    values += [rng.random() for _ in range(5000)] + [rng.uniform(-5, 5000) for _ in range(2000)]
    values += [29 / 32, 0.00125, 0.00375, 0.99999, 1e-12, -1e-9, 1e15, 123456789.125, float("inf"), float("-inf")]
    assert apply(spark, text.percent_text, values, "double") == [f"{v:.2%}" for v in values]
    assert apply(spark, text.percent_text, [float("nan")], "double") == ["nan%"]


FLOATS = [0.0, -0.0, 1.0, 0.1, 1.5e7, 12345678.9, 1e15, 9999999999999998.0, 1e16, 1.5e16, -2.5e20, 1e22, 0.001, 0.0001,
          0.00012345, 1e-5, -1.25e-7, 1e100, 1.7976931348623157e308, math.inf, -math.inf, math.nan]


def test_float_text_like_python(spark):
    assert apply(spark, text.float_text, FLOATS, "double") == [str(v) for v in FLOATS]


@pytest.mark.parametrize("pattern", ["iris", "^WINE", "", "a.c", "(x|ß)$", "STRASSE", "k"])
def test_regex_match_like_python(spark, pattern):
    names = ["Iris", "wine", "red WINE", "abc", "AxC", "ß", "straße", "K", None]
    expected = [n is not None and re.search(pattern, n, re.IGNORECASE) is not None for n in names]
    assert apply(spark, lambda c: matching.regex_match(c, pattern), names) == expected


def test_folded_contains_equals_regex(spark):
    names = ["İstanbul", "ısı", "maſs", "Kelvin", "ABC", "straße"]
    for query in ("i", "S", "k", "ABC", "ß"):
        folded = apply(spark, lambda c, q=query: F.contains(matching.fold(c), matching.fold(F.lit(q))), names)
        assert folded == apply(spark, lambda c, q=query: matching.regex_match(c, q), names)


def test_fold_is_what_a_regex_compares(spark):
    """Every letter against its fold, and the folds of all letters against each other."""
    letters = [chr(c) for c in range(0x80, 0x1E944) if chr(c).lower() != chr(c).upper() and not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, matching.simple_fold(c)) for c in letters], "c string, f string")
    asked = df.select("c", "f", matching.fold(F.col("c")).alias("folded"), F.rlike("c", F.concat(F.lit("(?iu)^"), "f", F.lit("$"))).alias("same"))
    wrong = asked.where((F.col("folded") != F.col("f")) | ~F.col("same"))
    # Letters that the newer of two Unicode tables pairs and the older does not know may differ.
    assert wrong.count() <= 60
    assert wrong.where("c < '\u0530'").count() == 0
    words = [("οδοσ", "ΟΔΟΣ data"), ("μm", "5 µm grid"), ("SS", "ſs"), ("k", "\u212a")]
    pairs = spark.createDataFrame(words, "q string, n string")
    both = pairs.select(F.contains(matching.fold(F.col("n")), matching.fold(F.col("q"))).alias("a"), matching.regex_match(F.col("n"), F.col("q")).alias("b"))
    assert all(r["a"] and r["b"] for r in both.collect())


def test_unrelated_topic(spark):
    assert apply(spark, matching.unrelated_topic, ["Board GAMES", "bonds", "anime"]) == [True, False, True]
