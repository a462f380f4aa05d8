import math
import random
import re

import pytest
from pyspark.sql import functions as F

from rawharbor.functions import literals, nulls
from rawharbor.operators import align, compare, history, joins, profile, quality, ranking, resolve

NAN = math.nan


def verdict(df, **kwargs):
    return quality.assess(quality.null_counts(df), **kwargs).first()


@pytest.mark.parametrize(
    "rows, status, message",
    [
        ([(1.0, 3.0), (2.0, 4.0)], "passed", None),
        ([(NAN, NAN)] * 4 + [(1.0, None)], "rejected", "null density exceeds 80% (90.00%)"),
        ([(1.0, None), (None, NAN), (2.0, None), (None, None), (None, None)], "passed", None),  # exactly 0.8
        ([], "empty", "dataset is completely empty"),
        ([(1.0, None), (None, None), (None, None)], "rejected", "null density exceeds 80% (83.33%)"),
    ],
)
def test_gate(spark, rows, status, message):
    got = verdict(spark.createDataFrame(rows, "a double, b double"))
    assert (got["status"], got["message"]) == (status, message)


def test_two_thirds_missing_passes(spark):
    assert verdict(spark.createDataFrame([(1.0,), (NAN,), (NAN,)], "a double"))["status"] == "passed"


def test_gate_of_no_columns(spark):
    assert verdict(spark.range(3).select())["status"] == "empty"


def test_gate_per_dataset_reports_expected_but_absent(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", None, None), ("b", None, None)], "d string, x int, y int")
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "d string")
    got = {r["d"]: (r["status"], r["rows"], r["nulls"]) for r in quality.gate(df, ["d"], expected=expected).collect()}
    assert got == {"a": ("passed", 1, 1), "b": ("rejected", 2, 4), "c": ("empty", 0, 0)}
    verdicts = quality.gate(df, ["d"], expected=expected)
    assert [tuple(r) for r in quality.keep_passed(df, verdicts, ["d"]).collect()] == [("a", 1, None)]
    assert tuple(quality.outcome(verdicts).first()) == (3, 1, 1, 1)
    assert quality.require_success(verdicts) == 1
    with pytest.raises(ValueError):
        quality.require_success(verdicts.where("status <> 'passed'"))


def test_wide_tables_take_several_passes(spark, monkeypatch):
    df = spark.createDataFrame([(None, "1", "x", "2.5", "True")] * 2, "a string, b string, c string, d string, e string")
    whole = (quality.null_counts(df).first(), profile.infer_types(df).collect(), profile.column_widths(df).collect())
    monkeypatch.setattr(quality, "COLUMNS_PER_PASS", 2)
    monkeypatch.setattr(profile, "COLUMNS_PER_PASS", 2)
    parts = (quality.null_counts(df).first(), profile.infer_types(df).collect(), profile.column_widths(df).collect())
    assert parts[0] == whole[0] and sorted(parts[1]) == sorted(whole[1]) and sorted(parts[2]) == sorted(whole[2])
    assert [r["type"] for r in whole[1]] == ["string", "bigint", "string", "double", "boolean"]


def test_dictionary_text(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "A int, `b c` string")
    text = profile.render_dictionary(profile.data_dictionary(df), F.lit("My Topic")).first()["value"]
    assert text == (
        "Dataset Topic: My Topic\nTotal Rows: 3\nTotal Columns: 2\nFormat: Raw CSV\n\nColumns present:\n"
        "- A (Nulls: 0)\n- b c (Nulls: 2)"
    )


def test_column_widths(spark):
    df = spark.createDataFrame(
        [(1234, 12, "é" * 150, 1e7, None, True, 0.5), (5, None, None, 2.5, None, False, NAN)],
        "id int, gaps int, long string, x double, a_long_header string, flag boolean, f double",
    )
    got = {r["column"]: r["width"] for r in profile.column_widths(df).collect()}
    # 12 prints as 12.0 beside a gap, 1e7 as 10000000.0, a boolean as 0 or 1.
    assert got == {"id": 6, "gaps": 6, "long": 100, "x": 12, "a_long_header": 15, "flag": 6, "f": 5}
    nothing = profile.column_widths(df.where("id < 0")).collect()
    assert [r["width"] for r in nothing] == [len(c) + 2 for c in df.columns]
    assert profile.column_widths(df.select("a_long_header").withColumnRenamed("a_long_header", "a")).first()["width"] == 6


def brute_rank(rows, n):
    return sorted(rows, key=lambda r: [(v is not None, v) for v in r])[:n]


@pytest.mark.parametrize("kind", ["bigint", "double", "string", "timestamp_ntz"])
def test_long_prefix_against_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(ranking, "TOP_K_ROWS", 10)
    rng = random.Random(7)
    # One key value holds a third of the rows, some are missing, all rows are distinct.
    rows = [(None if i % 50 == 0 else 5 if i % 3 == 0 else rng.randrange(1000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, i bigint").repartition(5)
    if kind == "timestamp_ntz":
        df = df.withColumn("k", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("k") / 8)))
    else:
        df = df.withColumn("k", F.lpad(F.col("k").cast("string"), 4, "0") if kind == "string" else F.col("k").cast(kind))
    for n in (11, 59, 60, 500, 1500, 2999, 3000, 4000):
        got = sorted(r["i"] for r in ranking.head_rows(df, ["k", "i"], n).collect())
        assert got == sorted(i for _, i in brute_rank(rows, n)), n


def test_long_prefix_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "TOP_K_ROWS", 10)
    df = spark.range(1000).select((F.col("id") % 2).alias("k"))
    got = ranking.head_rows(df, ["k"], 700).groupBy("k").count().collect()
    assert {tuple(r) for r in got} == {(0, 500), (1, 200)}


def test_row_limit_and_cap(spark):
    df = spark.range(100)
    assert [r["id"] for r in ranking.head_rows(df, ["id"], 10).orderBy("id").collect()] == list(range(10))
    assert ranking.head_rows(df, ["id"], 0).count() == 100
    assert ranking.head_rows(df, ["id"], 500).count() == 100
    full, cut = ranking.capped(df, ["id"], 100), ranking.capped(df, ["id"], 99)
    assert (full.count(), cut.count()) == (100, 99)
    assert not full.first()["truncated"] and cut.first()["truncated"]


def test_first_and_largest_per_group(spark):
    rows = [("a", 3, "z"), ("a", 3, "y"), ("a", None, "b"), ("b", None, "q"), ("c", -1, "m"), ("c", -2, "n")]
    df = spark.createDataFrame(rows, "g string, size int, name string")
    got = {tuple(r) for r in ranking.largest_per(df, ["g"], "size", "name", ["name", "size"]).collect()}
    assert got == {("a", "y", 3), ("b", "q", None), ("c", "m", -1)}
    got = {tuple(r) for r in ranking.first_per(df, ["g"], ["name"], ["name"]).collect()}
    assert got == {("a", "b"), ("b", "q"), ("c", "m")}


def test_key_pages_cover_everything_once(spark):
    df, seen, after = spark.range(0, 50, 3), [], None
    while True:
        page = sorted(r["id"] for r in ranking.key_page(df, "id", after, 4).collect())
        if not page:
            break
        seen += page
        after = page[-1]
    assert seen == list(range(0, 50, 3))


def test_large_whole_numbers_keep_their_digits(spark):
    rows = [("12345678901234567890", "1", "9" * 39, "12345678901234567890"), ("7", "2.5", "1", "2.5")]
    kinds = {r["column"]: r["type"] for r in profile.infer_types(spark.createDataFrame(rows, "a string, b string, c string, d string")).collect()}
    assert kinds == {"a": "decimal(38,0)", "b": "double", "c": "string", "d": "string"}


def test_key_pages_of_a_repeated_key(spark):
    rows = [(None if i % 7 == 0 else i % 4, i) for i in range(40)]
    df, seen, after = spark.createDataFrame(rows, "k bigint, i bigint").repartition(3), [], None
    while True:
        page = [tuple(r) for r in ranking.key_page(df, ["k", "i"], after, 3).collect()]
        if not page:
            break
        seen += page
        after = page[-1]
    assert seen == brute_rank(rows, 40)
    with pytest.raises(ValueError, match="repeated"):
        ranking.key_page(df, "k", None, 3)
    with pytest.raises(ValueError, match="as many values"):
        ranking.key_page(df, ["k", "i"], 1, 3)


def test_prefix_is_in_order_and_ties_are_spread(spark, monkeypatch):
    monkeypatch.setattr(ranking, "TOP_K_ROWS", 10)
    df = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") % 977).alias("v"))
    seen = []
    written = ranking.fresh_dir
    monkeypatch.setattr(ranking, "fresh_dir", lambda s, label: seen.append(written(s, label)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert ranking.head_rows(df, ["k"], 15_000).count() == 15_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in spark.read.parquet(seen[0]).groupBy("_part").count().collect()]
    assert max(sizes) < 10_000
    values = [r["v"] for r in ranking.head_rows(df, ["v"], 500).collect()]
    assert values == sorted(values)


def test_id_lookup(spark):
    index = spark.createDataFrame(
        [(2, "9", "aapl", "later"), (0, "320193", "AAPL", "Apple"), (1, "12345678901", "MSFT", "M"), (3, "5", None, "untagged")],
        "ordinal bigint, cik_str string, ticker string, title string",
    )
    requests = spark.createDataFrame([(1, "AapL"), (2, "none"), (3, "msft"), (4, "aapl")], "query_id int, query string")
    got = {r["query_id"]: r["cik"] for r in resolve.lookup_ids(requests, index).collect()}
    assert got == {1: "0000320193", 2: None, 3: "12345678901", 4: "0000320193"}


def catalog(spark, rows):
    return spark.createDataFrame(rows, "did bigint, name string, instances bigint, features bigint")


def test_catalog_match(spark):
    rows = [(1, "iris", 150, 4), (2, "wine", 178, 13), (3, "Iris-big", None, 1), (5, "IRIS2", 150, 9), (4, None, 999, 1)]
    requests = spark.createDataFrame([(1, "iris"), (2, "nope"), (3, ""), (4, "^w.n"), (5, "big$")], "query_id int, query string")
    got = {r["query_id"]: (r["did"], r["size_info"]) for r in resolve.best_catalog_match(requests, catalog(spark, rows)).collect()}
    assert got == {
        1: (1, "150 rows, 4 columns"), 2: (None, None), 3: (2, "178 rows, 13 columns"), 4: (2, "178 rows, 13 columns"), 5: (3, None)
    }


WORDS = ["iris", "Wine", "credit", "maſs", "İzmir", "ısı", "a", "bb", "straße", "long-winded-title", "x.y", "C++", "Kelvin"]


def test_catalog_match_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resolve, "PATTERNS_PER_CHUNK", 3)
    rng = random.Random(3)
    names = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 4))) for _ in range(120)] + [None, ""]
    rows = [(i, name, rng.choice([None, 1, 2, 3]), 1) for i, name in enumerate(names)]
    queries = [w.upper() for w in WORDS if w not in ("C++",)] + [w[1:4] for w in WORDS if w != "C++"]
    queries += ["", "^iris", "wine$", "(a|b)b", "[xk]", r"x\.y", "winded-title i", "s", "no such", None]
    requests = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    got = {r["query_id"]: r["did"] for r in resolve.best_catalog_match(requests, catalog(spark, rows)).collect()}
    for i, query in enumerate(queries):
        hits = [] if query is None else [r for r in rows if r[1] is not None and re.search(query, r[1], re.IGNORECASE)]
        best = min(hits, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]), default=(None,))
        assert got[i] == best[0], query


@pytest.mark.parametrize("few", [0, 10_000])
def test_links_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(resolve, "LITERAL_QUERIES", few)
    rng = random.Random(5)
    cities = ["amsterdam", "paris", "new-york-city", "rome"]
    # A third of all links share one city.
    links = [
        (i // 10, i % 10, f"http://data/{'Amsterdam' if i % 3 == 0 else rng.choice(cities)}/{rng.randrange(9)}/listings.csv{rng.choice(['.gz', '', '.GZ'])}")
        for i in range(200)
    ]
    queries = ["AMSTERDAM", "paris", "york", "e", "oslo", "", "amsterdam/3", "listings.csv.gz", "new-york-city/"]
    requests = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    df = spark.createDataFrame(links, "page_id bigint, position bigint, href string")
    got = {r["query_id"]: r["href"] for r in resolve.first_links(requests, df, "listings.csv.gz").collect()}
    for i, query in enumerate(queries):
        hits = [h for _, _, h in sorted(links) if query.lower() in h.lower() and h.endswith("listings.csv.gz")]
        assert got[i] == (hits[0] if hits else None), query


def random_pattern(rng, depth=0):
    """Patterns that the engine and Python read alike."""
    atoms = ["a", "b", "ir", "is", "Wine", "-", " ", ".", "[ab]", "[^x\\]]", r"\.", r"\+", r"\w", r"\d", r"\x61", r"\Qwi.n\E", "é", "^", "$"]
    if depth < 3:
        atoms += [f"({random_pattern(rng, depth + 1)})", f"(?:{random_pattern(rng, depth + 1)})", f"(?={random_pattern(rng, depth + 1)})"]
    quantifiers = ["", "", "", "", "?", "*", "+", "{2}", "{0,2}", "+?", "{1,}"]
    bare = ("^", "$")
    parts = [a + ("" if a in bare or a.startswith("(?=") else rng.choice(quantifiers)) for a in rng.choices(atoms, k=rng.randrange(1, 5))]
    return "|".join(["".join(parts), *([random_pattern(rng, depth + 1)] if depth < 3 and rng.random() < 0.3 else [])])


def test_needed_literals():
    def need(pattern):
        return literals.needed_literals(pattern)

    assert need("iris") == need("(?i)iris") == need("x*iris$") == need("^(iris)+") == ["iris"]
    assert need("(hot|cold) bolt") == [" bolt"] and need("hot|cold") == ["cold", "hot"]
    assert need("colou?r") == ["colo"] and need("ab{0,3}cde") == ["cde"] and need("ab{2}") == ["ab"]
    assert need(r"\x41bc\Q.*\Ed\.e") == ["bc.*d.e"] and need(r"\p{L}xy\pLz") == ["xy"] and need(r"(a)\1234") == ["a"]
    assert need("[a]b]c") == ["b]c"] and need("[]a]b") == ["b"] and need(r"[\]x]yz") == ["yz"]
    for unclear in ("", ".*", "[ab]", "a|", "(?x)a b", "(?=a)", "(?!abc)", "[a[b]]c", "[a&&b]c", "a)b", "(", "x{", "(?-i)abc", "(?<n>a)?"):
        assert need(unclear) == [], unclear


def test_random_patterns_against_the_engine(spark, monkeypatch):
    monkeypatch.setattr(resolve, "PATTERNS_PER_CHUNK", 7)
    rng = random.Random(9)
    names = [" ".join(rng.choices([*WORDS, "wi.n", "aab", "isis"], k=rng.randrange(1, 4))) for _ in range(150)]
    rows = catalog(spark, [(i, n, rng.randrange(5), 1) for i, n in enumerate(names)])
    bad = ["(", "[a", "a{2", "*", "x(?<", "a**", "(?z)a", "a\\"]
    queries = [random_pattern(rng) for _ in range(400)] + bad + [None]
    requests = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    got = {r["query_id"]: r["did"] for r in resolve.best_catalog_match(requests, rows).collect()}
    assert {r["query"] for r in resolve.rejected_searches(requests).collect()} == set(bad)
    assert len(got) == len(queries)
    # The engine itself over all pairs.
    pairs = requests.where(F.col("query").isNotNull() & ~F.col("query").isin(bad)).crossJoin(rows)
    hits = pairs.where(F.expr("name rlike concat('(?iu)', query)")).groupBy("query_id").agg(F.min_by("did", F.struct(-F.col("instances"), "did")).alias("did"))
    best = {r["query_id"]: r["did"] for r in hits.collect()}
    assert len(best) > 100
    assert got == {i: best.get(i) for i in range(len(queries))}
    plan = resolve._regex_pairs(requests.select("query"), rows)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_query_at_all(spark):
    none = spark.createDataFrame([], "query_id int, query string")
    assert resolve.best_catalog_match(none, catalog(spark, [(1, "a", 1, 1)])).collect() == []


def test_registry_joins(spark):
    registry = spark.createDataFrame([("sec", "x"), ("fred", "y")], "source string, dir_name string")
    requests = spark.createDataFrame([(1, "SEC"), (2, "gopher"), (3, "fred")], "id int, source string")
    assert {r["id"] for r in resolve.known_sources(requests, registry).collect()} == {1, 3}
    assert {r["id"] for r in resolve.unknown_sources(requests, registry).collect()} == {2}
    required = spark.createDataFrame([("id",), ("ID2",)], "column string")
    assert [r["column"] for r in resolve.missing_columns(required, requests).collect()] == ["ID2"]


def test_align(spark):
    features = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, x string, y int")
    target = spark.createDataFrame([(2, 7), (3, 8)], "k int, y int")
    appended = align.append_target(features, target, ["k"], "y").orderBy("k")
    assert appended.columns == ["k", "x", "y"]
    assert [tuple(r) for r in appended.collect()] == [(1, "a", None), (2, "b", 7)]
    with pytest.raises(Exception, match="repeated in the target"):
        align.append_target(features, target.unionByName(target), ["k"], "y").collect()
    joined = align.concat_target(features, target, ["k"]).orderBy("k")
    assert joined.columns == ["k", "x", "y", "y_target"]
    assert [tuple(r) for r in joined.collect()] == [(1, "a", 0, None), (2, "b", 0, 7), (3, None, None, 8)]


def test_bag_difference(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "i int, s string")
    right = spark.createDataFrame([("a", 1), (None, 2), ("c", 3), ("c", 3)], "s string, i int")
    assert {tuple(r) for r in compare.bag_difference(left, right).collect()} == {(1, "a", 1), (3, "c", -1)}
    assert compare.bag_difference(left, left).isEmpty()
    with pytest.raises(ValueError, match="columns differ"):
        compare.bag_difference(left, left.withColumn("more", F.lit(1)))


def test_slug_collisions(spark):
    df = spark.createDataFrame([("a b",), ("a  b",), ("A-b",), ("a b",), (None,)], "q string")
    assert [tuple(r) for r in compare.slug_collisions(df, F.col("q")).collect()] == [("a_b", 2, "a  b", "a b")]


def test_recency(spark):
    df = spark.sql(
        "select * from values ('live', timestamp_ntz'2024-01-10'), ('live', timestamp_ntz'2023-01-01'), "
        "('edge', timestamp_ntz'2024-01-05'), ('gone', timestamp_ntz'2024-01-01') as t(k, ts)"
    )
    assert {r["k"] for r in history.active_keys(df, "k", "ts").collect()} == {"live"}
    assert history.keep_active(df, "k", "ts").count() == 2
    asof = F.lit("2024-01-09").cast("timestamp_ntz")
    assert {r["k"] for r in history.active_keys(df, "k", "ts", asof=asof).collect()} == {"live", "edge"}


def test_names_with_dots_and_blanks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "TOP_K_ROWS", 2)
    df = spark.range(20).select(F.col("id").alias("a.b"), F.lit("x").alias("c d"))
    assert sorted(r[0] for r in ranking.head_rows(df, ["a.b"], 5).collect()) == list(range(5))
    assert ranking.capped(df, ["c d", "a.b"], 1).first()[0] == 0
    assert ranking.key_page(df, "a.b", 18, 5).count() == 1
    assert compare.bag_difference(df, df).isEmpty()
    assert [r["column"] for r in profile.column_widths(df).collect()] == ["a.b", "c d"]
    assert quality.assess(quality.null_counts(df)).first()["status"] == "passed"


@pytest.fixture
def hot_keys(spark):
    """A third of the rows under one key, and settings that make this table a large one."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.shuffle.partitions": "32",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    ids = spark.range(0, 60_000, 1, 6)
    yield ids.select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"))
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df._jdf.queryExecution().executedPlan().execute().count()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_split(spark, hot_keys):
    verdicts = quality.gate(hot_keys, ["key"], ["id"])
    passed = quality.keep_passed(hot_keys, verdicts, ["key"])
    assert passed.count() == 60_000
    assert "skew=true" in final_plan(passed)

    keys = hot_keys.select("key").distinct()
    index = keys.select(F.hash("key").cast("bigint").alias("ordinal"), F.lit("1").alias("cik_str"), F.upper("key").alias("ticker"), F.lit("t").alias("title"))
    found = resolve.lookup_ids(hot_keys.select(F.col("id").alias("query_id"), F.col("key").alias("query")), index)
    assert found.where("cik = '0000000001'").count() == 60_000
    assert "skew=true" in final_plan(found)

    live = history.keep_active(hot_keys.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")), "key", "ts")
    assert live.count() == 60_000
    assert "skew=true" in final_plan(live)


def test_hash_needs_equal_types(spark):
    with pytest.raises(TypeError):
        joins.join_reduced(spark.range(3), spark.range(3).select(F.col("id").cast("int").alias("id")), ["id"])


def test_bag_difference_reads_only_buckets_that_differ(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 0.0, -0.0, NAN, 1.5]), rng.choice([None, "a", "b"]), rng.choice([None, "a", "b"])) for _ in range(300)]
    left = spark.createDataFrame(rows, "x double, y string, z string")
    assert compare.differing_buckets(left, left.orderBy("y").select("z", "y", "x").select("x", "y", "z")) == []
    assert compare.bag_difference(left, left.select("z", "x", "y")).collect() == []
    # Swapped nulls and one more copy are seen.
    right = spark.createDataFrame([*rows[1:], (None, None, "q"), (None, "p", None)], left.schema)
    other = spark.createDataFrame([*rows[1:], (None, "q", None), (None, "p", None), (None, "p", None)], left.schema)
    got = {(r["y"], r["z"]): r["surplus"] for r in compare.bag_difference(right, other).collect()}
    assert got == {(None, "q"): 1, ("q", None): -1, ("p", None): -1}
    assert len(compare.differing_buckets(right, other)) == 3
    empty = left.limit(0)
    assert sum(r["surplus"] for r in compare.bag_difference(left, empty).collect()) == 300
    assert compare.bag_difference(empty, empty).collect() == []


def test_concat_refuses_repeated_keys_and_aligns_by_position(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    two = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    for pair, side in (((two, one), "features"), ((one, two), "target")):
        with pytest.raises(ValueError, match=f"repeated in the {side}"):
            align.concat_target(*pair, ["k"])
    rows = spark.range(0, 1000, 1, 7)
    fewer = spark.range(0, 900, 1, 3).select((F.col("id") * 2).alias("id"), F.lit("t").alias("v"))
    got = align.concat_by_position(rows, fewer).orderBy("position").collect()
    assert [tuple(r) for r in got] == [(i, i, 2 * i if i < 900 else None, "t" if i < 900 else None) for i in range(1000)]
    with pytest.raises(ValueError, match="numbered"):
        align.concat_by_position(rows.withColumnRenamed("id", "position"), fewer)
    assert align.concat_by_position(one.limit(0), two.limit(0)).collect() == []


def test_presence_keeps_what_counts(spark):
    df = spark.createDataFrame([(1, "long text", NAN), (2, None, 1.0), (None, "", None)], "k int, `a.b` string, x double")
    flags = nulls.presence(df, ["k"])
    assert dict(flags.dtypes) == {"k": "int", "a.b": "boolean", "x": "boolean"}
    assert quality.null_counts(flags).collect() == quality.null_counts(df).collect()


def test_pages_of_ranked_rows(spark):
    rows = [(i % 7, None if i % 5 == 0 else f"v{i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows, "k int, v string").repartition(5)
    ranked = ranking.rank_rows(df, ["k", "v"])
    ordered = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    pages = [[tuple(r) for r in ranked.page(i, 30).collect()] for i in range(8)]
    assert [r for p in pages for r in p] == ordered and [len(p) for p in pages] == [30] * 6 + [20, 0]
    index = ranked.pages(30).orderBy("page").collect()
    assert [(r["page"], (r["k"], r["v"]), r["rows"]) for r in index] == [(i, ordered[30 * i], min(30, 200 - 30 * i)) for i in range(7)]
    assert ranking.rank_rows(df.limit(0), ["k"]).page(0, 10).collect() == []
    plan = ranked.page(2, 30)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_place" in plan and "Exchange hashpartitioning" not in plan
