import csv
import gzip
import json
import random
from collections import Counter
from decimal import Decimal
from html import unescape

import pytest
from pyspark.sql import functions as F

from rawharbor.plans.layout import RAW_CSV_READ, write_raw
from rawharbor.session import fresh_dir
from rawharbor.sources import delimited, html, members, payloads, registry


def test_csv_keeps_quotes_breaks_and_blanks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"say ""hi"", ok"\n2,"two\nlines"\n3, padded \n4,\n')
    rows = delimited.scan_csv(spark, str(tmp_path)).orderBy("id").collect()
    assert [r["note"] for r in rows] == ['say "hi", ok', "two\nlines", " padded ", None]


def test_raw_write_changes_nothing(spark):
    values = [' lead', 'trail ', 'q"uote', 'a,b', 'x\ny', 'x\r\ny', 'back\\slash', 'end\\', '#no comment', '', None, "é"]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string").coalesce(1)
    path = fresh_dir(spark, "raw")
    write_raw(df, path)
    back = delimited.scan_csv(spark, path, df.schema, **RAW_CSV_READ).orderBy("id").collect()
    # An empty field is a missing value to every scan, quoted or not.
    assert [r["v"] for r in back] == [v or None for v in values]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_splitting_scan_reads_every_record(spark, tmp_path, end):
    rng = random.Random(11)
    values = ["plain", "", '"with, comma"', '"say ""hi"""', '"two\nlines"', '"a\n\n""b""\n,c"', '""""', '"\n"', '"x\r\ny"', "é"]
    expected = Counter()
    for name in ("a.csv", "b.csv", "short.csv"):
        rows = [] if name == "short.csv" else [f"{i},{rng.choice(values)},{rng.choice(values)}" for i in range(200)]
        rows.insert(len(rows) // 2, "777," + '"' + "long\nvalue " * 200 + '",z')
        (tmp_path / name).write_text(end.join(['"id","first ""name""",c', *rows]) + end, newline="")
        with open(tmp_path / name, newline="") as file:
            expected.update(tuple(v or None for v in row) for row in list(csv.reader(file))[1:])
    if end == "\n":
        assert Counter(map(tuple, delimited.scan_csv(spark, str(tmp_path)).collect())) == expected
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for bytes_per_split in ("200", "3000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_per_split)
            got = delimited.scan_csv_splitting(spark, str(tmp_path))
            assert got.columns == ["id", 'first "name"', "c"]
            assert Counter(map(tuple, got.collect())) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@pytest.mark.parametrize("seed", range(5))
def test_splitting_scan_equals_plain_scan_with_stray_quotes(spark, tmp_path, seed):
    rng = random.Random(seed)
    parts = ['"', '""', ",", "\n", "a", "b ", " ", '""', '",', ',"', '"\n', '1.5" p', 'x"y']
    for name in "abc":
        while True:
            body = "".join(rng.choice(parts) for _ in range(rng.randrange(5, 60)))
            if body.count('"') % 2 == 0:  # mostly closed again; the others are looked at below
                break
        rows = "1,2,3\n" * rng.randrange(3)
        (tmp_path / f"{name}.csv").write_text(f"h1,h2,h3\n{rows}{body}\nend,1,2\n", newline="")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for name in "abc":
        path = str(tmp_path / f"{name}.csv")
        expected = Counter(map(tuple, delimited.scan_csv(spark, path).collect()))
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(rng.choice([3, 10, 40, 1000])))
            got = Counter(map(tuple, delimited.scan_csv_splitting(spark, path).collect()))
        except Exception as error:  # noqa: BLE001
            # The plain scan takes the rest of the file for one value.
            assert "ends inside a quoted value" in str(error)
            assert ("end", "1", "2") not in expected
        else:
            assert got == expected
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_stray_quote_in_the_first_row(spark, tmp_path):
    rows = ['0,1.5" pipe', *[f'{i},"x\n{i}"' for i in range(1, 300)]]
    (tmp_path / "a.csv").write_text("id,v\n" + "\n".join(rows) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        scan = delimited.scan_csv_literal(spark, str(tmp_path))
        assert scan.count() == 300 and scan.rdd.getNumPartitions() > 1
        assert scan.where("id = '0'").first()["v"] == '1.5" pipe'
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    with pytest.raises(ValueError, match="doubled"):
        delimited.scan_csv_splitting(spark, str(tmp_path), quote="'")


def test_timestamps_keep_microseconds(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:00:07.179575' a, timestamp'2024-01-01 00:00:07.000001' b")
    path = fresh_dir(spark, "ts")
    write_raw(df, path)
    assert delimited.scan_csv(spark, path, df.schema, **RAW_CSV_READ).collect() == df.collect()


def test_inferred_types_and_missing_spellings(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,x,b,price,s\n1,1.5,True,\"$1,200.00\",N/A\nNA,nan,false,$2,a\n-3,2e3,TRUE,,1d\n")
    df = delimited.scan_csv_inferred(spark, str(tmp_path))
    assert dict(df.dtypes) == {"n": "bigint", "x": "double", "b": "boolean", "price": "string", "s": "string"}
    got = {tuple(r) for r in df.collect()}
    assert got == {(1, 1.5, True, "$1,200.00", None), (None, None, False, "$2", "a"), (-3, 2000.0, True, None, "1d")}


def test_gzip_by_suffix(spark, tmp_path):
    with gzip.open(tmp_path / "listings.csv.gz", "wt") as out:
        out.write('id,price\n1,"$1,200.00"\n2,$3\n')
    df = registry.get_source("airbnb").read(spark, str(tmp_path / "listings.csv.gz"), {})
    assert {tuple(r) for r in df.collect()} == {("1", "$1,200.00"), ("2", "$3")}


def facts(spark, *documents, **kwargs):
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    df = spark.createDataFrame(rows, "doc int, payload string")
    return payloads.flatten_facts(df, "payload", ("doc",), **kwargs)


def test_facts_levels_units_and_absent_fields(spark):
    document = {
        "cik": 1,
        "facts": {
            "us-gaap": {
                "Revenue": {"label": "r", "units": {"USD": [{"val": 1000, "fy": 2020, "fp": "FY", "form": "10-K", "filed": "f", "end": "e", "accn": "x"}], "EUR": [{"val": 7}, {"val": None}]}},
                "NoUnits": {"label": "n"},
                "Empty": {"units": {}},
            },
            "dei": {"Shares": {"units": {"shares": [{"val": 5.25, "start": "s"}]}}},
        },
    }
    df = facts(spark, document, {"facts": {}}, {}, "not json")
    assert df.columns == ["doc", "taxonomy", "concept", "unit", "val", "fy", "fp", "form", "filed", "end"]
    got = sorted(map(tuple, df.drop("doc").collect()), key=str)
    expected = [
        ("us-gaap", "Revenue", "USD", "1000", "2020", "FY", "10-K", "f", "e"),
        ("us-gaap", "Revenue", "EUR", "7", *[None] * 5),
        ("us-gaap", "Revenue", "EUR", None, *[None] * 5),
        ("dei", "Shares", "shares", "5.25", *[None] * 5),
    ]
    assert got == sorted(expected, key=str)


def test_repeated_key_keeps_last(spark):
    text = '{"facts":{"t":{"c":{"units":{"U":[{"val":1}]}}},"t":{"c":{"units":{"U":[{"val":2}],"V":[{"val":3}],"U":[{"val":4}]}}}}}'
    assert {(r["unit"], int(r["val"])) for r in facts(spark, text).collect()} == {("U", 4), ("V", 3)}


def test_exact_values(spark):
    text = (
        '{"facts":{"t":{"c":{"units":{"U":[{"val":12345678901234567890.12},{"val":9007199254740993},{"val":0.123456789},'
        '{"val":-3}]}}}}}'
    )
    assert {r["val"] for r in facts(spark, text).collect()} == {
        "12345678901234567890.12", "9007199254740993", "0.123456789", "-3"
    }
    exact = {r["val"] for r in facts(spark, text, value_type="decimal(38,9)").collect()}
    assert Decimal("12345678901234567890.120000000") in exact and Decimal("9007199254740993") in exact
    assert {r["val"] for r in facts(spark, text, value_type="double").collect()} >= {0.123456789, -3.0}


def test_character_references(spark):
    raw = ["a&amp;b", "&amp;lt;", "&#38;lt;", "&#x26;#39;", "&#39;x&#x27;", "&#233;&#x1F600;", "&#0;", "&lt;&gt;&quot;&apos;", "&bogus;", "1 & 2", "caf&eacute;&hellip;&AMP;lt;", "&NotEqualTilde;&amp;eacute;"]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, v string")
    got = [r["v"] for r in df.select("i", html.unescape(F.col("v")).alias("v")).orderBy("i").collect()]
    assert got == [unescape(v) for v in raw]


def test_observations_and_rejects(spark):
    rows = [
        (1, '{"observations":[{"date":"2024-01-01","value":"."},{"date":"2024-02-01","value":"101.5","realtime_start":"x"}]}'),
        (2, '{"observations":[]}'), (3, "{}"), (4, '{"error":"bad"}'),
    ]
    df = spark.createDataFrame(rows, "id int, payload string")
    got = payloads.flatten_observations(df, "payload").collect()
    assert [tuple(r) for r in got] == [("2024-01-01", "."), ("2024-02-01", "101.5")]
    assert {r["id"] for r in payloads.reject_observations(df, "payload", ("id",)).collect()} == {2, 3, 4}


def test_keyed_objects_in_document_order(spark):
    rows = [('{"10":{"cik_str":320193,"ticker":"AAPL","title":"Apple"},"2":{"cik_str":1,"ticker":null},"3":{}}',)]
    df = payloads.keyed_objects(spark.createDataFrame(rows, "p string"), "p").orderBy("ordinal")
    assert [tuple(r) for r in df.collect()] == [(2, "1", None, None), (3, None, None, None), (10, "320193", "AAPL", "Apple")]


PAGE = """<html><A HREF='one'>x</A><a class="b" href = "two?a=1&amp;b=2" id=z>y</a><a data-href="no">n</a><a name=q>n</a>
<!-- <a href="hidden"> --><script>var s='<a href="js">';</script><abbr href="no"></abbr><a title="t > u href='no'"
 href=three>z</a><area href="no"><a href="">e</a><a disabled href="four">w</a></html>"""


def test_anchors(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "none"), (3, None)], "id int, html string")
    got = html.anchors(df, "html", ("id",)).orderBy("id", "position").collect()
    assert [tuple(r) for r in got] == [(1, i, h) for i, h in enumerate(["one", "two?a=1&b=2", "three", "", "four"])]


def test_attributes_without_blanks_between(spark):
    page = """<a class="x"href="/a">1</a><a class='y'href='/b&eacute;'id=1>2</a><a data-href="no"href=c>3</a><a title="href='no'"b>4</a>"""
    broken = page + "<a " + "x=\"y\"" * 2_000 + " href=/end>" + "<a " + "y " * 2_000
    got = html.anchors(spark.createDataFrame([(1, page), (2, broken)], "id int, html string"), "html", ("id",)).collect()
    assert [r["href"] for r in got if r["id"] == 1] == ["/a", "/bé", "c"]
    assert [r["href"] for r in got if r["id"] == 2] == ["/a", "/bé", "c", "/end"]


def test_anchor_of_a_long_page_does_not_overflow(spark):
    body = "<a href='x'>" + "word " * 200_000 + "<a " + "y=1 " * 500 + "href='end'>"
    got = html.anchors(spark.createDataFrame([(1, body)], "id int, html string"), "html", ("id",)).collect()
    assert [r["href"] for r in got] == ["x", "end"]


def test_table_rows_keep_empty_cells_and_repeats(spark):
    page = "<table><tr><th>Model</th><th>FPS</th></tr><tr><td>A &amp; B</td><td></td></tr><tr><td><b>A</b></td><td>60</td></tr></table>"
    got = html.table_rows(spark.createDataFrame([(1, page)], "id int, html string"), "html", ("id",)).orderBy("position").collect()
    assert [r["cells"] for r in got] == [["Model", "FPS"], ["A & B", None], ["A", "60"]]


def test_members_and_largest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, size in {"b.csv": 30, "a.csv": 30, "sub/c.csv": 20, "big.txt": 99, "X.CSV": 80, ".hid.csv": 90}.items():
        (tmp_path / name).write_text("h\n" + "1\n" * size)
    got = {r["path"].rsplit("/", 1)[1]: r["size"] for r in members.csv_members(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": 62, "b.csv": 62, "c.csv": 42}
    assert registry.get_source("kaggle").read(spark, str(tmp_path), {}).count() == 30
    empty = tmp_path / "sub" / "none"
    empty.mkdir()
    with pytest.raises(ValueError, match="no CSV"):
        registry.get_source("kaggle").read(spark, str(empty), {})


def test_registry_errors_and_plug_in(spark):
    with pytest.raises(ValueError, match=r"'gopher' is not registered.*airbnb.*yfinance"):
        registry.get_source("gopher")
    registry.register(registry.Source("Ranges", "ranges", "mem://{}", lambda s, path, options: s.range(int(path))))
    try:
        assert registry.get_source("RANGES").read(spark, "4", {}).count() == 4
    finally:
        registry.SOURCES.pop("ranges")


def test_path_and_table_rules(spark):
    paths = ["a/data/x.csv", "a/raw/x.xlsx", "data/x.csv", "a/src/x.csv", "a/datasets/x.CSV", "a/datasets/b/x.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r["p"] for r in df.where(members.in_data_folder(F.col("p"))).collect()} == {paths[0], paths[1], paths[5]}
    names = spark.createDataFrame([("dolt_log",), ("sales",), ("my_dolt_x",)], "n string")
    assert {r["n"] for r in names.where(members.user_table(F.col("n"))).collect()} == {"sales", "my_dolt_x"}
