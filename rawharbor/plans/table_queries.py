"""Every operator bound to the given tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rawharbor.functions import text
from rawharbor.functions.nulls import na_to_null, presence
from rawharbor.operators import align, compare, history, profile, quality, ranking, resolve
from rawharbor.plans import landing
from rawharbor.plans.ingest import Request, ingest, ingest_all
from rawharbor.plans.layout import RAW_CSV_READ, write_raw, write_raw_batch
from rawharbor.plans.publish import export, export_sheets, publish, publish_table
from rawharbor.plans.requests import plan_requests
from rawharbor.session import fresh_dir, small_table
from rawharbor.sources import delimited, html, members, payloads
from rawharbor.sources.registry import registry_table, source_url
from rawharbor.streaming.landed import load_landed, read_accepted, read_verdicts
from rawharbor.streaming.rate import rate_audit, rolling_rate

GATE = 0.6
CATALOG_QUERIES = ("RING", "^old", "gear$", "", "b[lo]", "no such name", "(hot|cold) bolt", "plate")
LINK_QUERIES = ("TH", "é", "mentr", "no such link", "EN")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return align.append_target(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"], ["quality", "toxic"])


def labelled_presence(spark: SparkSession, sf: str) -> DataFrame:
    """The same for counting nulls: no text passes the join."""
    documents = presence(table(spark, sf, "documents"), ["doc_id", "source", "lang"])
    return align.append_target(documents, presence(table(spark, sf, "labels"), ["doc_id"]), ["doc_id"], ["quality", "toxic"])


def numbered(spark: SparkSession, queries: tuple[str, ...]) -> DataFrame:
    return small_table(spark, list(enumerate(queries)), "query_id bigint, query string")


def with_ids(queries: DataFrame) -> DataFrame:
    """Queries found in the data are their own ids."""
    return queries.distinct().select(F.col("query").alias("query_id"), "query")


def assigned(df: DataFrame, answers: dict[str, str], column: str) -> Column:
    value = F.lit(None).cast("string")
    for key, answer in answers.items():
        value = F.when(F.col(column) == key, F.lit(answer)).otherwise(value)
    return value


# --- profile and gate -----------------------------------------------------------


def data_dictionary(spark, sf):
    return profile.data_dictionary(labelled_presence(spark, sf))


def description_text(spark, sf):
    dictionary = profile.data_dictionary(labelled_presence(spark, sf), ["lang"])
    return profile.render_dictionary(dictionary, F.concat(F.lit("Corpus "), F.col("lang")), ["lang"])


def source_verdicts(spark, sf):
    return quality.gate(labelled_presence(spark, sf), ["source"], ["quality", "toxic"], GATE)


def null_density_gate(spark, sf):
    return source_verdicts(spark, sf).select(
        "source", "rows", "nulls", F.col("columns").cast("bigint").alias("columns"),
        F.round("density", 9).alias("density"), "status", "message",
    )


def gate_threshold_edges(spark, sf):
    orders = table(spark, sf, "orders")
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    first = F.when(
        (priority == "1-URGENT") | (priority == "3-MEDIUM") | ((priority == "2-HIGH") & (status != "F")), F.col("o_orderkey")
    )
    rest = F.when(priority == "3-MEDIUM", F.col("o_custkey"))
    datasets = orders.select(
        priority.alias("dataset"), first.alias("a"), rest.alias("b"), rest.alias("c"),
        F.when(priority == "3-MEDIUM", F.col("o_totalprice")).when(priority == "5-LOW", float("nan")).alias("d"),
        rest.alias("e"),
    )
    expected = orders.select(priority.alias("dataset")).union(table(spark, sf, "region").select("r_name"))
    return quality.gate(datasets, ["dataset"], expected=expected).select("dataset", "rows", "nulls", "status", "message")


def passed_rows_only(spark, sf):
    rows = labelled(spark, sf)
    return quality.keep_passed(rows, source_verdicts(spark, sf), ["source"]).select("doc_id", "source", "quality", "toxic")


def batch_outcome(spark, sf):
    return quality.outcome(source_verdicts(spark, sf))


def column_widths(spark, sf):
    widths = profile.column_widths(table(spark, sf, "customer"))
    return widths.select(F.col("ordinal").cast("bigint").alias("ordinal"), "column", F.col("width").cast("bigint").alias("width"))


def column_widths_missing(spark, sf):
    rows = labelled(spark, sf).select(
        "doc_id", "source", "quality", F.when(F.col("quality") == 1, F.col("lang")).alias("lang"),
        F.lit(None).cast("string").alias("nothing"),
    )
    widths = profile.column_widths(rows)
    return widths.select(F.col("ordinal").cast("bigint").alias("ordinal"), "column", F.col("width").cast("bigint").alias("width"))


def events_as_text(spark, sf):
    events = table(spark, sf, "events")
    token = lambda c: F.when(F.col("event_type") == "error", F.lit("N/A")).otherwise(c)
    return events.select(
        token(F.col("event_id").cast("string")).alias("event_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        token(F.format_string("%.2f", "value")).alias("value"),
        F.when(F.col("event_type") == "click", F.lit("True")).when(F.col("event_type") == "view", F.lit("FALSE"))
        .otherwise(F.lit("None")).alias("clicked"),
        token(F.col("event_type")).alias("event_type"),
        F.lit("nan").alias("nothing"),
    )


def infer_types(spark, sf):
    rows = events_as_text(spark, sf)
    clean = rows.select(*[na_to_null(F.col(c)).alias(c) for c in rows.columns])
    return profile.infer_types(clean).select(F.col("ordinal").cast("bigint").alias("ordinal"), "column", "type")


def na_tokens(spark, sf):
    rows = events_as_text(spark, sf)
    return rows.select(*[na_to_null(F.col(c)).alias(c) for c in ("event_id", "value", "clicked", "event_type", "nothing")])


# --- payload scans ----------------------------------------------------------------


def facts_flatten(spark, sf):
    documents = landing.land(landing.facts_documents(table(spark, sf, "events")), "facts")
    facts = payloads.flatten_facts(documents, "payload", ("user_id",))
    return facts.withColumn("val", F.col("val").cast("double")).withColumn("fy", F.col("fy").cast("bigint"))


def facts_literal(spark, sf):
    """Years written as text, with a decimal point, as a number and not at all, and long
    values: every digit is kept, zeros at the end of a fraction are not."""
    events = table(spark, sf, "events")
    year = F.year("ts").cast("string")
    form = F.col("event_id") % 4
    fy = F.when(form == 0, F.concat(F.lit(', "fy": "FY'), year, F.lit('"'))).when(form == 1, F.concat(F.lit(', "fy": '), year, F.lit(".0")))
    fy = F.coalesce(fy, F.when(form == 2, F.concat(F.lit(', "fy": '), year)), F.lit(""))
    digits = F.concat(F.lit("12345678901234567890"), F.lpad(F.col("event_id").cast("string"), 8, "0"), F.lit(".50"))
    document = F.concat(F.lit('{"facts": {"t": {"c": {"units": {"U": [{"val": '), digits, fy, F.lit("}]}}}}}"))
    landed = landing.land(events.select("event_id", document.alias("payload")), "facts-literal")
    return payloads.flatten_facts(landed, "payload", ("event_id",)).select("event_id", "val", "fy", "fp")


def observations_flatten(spark, sf):
    documents = landing.land(landing.observation_documents(table(spark, sf, "events")), "observations")
    return payloads.flatten_observations(documents, "payload", ("user_id",))


def observation_rejects(spark, sf):
    documents = landing.land(landing.observation_documents(table(spark, sf, "events"), "purchase"), "purchases")
    return payloads.reject_observations(documents, "payload", ("user_id", "block"))


def keyed_object_scan(spark, sf):
    return payloads.keyed_objects(landing.land(landing.index_documents(table(spark, sf, "customer")), "index"), "payload")


def id_index_lookup(spark, sf):
    supplier = table(spark, sf, "supplier")
    segment = F.when(F.col("s_acctbal") > 8000, "BUILDING").when(F.col("s_acctbal") > 1000, "machinery").otherwise("Absent")
    requests = supplier.select(
        F.col("s_suppkey").alias("query_id"), F.concat_ws("-", segment, F.col("s_nationkey").cast("string")).alias("query")
    )
    return resolve.lookup_ids(requests, keyed_object_scan(spark, sf))


def page_links(spark, sf):
    return html.anchors(table(spark, sf, "pages"), "html", ("page_id",)).withColumn("position", F.col("position").cast("bigint"))


def html_table_rows(spark, sf):
    rows = html.table_rows(landing.land(landing.html_documents(table(spark, sf, "part")), "html"), "html", ("block",))
    return rows.select(
        "block", F.col("cells")[0].cast("bigint").alias("p_partkey"), F.col("cells")[1].alias("p_name"), F.col("cells")[2].alias("brand")
    )


# --- resolution -------------------------------------------------------------------


def part_catalog(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("did"), F.col("p_name").alias("name"), F.col("p_size").cast("bigint").alias("instances"),
        F.length("p_type").cast("bigint").alias("features"),
    )


def catalog_best_match(spark, sf):
    return resolve.best_catalog_match(numbered(spark, CATALOG_QUERIES), part_catalog(spark, sf))


def catalog_match_bulk(spark, sf):
    name = F.col("p_name")
    first, last = F.substring_index(name, " ", 1), F.substring_index(name, " ", -1)
    forms = F.array(
        F.upper(name), first, last, F.concat(F.lit("^"), first), F.concat(last, F.lit("$")),
        F.concat(F.lit("("), first, F.lit("|"), last, F.lit(")$")), F.concat(first, F.lit(".*"), last),
        F.concat(F.lit("["), F.substring(first, 1, 2), F.lit("]+ "), last), F.concat(F.lit("("), first),
    )
    queries = with_ids(table(spark, sf, "part").select(name).distinct().select(F.explode(forms).alias("query")))
    invalid = resolve.rejected_searches(queries).select("query_id", F.lit(True).alias("rejected"))
    matched = resolve.best_catalog_match(queries, part_catalog(spark, sf))
    return matched.join(invalid, "query_id", "left").withColumn("rejected", F.coalesce("rejected", F.lit(False)))


def first_link_match(spark, sf):
    return resolve.first_links(numbered(spark, LINK_QUERIES), page_links(spark, sf), "n")


def link_match_bulk(spark, sf):
    words = F.regexp_extract_all("text", F.lit(r"\p{L}+"), 0)
    queries = table(spark, sf, "benchmark").select(F.explode(words).alias("query"))
    return resolve.first_links(with_ids(queries), page_links(spark, sf), "n")


def known_sources(spark, sf):
    return resolve.known_sources(raw_requests(spark, sf).select("request_id", F.upper("sources").alias("source")), registry_table(spark))


def unknown_sources(spark, sf):
    return resolve.unknown_sources(raw_requests(spark, sf).select("request_id", F.upper("sources").alias("source")), registry_table(spark))


def largest_member(spark, sf):
    documents = table(spark, sf, "documents")
    return ranking.largest_per(documents, ["source"], "n_chars", "doc_id", ["doc_id", "n_chars"])


def file_tree_largest(spark, sf):
    """The largest file of each source, in a tree whose files have eleven bytes per document."""
    root = fresh_dir(spark, "tree")
    documents = table(spark, sf, "documents").select("source", "lang", F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("line"))
    documents.repartition("source", "lang").write.partitionBy("source", "lang").csv(root)
    listed = members.csv_members(spark, root)
    named = [F.regexp_extract("path", f"{level}=([^/]*)", 1).alias(name) for level, name in (("source", "archive"), ("lang", "key"))]
    return ranking.largest_per(listed.select("*", *named), ["archive"], "size", "path", ["key", "size"])


def active_keys_history(spark, sf):
    return history.keep_active(table(spark, sf, "events"), "user_id", "ts").select("user_id", "event_id", "ts", "value")


# --- alignment ----------------------------------------------------------------------


def append_target(spark, sf):
    features = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.lit(-1).alias("quality"))
    return align.append_target(features, table(spark, sf, "labels"), ["doc_id"], "quality")


def outer_concat_target(spark, sf):
    features = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    target = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return align.concat_target(features, target, ["doc_id"])


def outer_concat_rows(spark, sf):
    """Documents beside labels row by row, without a key."""
    documents = table(spark, sf, "documents").repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    labels = table(spark, sf, "labels").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
    return align.concat_by_position(documents.select("doc_id", "n_chars"), labels)


# --- text -----------------------------------------------------------------------------


def topic_slug(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.topic_slug(F.col("text")).alias("slug"))


def safe_stem(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.raw_file_name(F.col("text")).alias("file_name"))


def host_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.host_key(F.col("url")).alias("host"))


def dataset_name(spark, sf):
    path = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("_raw_v1.raw_raw.csv"))
    return table(spark, sf, "pages").select("page_id", text.dataset_name(path).alias("name"), text.dataset_name(F.col("url")).alias("url_name"))


def sheet_name(spark, sf):
    name = F.concat(F.col("c_name"), F.lit("_"), F.col("c_mktsegment"), F.lit("_çé_export"))
    return table(spark, sf, "customer").select("c_custkey", text.sheet_name(name).alias("sheet"))


def slug_collisions(spark, sf):
    parts = table(spark, sf, "part").select(
        F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("! "))).alias("query")
    )
    return compare.slug_collisions(parts, F.col("query"))


def row_limit_parse(spark, sf):
    answers = {"1-URGENT": " Y ", "2-HIGH": "yes", "3-MEDIUM": "No", "4-NOT SPECIFIED": "12.5"}
    orders = table(spark, sf, "orders")
    answer = F.coalesce(assigned(orders, answers, "o_orderpriority"), F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" ")))
    parsed = orders.select("o_orderkey", text.row_limit(answer).alias("p"))
    return parsed.select("o_orderkey", "p.action", "p.row_limit")


def zero_padded_ids(spark, sf):
    value = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("123456789012"), F.col("o_custkey").cast("string")))
    value = value.when(F.col("o_orderstatus") == "P", (-F.col("o_custkey")).cast("string")).otherwise(F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", text.zero_pad(value).alias("padded"))


def source_urls(spark, sf):
    source = F.when(F.col("c_mktsegment") == "BUILDING", "fred").when(F.col("c_mktsegment") == "MACHINERY", "sec")
    source = source.when(F.col("c_mktsegment") == "FURNITURE", "yfinance").when(F.col("c_mktsegment") == "HOUSEHOLD", "kaggle").otherwise("gopher")
    return table(spark, sf, "customer").select("c_custkey", source_url(source, F.col("c_name")).alias("url"))


def size_texts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.size_text(F.col("p_partkey") * 1000, F.col("p_size")).alias("size_info"))


def list_parse(spark, sf):
    joined = F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ,"), F.col("c_name"), F.lit(", ,X"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(text.parse_list(joined), "|").alias("parsed"))


def agent_identity(spark, sf):
    key = F.when(F.col("c_acctbal") > 5000, F.concat(F.col("c_mktsegment"), F.lit("@example.org"))).otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", text.agent_identity(key, "rawharbor").alias("agent"))


def float_texts(spark, sf):
    scaled = lambda power: text.float_text(F.col("o_totalprice") * F.lit(power))
    return table(spark, sf, "orders").select(
        "o_orderkey", scaled(1.0).alias("plain"), scaled(1024.0).alias("large"), scaled(-0.0078125).alias("negative")
    )


def percent_texts(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.percent_text(F.col("l_discount")).alias("discount"))


# --- limits, comparison, paging -----------------------------------------------------------


def row_limited(spark, sf):
    items = table(spark, sf, "lineitem")
    return ranking.head_rows(items, ["l_shipdate", *[c for c in items.columns if c != "l_shipdate"]], 5000)


def row_limited_short(spark, sf):
    items = table(spark, sf, "lineitem")
    return ranking.head_rows(items, items.columns, 500)


def capped_export(spark, sf):
    items = table(spark, sf, "lineitem")
    return ranking.capped(items, items.columns, 20_000)


def ranked_items(spark, sf):
    items = table(spark, sf, "lineitem")
    return ranking.rank_rows(items, items.columns)


def key_pages_all(spark, sf):
    """Every page of a table whose first key is repeated, put together again."""
    ranked = ranked_items(spark, sf)
    size = max(1, -(-ranked.total // 4))
    return ranked.ranked("rank").withColumn("page", F.floor(F.col("rank") / size).cast("bigint"))


def key_page_index(spark, sf):
    return ranked_items(spark, sf).pages(1_000)


def key_page_far(spark, sf):
    return ranked_items(spark, sf).page(37, 1_000)


def key_page(spark, sf):
    return ranking.key_page(table(spark, sf, "orders"), "o_orderkey", 4_000, 750)


def raw_preservation_check(spark, sf):
    events = table(spark, sf, "events")
    changed = events.withColumn("value", F.when(F.col("event_type") == "signup", F.col("value") + 1).otherwise(F.col("value")))
    changed = changed.where(F.col("event_type") != "error")
    return compare.bag_difference(events.select("event_type", "value"), changed.select("event_type", "value"))


# --- files, tables, streams ------------------------------------------------------------------


def written_and_read(spark, df, label, **kwargs):
    path = fresh_dir(spark, label)
    write_raw(df, path, kwargs.pop("compression", None))
    return delimited.scan_csv(spark, path, delimited.csv_schema(df), **RAW_CSV_READ, **kwargs)


def csv_roundtrip(spark, sf):
    return written_and_read(spark, table(spark, sf, "events"), "roundtrip")


def csv_text_roundtrip(spark, sf):
    return written_and_read(spark, table(spark, sf, "documents"), "text-roundtrip")


def csv_splitting_scan(spark, sf):
    documents, path = table(spark, sf, "documents"), fresh_dir(spark, "splitting")
    write_raw(documents, path)
    return delimited.scan_csv_splitting(spark, path, delimited.csv_schema(documents))


FILE_BYTES = 32 << 20  # text in a written file, about


def csv_stray_quotes(spark, sf):
    """Files of quoted texts with line breaks beside values that hold quotes of their own.
    Each of the four folders holds as many files, in folders of their own, as its rows need:
    one file is written by one task."""
    documents, path = table(spark, sf, "documents"), fresh_dir(spark, "stray")
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = size // (4 * FILE_BYTES) + 1
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    stray = F.concat(F.col("n_chars").cast("string"), F.lit('" wide'))
    part = F.pmod("doc_id", F.lit(4)).cast("int")
    piece = F.pmod(F.monotonically_increasing_id(), F.lit(pieces)).cast("int")
    record = F.concat_ws(",", F.col("doc_id").cast("string"), stray, quoted, F.concat("lang", F.lit('"a,"b"')))
    rows = documents.select(part.alias("part"), piece.alias("piece"), F.lit(1).alias("place"), record.alias("value"))
    heads = spark.range(4 * pieces).select(
        F.pmod("id", F.lit(4)).cast("int").alias("part"),
        F.floor(F.col("id") / 4).cast("int").alias("piece"),
        F.lit(0).alias("place"),
        F.lit("doc_id,size,text,mark,more").alias("value"),
    )
    files = rows.unionByName(heads).repartition(4 * pieces, "part", "piece").sortWithinPartitions("part", "piece", "place").drop("place")
    files.write.partitionBy("part", "piece").text(path)
    return delimited.scan_csv_splitting(spark, path, T.StructType.fromDDL("doc_id bigint, size string, text string, mark string, more string"))


def csv_roundtrip_diff(spark, sf):
    events = table(spark, sf, "events")
    return compare.bag_difference(events, written_and_read(spark, events, "roundtrip-diff"))


def gzip_csv_scan(spark, sf):
    return written_and_read(spark, table(spark, sf, "orders"), "gzip", compression="gzip")


def csv_inferred_scan(spark, sf):
    path = fresh_dir(spark, "inferred")
    write_raw(events_as_text(spark, sf), path)
    return delimited.scan_csv_inferred(spark, path, multiline=False)


def raw_layout(spark, sf):
    root = fresh_dir(spark, "layout")
    documents = table(spark, sf, "documents").withColumn("host", F.concat(F.lit("https://WWW."), F.col("source"), F.lit("/a")))
    topics = documents.drop("source").withColumn("topic", F.concat(F.lit("Topic "), F.col("lang")))
    write_raw_batch(topics, root, "host", "topic")
    landed = delimited.scan_csv(spark, root)
    return landed.groupBy("source", "format", "topic").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("text").cast("bigint")).alias("chars")
    )


def ingest_run(spark, sf):
    landed, out = fresh_dir(spark, "landed"), fresh_dir(spark, "ingested")
    orders = table(spark, sf, "orders")
    write_raw(orders, landed)
    request = Request("yfinance", "Order History!", landed, {"multiline": False}, row_limit=3_000, order_by=["o_orderkey"])
    return delimited.scan_csv(spark, ingest(spark, request, out), delimited.csv_schema(orders), **RAW_CSV_READ)


def ingest_batch(spark, sf):
    """A batch of runs at once: tables that pass, one that is nearly all missing, one that is not there."""
    out, requests = fresh_dir(spark, "batch"), []
    for name in ("orders", "customer", "part"):
        path = fresh_dir(spark, f"landed-{name}")
        write_raw(table(spark, sf, name), path)
        requests.append(Request("airbnb", name, path, {"multiline": False}))
    sparse, missing = fresh_dir(spark, "landed-sparse"), [F.lit(None).cast("string").alias(f"m{i}") for i in range(9)]
    write_raw(table(spark, sf, "supplier").select("s_suppkey", *missing), sparse)
    requests += [Request("yfinance", "sparse", sparse, {"multiline": False}), Request("yfinance", "absent", out + "/absent")]
    results = ingest_all(spark, requests, out)
    rows = [delimited.scan_csv(spark, r.csv_path, multiline=False).select(F.lit(r.request.topic).alias("topic")) for r in results if r.csv_path]
    counted = reduce(DataFrame.unionByName, rows).groupBy("topic").agg(F.count(F.lit(1)).alias("rows"))
    ran = small_table(spark, [(i, r.request.topic, r.status) for i, r in enumerate(results)], "number bigint, topic string, status string")
    return ran.join(counted, "topic", "left")


def export_all_sheets(spark, sf):
    items, path = table(spark, sf, "lineitem"), fresh_dir(spark, "sheets")
    export_sheets(items, path, items.columns, 25_000)
    schema = delimited.csv_schema(items).add("sheet", "long")
    return delimited.scan_csv(spark, f"{path}/rows", schema, multiline=False, **RAW_CSV_READ)


def export_sheet(spark, sf):
    customer, path = table(spark, sf, "customer"), fresh_dir(spark, "export")
    truncated = export(customer, path, ["c_custkey"], 1_200)
    rows = delimited.scan_csv(spark, f"{path}/rows", delimited.csv_schema(customer))
    return rows.withColumn("truncated", F.lit(truncated))


def ingest_literal(spark, sf):
    """Long ids, leading and trailing zeros come through a run as they are written."""
    landed, out = fresh_dir(spark, "landed"), fresh_dir(spark, "ingested")
    orders = table(spark, sf, "orders")
    id_text = F.concat(F.lit("1234567890"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))
    rows = orders.select(
        id_text.alias("id"),
        F.concat(F.lit("00"), F.col("o_custkey").cast("string")).alias("code"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(".500")).alias("price"),
    )
    write_raw(rows, landed)
    return delimited.scan_csv(spark, ingest(spark, Request("airbnb", "Literal Orders", landed), out))


def published_table(spark, sf):
    path = fresh_dir(spark, "published")
    name = f"published_{path.rsplit('-', 1)[1]}"
    publish_table(table(spark, sf, "part"), name, path)
    return spark.table(name)


def publish_run(spark, sf):
    """From a raw file to a table of typed columns and its sheets, read back from both."""
    path, out = fresh_dir(spark, "publish"), fresh_dir(spark, "published")
    part = table(spark, sf, "part")
    write_raw(part, path)
    done = publish(spark, path, ["p_partkey"], f"published_{path.rsplit('-', 1)[1]}", out)
    sheets = delimited.scan_csv(spark, f"{done['export']}/rows", delimited.csv_schema(part).add("sheet", "long"), multiline=False)
    return spark.table(done["table"]).join(sheets.select("p_partkey", "sheet", F.col("p_name").alias("exported")), "p_partkey")


def loaded_chunks(spark, sf):
    source, target = fresh_dir(spark, "chunks"), fresh_dir(spark, "loaded")
    events = table(spark, sf, "events")
    write_raw(events.repartition(6, "event_id"), source)
    query = load_landed(
        spark, source, delimited.csv_schema(events), target, fresh_dir(spark, "progress"), files_per_batch=2, multiline=False
    )
    query.awaitTermination()
    return target


def chunked_table_load(spark, sf):
    return read_accepted(spark, loaded_chunks(spark, sf)).drop("batch")


def chunk_verdicts(spark, sf):
    verdicts = read_verdicts(spark, loaded_chunks(spark, sf))
    return verdicts.groupBy("status").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("batches"))


def rate_audit_hourly(spark, sf):
    return rate_audit(table(spark, sf, "events"), "ts", 17, "1 hour")


def rate_audit_by_key(spark, sf):
    return rate_audit(table(spark, sf, "events"), "ts", 1, "1 minute", ["event_type"])


def rolling_rate_all(spark, sf):
    return rolling_rate(table(spark, sf, "events"), "ts", 4, 600_000_000)


def rolling_rate_by_key(spark, sf):
    return rolling_rate(table(spark, sf, "events"), "ts", 1, 60_000_000, ["event_type"])


# --- requests --------------------------------------------------------------------------------


def raw_requests(spark, sf):
    lists = {
        "ECONOMY": "all", "SMALL": " SEC , kaggle", "MEDIUM": "sec", "PROMO": " ", "STANDARD": "myspace,fred", "LARGE": "yfinance",
    }
    part = table(spark, sf, "part")
    topic = F.when(F.col("p_size") < 10, F.concat(F.col("p_name"), F.lit(" Video Game"))).when(F.col("p_size") == 25, "  ").otherwise(F.col("p_name"))
    return part.select(F.col("p_partkey").alias("request_id"), assigned(part, lists, "p_type").alias("sources"), topic.alias("topic"))


def request_plan(spark, sf):
    return plan_requests(raw_requests(spark, sf), registry_table(spark)).withColumn("position", F.col("position").cast("bigint"))


def request_plan_dropped(spark, sf):
    planned = plan_requests(raw_requests(spark, sf), registry_table(spark), drop_unrelated=True)
    return planned.groupBy("source", "warned", "status").agg(F.count(F.lit(1)).alias("requests"))


def data_paths(spark, sf):
    folder = F.when(F.col("lang") == "en", "/data/").when(F.col("lang") == "fr", "/src/").otherwise("/raw/")
    suffix = F.when(F.col("n_chars") > 2000, ".csv").when(F.col("n_chars") > 1000, ".xlsx").otherwise(".py")
    path = F.concat(F.col("source"), folder, F.col("doc_id").cast("string"), suffix)
    return table(spark, sf, "documents").select("doc_id", path.alias("path")).where(members.in_data_folder(F.col("path")))


def user_tables(spark, sf):
    name = F.concat(F.when(F.col("p_size") < 20, "dolt_").otherwise("Dolt_"), F.replace("p_name", F.lit(" "), F.lit("_")))
    return table(spark, sf, "part").select("p_partkey", name.alias("name")).where(members.user_table(F.col("name")))


def missing_columns(spark, sf):
    wanted = table(spark, sf, "documents").select(F.concat(F.lit("p_"), F.col("lang")).alias("column"))
    wanted = wanted.union(table(spark, sf, "part").select(F.concat(F.lit("p_"), F.substring_index("p_name", " ", 1))))
    wanted = wanted.union(table(spark, sf, "region").select(F.lit("p_size")))
    return resolve.missing_columns(wanted.distinct(), table(spark, sf, "part"))


QUERIES = {
    f.__name__: f
    for f in (
        data_dictionary, description_text, null_density_gate, gate_threshold_edges, passed_rows_only, batch_outcome,
        column_widths, column_widths_missing, infer_types, na_tokens,
        facts_flatten, facts_literal, observations_flatten, observation_rejects, keyed_object_scan, id_index_lookup,
        page_links, html_table_rows,
        catalog_best_match, catalog_match_bulk, first_link_match, link_match_bulk, known_sources, unknown_sources,
        largest_member, file_tree_largest, active_keys_history, append_target, outer_concat_target, outer_concat_rows,
        topic_slug, safe_stem, host_key, dataset_name, sheet_name, slug_collisions, row_limit_parse, zero_padded_ids,
        source_urls, size_texts, list_parse, agent_identity, float_texts, percent_texts,
        row_limited, row_limited_short, capped_export, key_page, key_pages_all, key_page_index, key_page_far, raw_preservation_check,
        csv_roundtrip, csv_text_roundtrip, csv_splitting_scan, csv_stray_quotes, csv_roundtrip_diff, gzip_csv_scan, csv_inferred_scan, raw_layout,
        ingest_run, ingest_literal, ingest_batch, export_sheet, export_all_sheets, published_table, publish_run,
        chunked_table_load, chunk_verdicts, rate_audit_hourly, rate_audit_by_key, rolling_rate_all, rolling_rate_by_key,
        request_plan, request_plan_dropped, data_paths, user_tables, missing_columns,
    )
}
