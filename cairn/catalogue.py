"""The registered queries of the engine's own operators, each with its SQL.

``events`` serves as change log: the key comes from the user, the sequence number is
the event id, and an error event deletes.  ``customer``, ``orders`` and ``part`` serve
as typed collections and ``events.props`` as a JSON collection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import values
from cairn.operators import indexes, updates, versions
from cairn.operators.filters import Eq, Exists, Gt, In, JsonFields, Lt, TypedFields, forced_match
from cairn.operators.percentiles import floor_percentile
from cairn.plans.query import Query
from cairn.sources import formats
from cairn.sources.scratch import scratch_dir
from cairn.sources.segments import SegmentStore
from cairn.streaming import ingest

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("key"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") != "error", F.col("props")).alias("value"),
    )


LOG = "WITH log AS (SELECT 'user:' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value FROM events)"


def latest_sql(where: str = "true", after: str = "true", name: str = "live") -> str:
    """The newest version by row number; ``where`` is on the log, ``after`` on the result."""
    return (
        f"{name} AS (SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS nth FROM log WHERE {where}) "
        f"WHERE nth = 1 AND value IS NOT NULL AND {after})"
    )


def query(name: str, sql: str | None = None):
    def add(run: Run) -> Run:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def live(where: str = "true", after: str = "true") -> str:
    return f"{LOG}, {latest_sql(where, after)} SELECT key, seq, value FROM live"


# ---- key-value reads -------------------------------------------------------


@query("kv_get", live("key = 'user:00000010'"))
def kv_get(spark, d):
    return versions.get(log(spark, d), "user:00000010")


@query("kv_get_deleted", live("key = 'user:00000008'"))
def kv_get_deleted(spark, d):
    return versions.get(log(spark, d), "user:00000008")


@query("kv_snapshot_get", live("key = 'user:00000008' AND seq < 5000"))
def kv_snapshot_get(spark, d):
    return versions.get(log(spark, d), "user:00000008", before=5000)


@query("kv_scan_all", live())
def kv_scan_all(spark, d):
    return versions.scan(log(spark, d))


@query("kv_scan_range", live("key >= 'user:00000010' AND key < 'user:00000020'"))
def kv_scan_range(spark, d):
    return versions.scan(log(spark, d), "user:00000010", "user:00000020")


@query("kv_scan_start_only", live("key >= 'user:00000100'"))
def kv_scan_start_only(spark, d):
    return versions.scan(log(spark, d), start="user:00000100")


@query("kv_scan_end_only", live("key < 'user:00000050'"))
def kv_scan_end_only(spark, d):
    return versions.scan(log(spark, d), end="user:00000050")


@query("kv_scan_prefix", live("starts_with(key, 'user:0000001')"))
def kv_scan_prefix(spark, d):
    return versions.scan_prefix(log(spark, d), "user:0000001")


@query("kv_scan_snapshot", live("seq < 5000"))
def kv_scan_snapshot(spark, d):
    return versions.scan(log(spark, d), before=5000)


@query("kv_value_filter", live(after="value LIKE '%3%'"))
def kv_value_filter(spark, d):
    """A filter on the value stands above the newest version, never below."""
    return versions.latest(log(spark, d)).where(F.contains("value", F.lit("3")))


@query("kv_compact", live())
def kv_compact(spark, d):
    return versions.compact(log(spark, d))


@query(
    "kv_compact_retain",
    f"{LOG}, {latest_sql('seq < 5000')} SELECT key, seq, value FROM log WHERE seq >= 5000 UNION ALL SELECT key, seq, value FROM live",
)
def kv_compact_retain(spark, d):
    return versions.compact(log(spark, d), retain=5000)


@query(
    "segment_stats",
    f"{LOG} SELECT seq // 1000 AS segment, count(*) AS entries, count(*) FILTER (WHERE value IS NULL) AS deletions, min(seq) AS min_seq, max(seq) AS max_seq, min(key) AS min_key, max(key) AS max_key FROM log GROUP BY 1",
)
def segment_stats(spark, d):
    return versions.segment_stats(log(spark, d), F.expr("seq div 1000"))


@query("kv_memory_size", f"{LOG} SELECT CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 8) AS BIGINT) AS bytes FROM log")
def kv_memory_size(spark, d):
    return log(spark, d).agg(F.sum(values.entry_size(F.col("key"), F.col("value"))).alias("bytes"))


# ---- transactions ----------------------------------------------------------

BUFFER_SQL = "buffer AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS nth FROM log WHERE seq BETWEEN 9000 AND 9100) WHERE nth = 1)"
OVERLAY_SQL = f"{LOG}, {latest_sql('seq < 5000')}, {BUFFER_SQL}, seen AS (SELECT key, value FROM buffer UNION ALL SELECT key, value FROM live WHERE key NOT IN (SELECT key FROM buffer))"


def buffered(spark, d):
    ops = log(spark, d).where("seq BETWEEN 9000 AND 9100")
    return versions.last_writes(ops.withColumnRenamed("seq", "op"))


@query("txn_scan_overlay", f"{OVERLAY_SQL} SELECT key, value FROM seen WHERE value IS NOT NULL")
def txn_scan_overlay(spark, d):
    return versions.overlay(versions.scan(log(spark, d), before=5000), buffered(spark, d))


@query("txn_scan_range", f"{OVERLAY_SQL} SELECT key, value FROM seen WHERE value IS NOT NULL AND key >= 'user:00000020' AND key < 'user:00000090'")
def txn_scan_range(spark, d):
    start, end = "user:00000020", "user:00000090"
    return versions.overlay(versions.scan(log(spark, d), start, end, 5000), versions.between(buffered(spark, d), start, end))


@query("txn_get", f"{OVERLAY_SQL} SELECT key, value FROM seen WHERE value IS NOT NULL AND key = 'user:00000010'")
def txn_get(spark, d):
    one = F.col("key") == "user:00000010"
    return versions.overlay(versions.get(log(spark, d), "user:00000010", 5000), buffered(spark, d).where(one))


@query("txn_commit_scan", f"{OVERLAY_SQL} SELECT s.key, CASE WHEN b.key IS NULL THEN l.seq ELSE 10000 END AS seq, s.value FROM seen s LEFT JOIN buffer b ON s.key = b.key LEFT JOIN live l ON s.key = l.key WHERE s.value IS NOT NULL")
def txn_commit_scan(spark, d):
    return versions.latest(versions.committed(log(spark, d).where("seq < 5000"), buffered(spark, d), 10_000))


# ---- documents: reads, filters, order --------------------------------------

CUSTOMER = "SELECT * FROM customer"


def customers(spark, d) -> Query:
    return Query(table(spark, d, "customer"), id_col="c_custkey")


@query("doc_get_by_id", f"{CUSTOMER} WHERE c_custkey = 42")
def doc_get_by_id(spark, d):
    return customers(spark, d).filter(Eq("c_custkey", 42)).matching()


@query("doc_scan", CUSTOMER)
def doc_scan(spark, d):
    return customers(spark, d).execute()


@query("filter_eq", f"{CUSTOMER} WHERE c_mktsegment = 'BUILDING'")
def filter_eq(spark, d):
    return customers(spark, d).filter(Eq("c_mktsegment", "BUILDING")).execute()


@query("filter_eq_type", f"{CUSTOMER} WHERE false")
def filter_eq_type(spark, d):
    """An integer field never equals a string."""
    return customers(spark, d).filter(Eq("c_nationkey", "7")).execute()


@query("filter_gt_num", f"{CUSTOMER} WHERE c_acctbal > 5000")
def filter_gt_num(spark, d):
    return customers(spark, d).filter(Gt("c_acctbal", 5000)).execute()


@query("filter_gt_str", f"{CUSTOMER} WHERE c_name > 'Customer#000000500'")
def filter_gt_str(spark, d):
    return customers(spark, d).filter(Gt("c_name", "Customer#000000500")).execute()


@query("filter_lt_num", f"{CUSTOMER} WHERE c_acctbal < 0")
def filter_lt_num(spark, d):
    return customers(spark, d).filter(Lt("c_acctbal", 0)).execute()


@query("filter_lt_str", f"{CUSTOMER} WHERE c_mktsegment < 'FURNITURE'")
def filter_lt_str(spark, d):
    return customers(spark, d).filter(Lt("c_mktsegment", "FURNITURE")).execute()


@query("filter_in", f"{CUSTOMER} WHERE c_nationkey IN (1, 5, 9)")
def filter_in(spark, d):
    return customers(spark, d).filter(In("c_nationkey", (1, 5, 9))).execute()


@query("filter_in_empty", f"{CUSTOMER} WHERE false")
def filter_in_empty(spark, d):
    return customers(spark, d).filter(In("c_nationkey", ())).execute()


def props(spark, d) -> Query:
    return Query(table(spark, d, "events").select("event_id", "props"), JsonFields("props"), "event_id")


PROPS = "SELECT event_id, props FROM events"


@query("filter_exists_json", f"{PROPS} WHERE list_contains(json_keys(props), 'k')")
def filter_exists_json(spark, d):
    return props(spark, d).filter(Exists("k")).execute()


@query("filter_exists_json_missing", f"{PROPS} WHERE list_contains(json_keys(props), 'nothing')")
def filter_exists_json_missing(spark, d):
    return props(spark, d).filter(Exists("nothing")).execute()


@query("json_field_gt", f"{PROPS} WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50")
def json_field_gt(spark, d):
    return props(spark, d).filter(Gt("k", 50)).execute()


@query("json_field_eq", f"{PROPS} WHERE json_extract_string(props, '$.k') = '30'")
def json_field_eq(spark, d):
    return props(spark, d).filter(Eq("k", 30)).execute()


@query("json_field_in", f"{PROPS} WHERE json_extract_string(props, '$.k') IN ('3', '30')")
def json_field_in(spark, d):
    return props(spark, d).filter(In("k", (3, 30))).execute()


@query("json_sort_limit", f"{PROPS} ORDER BY CAST(json_extract_string(props, '$.k') AS DOUBLE) DESC, event_id LIMIT 25")
def json_sort_limit(spark, d):
    return props(spark, d).sort("k", descending=True).limit(25).execute()


@query("and_chain", f"{CUSTOMER} WHERE c_acctbal > 1000 AND c_acctbal < 3000 AND c_mktsegment = 'MACHINERY' AND c_name IS NOT NULL")
def and_chain(spark, d):
    return customers(spark, d).filter(Gt("c_acctbal", 1000)).filter(Lt("c_acctbal", 3000)).filter(Eq("c_mktsegment", "MACHINERY")).filter(Exists("c_name")).execute()


def orders(spark, d) -> Query:
    return Query(table(spark, d, "orders"), id_col="o_orderkey")


ORDERS = "SELECT * FROM orders"


@query("sort_asc_limit", f"{ORDERS} ORDER BY o_totalprice NULLS FIRST, o_orderkey LIMIT 20")
def sort_asc_limit(spark, d):
    return orders(spark, d).sort("o_totalprice").limit(20).execute()


@query("sort_desc_limit", f"{ORDERS} ORDER BY o_orderpriority DESC NULLS LAST, o_orderkey LIMIT 20")
def sort_desc_limit(spark, d):
    """Ties keep the order of ids downwards as well."""
    return orders(spark, d).sort("o_orderpriority", descending=True).limit(20).execute()


@query("sort_skip_limit", f"{ORDERS} WHERE o_totalprice > 1000 ORDER BY o_custkey NULLS FIRST, o_orderkey LIMIT 30 OFFSET 15")
def sort_skip_limit(spark, d):
    return orders(spark, d).filter(Gt("o_totalprice", 1000)).sort("o_custkey").skip(15).limit(30).execute()


@query("skip_only", f"{CUSTOMER} ORDER BY c_custkey OFFSET 10")
def skip_only(spark, d):
    return customers(spark, d).skip(10).execute()


@query("limit_zero", f"{CUSTOMER} WHERE false")
def limit_zero(spark, d):
    return customers(spark, d).limit(0).execute()


# ---- indexes ---------------------------------------------------------------


@query("index_entries", "SELECT c_custkey AS id, coalesce(CAST(c_nationkey AS VARCHAR), 'null') AS value FROM customer")
def index_entries(spark, d):
    return indexes.index(table(spark, d, "customer"), F.col("c_nationkey"), "c_custkey")


@query("index_get_unique", f"{CUSTOMER} WHERE c_name = 'Customer#000000007'")
def index_get_unique(spark, d):
    return indexes.lookup(table(spark, d, "customer"), F.col("c_name"), "Customer#000000007")


@query("index_get_exact", f"{CUSTOMER} WHERE coalesce(CAST(c_nationkey AS VARCHAR), 'null') = '2'")
def index_get_exact(spark, d):
    return indexes.lookup(table(spark, d, "customer"), F.col("c_nationkey"), "2")


@query("index_get_prefix", f"{CUSTOMER} WHERE starts_with(coalesce(CAST(c_nationkey AS VARCHAR), 'null'), '2')")
def index_get_prefix(spark, d):
    return indexes.lookup(table(spark, d, "customer"), F.col("c_nationkey"), "2", prefix=True)


@query("index_join", f"{CUSTOMER} WHERE c_nationkey = 3")
def index_join(spark, d):
    """The lookup by way of the index's own rows."""
    docs = table(spark, d, "customer")
    entries = indexes.index(docs, F.col("c_nationkey"), "c_custkey").where("value = '3'")
    return indexes.fetch(entries, docs, "c_custkey")


@query("doc_forced_match", f"{CUSTOMER} WHERE lower(c_mktsegment) = lower('BuIlDiNg')")
def doc_forced_match(spark, d):
    docs = table(spark, d, "customer")
    return forced_match(docs, TypedFields(docs), "c_mktsegment", "BuIlDiNg")


FIRST = "f AS (SELECT coalesce(CAST(o_custkey AS VARCHAR), 'null') AS value, min(o_orderkey) AS first_id FROM orders GROUP BY 1)"


@query("unique_violations", f"WITH {FIRST} SELECT o_orderkey, f.value FROM orders o JOIN f ON coalesce(CAST(o_custkey AS VARCHAR), 'null') = f.value WHERE o_orderkey <> first_id")
def unique_violations(spark, d):
    batch = table(spark, d, "orders")
    return indexes.violations(batch, batch.limit(0), F.col("o_custkey"), "o_orderkey").select("o_orderkey", "value")


@query("insert_accept", f"WITH {FIRST} SELECT first_id AS o_orderkey FROM f")
def insert_accept(spark, d):
    batch = table(spark, d, "orders")
    refused = indexes.violations(batch, batch.limit(0), F.col("o_custkey"), "o_orderkey")
    return batch.join(refused, "o_orderkey", "left_anti").select("o_orderkey")


# ---- writes ----------------------------------------------------------------


@query("delete_by_id", f"{CUSTOMER} WHERE c_custkey NOT IN (3, 5, 8, 13)")
def delete_by_id(spark, d):
    return updates.delete(table(spark, d, "customer"), spark.createDataFrame([(3,), (5,), (8,), (13,)], "c_custkey long"), "c_custkey")


@query("delete_by_prefix", live(after="NOT starts_with(key, 'user:0000001')"))
def delete_by_prefix(spark, d):
    rows = log(spark, d)
    return versions.latest(rows.unionByName(versions.without_prefix(rows, "user:0000001", 10_000_000)))


@query("delete_by_range", live(after="NOT (key >= 'user:00000020' AND key < 'user:00000040')"))
def delete_by_range(spark, d):
    rows = log(spark, d)
    return versions.latest(rows.unionByName(versions.without_range(rows, "user:00000020", "user:00000040", 10_000_000)))


UPSERT = "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer"


@query("upsert_merge", UPSERT)
def upsert_merge(spark, d):
    base = table(spark, d, "customer")
    batch = base.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return updates.upsert(base, batch, "c_custkey")


@query("update_many", "SELECT c_custkey, CASE WHEN c_nationkey = 5 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_many(spark, d):
    return updates.set_where(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("c_nationkey") == 5, {"c_mktsegment": F.lit("MOVED")}).drop("c_nationkey")


@query("inc_field", "SELECT p_partkey, CAST(p_size + 5 AS INTEGER) AS p_size FROM part")
def inc_field(spark, d):
    return updates.increment(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", 5)


@query("unset_field", "SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part")
def unset_field(spark, d):
    return updates.unset(table(spark, d, "part"), ["p_retailprice"])


@query("push_value", "SELECT c_custkey, c_mktsegment || '|' || c_name AS tags FROM customer")
def push_value(spark, d):
    docs = table(spark, d, "customer").withColumn("list", F.array("c_mktsegment"))
    return updates.push(docs, "list", F.col("c_name")).select("c_custkey", F.array_join("list", "|").alias("tags"))


@query(
    "replace_versioned",
    "SELECT c_custkey, CAST(CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 <> 0 THEN 2 ELSE 1 END AS BIGINT) AS _v, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 <> 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer",
)
def replace_versioned(spark, d):
    base = table(spark, d, "customer").select("c_custkey", F.lit(1).cast("long").alias("_v"), "c_mktsegment")
    batch = base.where("c_custkey % 4 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"), F.when(F.col("c_custkey") % 8 == 0, 7).otherwise(1).alias("expected"))
    return updates.replace_versioned(base, batch, "c_custkey")[0]


# ---- aggregates, validation, functions -------------------------------------

for kind, column, sql in (
    ("count", None, "count(*) AS count"),
    ("sum", "o_totalprice", "sum(o_totalprice) AS sum"),
    ("avg", "o_totalprice", "avg(o_totalprice) AS avg"),
    ("min", "o_totalprice", "min(o_totalprice) AS min"),
    ("max", "o_totalprice", "max(o_totalprice) AS max"),
):
    if kind in ("sum", "avg"):  # rounded: the order of additions differs

        def aggregated(spark, d, kind=kind, column=column):
            return orders(spark, d).filter(Gt("o_custkey", 100)).aggregate(kind, column).select(F.round(kind, 2).alias(kind))

        sql = f"round({sql.split(' AS ')[0]}, 2) AS {kind}"
    else:

        def aggregated(spark, d, kind=kind, column=column):
            return orders(spark, d).filter(Gt("o_custkey", 100)).aggregate(kind, column)

    query(f"agg_{kind}", f"SELECT {sql} FROM orders WHERE o_custkey > 100")(aggregated)

RULES = [updates.Rule("c_acctbal", required=True, least=0, most=9000), updates.Rule("c_name", min_length=10, max_length=18, pattern="[02468]$"), updates.Rule("c_mktsegment", one_of=["BUILDING", "MACHINERY"])]


@query(
    "schema_violations",
    """SELECT c_custkey, 'c_acctbal' AS field, 'min' AS rule FROM customer WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'c_acctbal', 'max' FROM customer WHERE c_acctbal > 9000
UNION ALL SELECT c_custkey, 'c_acctbal', 'required' FROM customer WHERE c_acctbal IS NULL
UNION ALL SELECT c_custkey, 'c_name', 'min_length' FROM customer WHERE length(c_name) < 10
UNION ALL SELECT c_custkey, 'c_name', 'max_length' FROM customer WHERE length(c_name) > 18
UNION ALL SELECT c_custkey, 'c_name', 'pattern' FROM customer WHERE NOT regexp_matches(c_name, '[02468]$')
UNION ALL SELECT c_custkey, 'c_mktsegment', 'enum' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""",
)
def schema_violations(spark, d):
    return updates.schema_violations(table(spark, d, "customer"), "c_custkey", RULES)


@query("latency_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    ranks = [values.nearest_rank("value", p).alias(f"p{int(100 * p)}") for p in (0.5, 0.9, 0.99)]
    return table(spark, d, "events").groupBy("event_type").agg(*ranks)


@query("floor_percentiles", "SELECT l_returnflag, l_linestatus, list_sort(list(l_extendedprice))[CAST(floor(count(*) * 0.9) AS BIGINT) + 1] AS p90 FROM lineitem GROUP BY 1, 2")
def floor_percentiles(spark, d):
    return floor_percentile(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.9, "p90")


@query("decade_bucket", "SELECT CAST(p_size // 10 * 10 AS INTEGER) AS decade, count(*) AS n FROM part GROUP BY 1")
def decade_bucket(spark, d):
    return table(spark, d, "part").groupBy(values.decade(F.col("p_size")).alias("decade")).agg(F.count(F.lit(1)).alias("n"))


@query("joined_keys", "SELECT 'customer:doc:' || c_custkey AS key FROM customer")
def joined_keys(spark, d):
    return table(spark, d, "customer").select(values.joined_key("customer", "doc", F.col("c_custkey")).alias("key"))


@query("value_texts", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS number, lower(o_orderpriority) AS folded FROM orders")
def value_texts(spark, d):
    return table(spark, d, "orders").select("o_orderkey", values.value_text(F.col("o_custkey")).alias("number"), values.folded_text(F.col("o_orderpriority")).alias("folded"))


@query("strip_system", "SELECT c_custkey, c_name FROM customer")
def strip_system(spark, d):
    docs = updates.stamped(table(spark, d, "customer").select("c_custkey", "c_name"), F.lit(0).cast(T.LongType()))
    return updates.without_system(updates.restamped(docs, F.lit(1).cast(T.LongType())))


@query("update_path", "SELECT c_custkey, c_nationkey + 100 AS nation, c_name AS name FROM customer")
def update_path(spark, d):
    docs = table(spark, d, "customer").select("c_custkey", F.struct(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name")).alias("who"))
    return updates.set_path(docs, "who.nation", F.col("who.nation") + 100).select("c_custkey", "who.*")


# ---- storage ---------------------------------------------------------------


@query("store_compacted", live())
def store_compacted(spark, d):
    """The log in three segments, compacted, reopened and read."""
    path = scratch_dir(spark, "store")
    store, rows = SegmentStore(spark, path, "string", "string"), log(spark, d)
    for part in range(3):
        store.append(rows.where(F.pmod("seq", F.lit(3)) == part), 10_000_000)
    store.replace(versions.compact(store.log()))
    return versions.latest(SegmentStore(spark, path, "string", "string").log())


def through_files(spark, d, name: str) -> DataFrame:
    formats.register(spark)
    path = scratch_dir(spark, name)
    log(spark, d).select(F.col("key").cast("binary").alias("key"), "seq", F.col("value").cast("binary").alias("value")).repartition(4, "key").write.format(name).mode("append").save(path)
    back = spark.read.format(name).load(path)
    return versions.latest(back).select(F.col("key").cast("string").alias("key"), "seq", F.col("value").cast("string").alias("value"))


@query("runs_round_trip", live())
def runs_round_trip(spark, d):
    return through_files(spark, d, "cairn_runs")


@query("log_round_trip", live())
def log_round_trip(spark, d):
    return through_files(spark, d, "cairn_log")


@query("stream_ingest", live().replace("SELECT key, seq, value FROM live", "SELECT key, value FROM live"))
def stream_ingest(spark, d):
    """The log written as files, taken in by a stream, and read from the store."""
    path = scratch_dir(spark, "stream")
    log(spark, d).withColumnRenamed("seq", "op").write.parquet(f"{path}/in")
    store = SegmentStore(spark, f"{path}/store", "string", "string")
    changes = spark.readStream.schema("key string, op long, value string").parquet(f"{path}/in")
    ingest.writer(changes, store).option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start().awaitTermination()
    return versions.latest(store.log()).select("key", "value")


# DuckDB has no CRC-32: tested against zlib on the whole table


@query("bloom_positions")
def bloom_positions(spark, d):
    return log(spark, d).select("key").distinct().select("key", values.bloom_positions(F.col("key")).alias("positions"))


def hundredths(whole: str) -> str:
    """A count of hundredths as text with two decimals."""
    return f"CAST(({whole}) // 100 AS VARCHAR) || '.' || lpad(CAST(({whole}) % 100 AS VARCHAR), 2, '0')"


@query(
    "duration_texts",
    f"""
WITH n AS (SELECT event_id, CAST(round(abs(value) * 1000) AS BIGINT) AS ns, CAST(round(abs(value) * 10000) AS BIGINT) AS h FROM events)
SELECT event_id,
       CASE WHEN ns < 1000 THEN CAST(ns AS VARCHAR) || ' ns'
            WHEN ns < 1000000 THEN {hundredths('(ns + 5) // 10')} || ' µs'
            WHEN ns < 1000000000 THEN {hundredths('(ns + 5000) // 10000')} || ' ms'
            ELSE {hundredths('(ns + 5000000) // 10000000')} || ' s' END AS duration,
       CASE WHEN h >= 100000000 THEN {hundredths('(h + 500000) // 1000000')} || ' M/s'
            WHEN h >= 100000 THEN {hundredths('(h + 500) // 1000')} || ' K/s'
            ELSE {hundredths('h')} || ' /s' END AS rate
FROM n""",
)
def duration_texts(spark, d):
    cents = F.round(F.abs("value") * 10_000).cast("long")
    return table(spark, d, "events").select("event_id", values.duration_text(F.round(F.abs("value") * 1000).cast("long")).alias("duration"), values.rate_text(cents / 100).alias("rate"))
