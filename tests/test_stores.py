"""Tables, collections, transactions, formats, streams and the shell."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from cairn import errors
from cairn.cli import Shell
from cairn.functions import values
from cairn.operators import indexes, updates
from cairn.operators.filters import Eq, Exists, Gt, In, JsonFields, Lt, TypedFields
from cairn.plans.docstore import DocStore
from cairn.plans.kvtable import KVTable
from cairn.plans.query import Query
from cairn.sources import formats
from cairn.sources.segments import SegmentStore
from cairn.streaming import ingest


def items(table, **where):
    return list(table.items(**where))


def test_table_persists_and_reopens(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    t = KVTable(spark, path)
    for i in range(10):
        t.put(f"k{i}", f"v{i}")
    t.delete("k3")
    t.put(b"\x00\x01\xff\xfe", "键".encode())
    t.close()
    t = KVTable(spark, path)
    t.put("k4", "new")
    assert t.get("k3") is None and t.get("k4") == b"new" and t.get(b"\x00\x01\xff\xfe") == "键".encode()
    assert [k for k, _ in items(t, start="k1", end="k6")] == [b"k1", b"k2", b"k4", b"k5"]
    t.flush()
    before = items(t)
    t.compact()
    assert items(t) == before and t.store.log().count() == len(before)
    assert len(t.store.vacuum()) == 2
    t.delete_prefix("k")
    assert [k for k, _ in items(t)] == [b"\x00\x01\xff\xfe"]
    assert t.stats().count() == 2


def test_transactions(spark, tmp_path):
    t = KVTable(spark, f"file://{tmp_path}/t")
    t.put("key1", "1")
    t.put("key2", "2")
    first = t.begin()
    t.put("key1", "later")
    t.delete("key2")
    assert first.get("key1") == b"1" and first.get("key2") == b"2"
    first.put("key1", "x")
    first.delete("key1")
    first.put("key3", "3")
    assert first.get("key1") is None
    assert [(bytes(r["key"]), bytes(r["value"])) for r in first.scan().collect()] == [(b"key2", b"2"), (b"key3", b"3")]
    second = t.begin()
    second.put("key3", "last")
    first.commit()
    second.commit()
    assert t.get("key3") == b"last" and t.get("key1") is None
    with pytest.raises(errors.TransactionClosed):
        first.put("a", "b")
    third = t.begin()
    third.put("never", "seen")
    third.abort()
    assert t.get("never") is None


def test_two_writers_conflict(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    a, b = SegmentStore(spark, path, "string", "string"), SegmentStore(spark, path, "string", "string")
    rows = spark.createDataFrame([("k", "v")], "key string, value string")
    a.append_at_once(rows)
    with pytest.raises(errors.CommitConflict):
        b.append_at_once(rows)
    b.reload()
    assert b.append_at_once(rows) == 1


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    store = DocStore(spark, f"file://{tmp_path_factory.mktemp('docs')}")
    store.create_collection("users", [{"field": "email", "unique": True}])
    store.create_index("users", "age")
    store.insert("users", [{"_id": f"u{i:02}", "name": f"User{i}", "email": f"user{i}@example.com", "age": 18 + i % 5} for i in range(20)])
    return store


def ids(df):
    return [r["_id"] for r in df.select("_id").collect()]


def test_documents(docs):
    assert docs.get("users", "u03")["name"] == "User3" and docs.get("users", "zz") is None
    assert ids(docs.query("users").filter(Gt("age", 20)).sort("age").limit(3).execute()) == ["u03", "u08", "u13"]
    assert ids(docs.query("users").sort("age", descending=True).skip(1).limit(2).execute()) == ["u09", "u14"]
    assert ids(docs.query("users").filter(In("age", (18, 22))).execute()) == ["u00", "u04", "u05", "u09", "u10", "u14", "u15", "u19"]
    assert ids(docs.query("users").skip(50).execute()) == [] and ids(docs.query("users").limit(0).execute()) == []
    assert ids(docs.get_by_index("users", "email", "user7@example.com")) == ["u07"]
    assert len(ids(docs.get_by_index("users", "age", 2))) == 12  # by prefix: 20, 21, 22
    assert ids(docs.get_by_index("users", "age", 2, prefix=False)) == []
    assert ids(docs.get_by_field_forced("users", "name", "uSeR5")) == ["u05"]
    assert docs.typed("users", "_id string, age bigint").agg(F.sum("age")).first()[0] == sum(18 + i % 5 for i in range(20))
    assert ids(docs.query("nothing").execute()) == []
    with pytest.raises(errors.CollectionNotFound):
        docs.get_by_index("nothing", "a", "b")
    with pytest.raises(errors.IndexNotFound):
        docs.get_by_index("users", "name", "b")


def test_unique_and_invalid(docs):
    with pytest.raises(errors.UniqueConstraintViolation) as e:
        docs.insert("users", [{"_id": "new", "email": "user1@example.com"}])
    assert e.value.rows == [("new", "email", "user1@example.com")] and docs.get("users", "new") is None
    docs.insert("users", {"_id": "u01", "email": "user1@example.com", "name": "again"})  # itself is no conflict
    assert docs.get("users", "u01")["name"] == "again"
    for bad in ({"_id": 5}, [1]):
        with pytest.raises(errors.InvalidDocument):
            docs.insert("users", [bad])
    with pytest.raises(errors.CollectionNotFound):
        docs.insert("nothing", {"a": 1})


def test_document_transaction(docs):
    docs.create_collection("notes")
    docs.insert("notes", {"_id": "a", "n": 1})
    txn = docs.begin()
    txn.insert("notes", {"_id": "b", "n": 2})
    txn.delete("notes", "a")
    assert ids(txn.query("notes").execute()) == ["b"] and ids(docs.query("notes").execute()) == ["a"]
    txn.commit()
    assert ids(docs.query("notes").execute()) == ["b"]
    docs.delete_prefix("notes", "b")
    assert ids(docs.query("notes").execute()) == []
    docs.drop_collection("notes")
    assert "notes" not in docs.collections()


JSON_ROWS = [("a", {"x": 30}), ("b", {"x": 30.0}), ("c", {"x": "30"}), ("d", {"x": None}), ("e", {}), ("f", {"x": True}), ("g", {"x": [1, 2]}), ("h", {"x.y": 1}), ("i", {"x": {"y": 1}})]


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        (Eq("x", 30), "a"), (Eq("x", 30.0), "b"), (Eq("x", "30"), "c"), (Eq("x", None), "d"), (Eq("x", True), "f"), (Eq("x", [1, 2]), "g"), (Eq("x.y", 1), "h"), (Eq("x", {"y": 1}), "i"),
        (Exists("x"), "abcdfgi"), (Exists("x.y"), "h"), (Gt("x", 29), "ab"), (Lt("x", 31), "ab"), (Gt("x", "2"), "c"), (In("x", (30, "30")), "ac"), (In("x", ()), ""), (In("x", (None,)), "d"),
    ],
)
def test_json_predicates(spark, rule, want):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in JSON_ROWS], "_id string, doc string")
    assert "".join(ids(Query(df, JsonFields("doc")).filter(rule).execute())) == want


def test_typed_nulls_sort_and_missing(spark):
    df = spark.createDataFrame([("a", 2), ("b", None), ("c", 1), ("d", 2)], "_id string, `n.m` long").withColumnRenamed("n.m", "n.m")
    assert ids(Query(df).sort("n.m").execute()) == ["b", "c", "a", "d"]
    assert ids(Query(df).sort("n.m", descending=True).execute()) == ["a", "d", "c", "b"]
    assert ids(Query(df).filter(Eq("n.m", None)).execute()) == ["b"]
    assert ids(Query(df).filter(Exists("zz")).execute()) == [] and ids(Query(df).filter(Gt("zz", 1)).execute()) == []


def test_updates(spark):
    df = spark.createDataFrame([(1, 1, ["a"], (5,)), (2, 1, [], (6,))], "id long, _v long, tags array<string>, s struct<n:long>")
    assert updates.push(df, "tags", F.lit("z")).where("id = 2").first()["tags"] == ["z"]
    assert updates.set_path(df, "s.n", F.col("s.n") + 1).first()["s"]["n"] == 6
    batch = spark.createDataFrame([(1, 9, ["n"], (0,), 1), (2, 9, ["n"], (0,), 4), (3, 9, [], (0,), 1)], "id long, _v long, tags array<string>, s struct<n:long>, expected long")
    new, conflicts = updates.replace_versioned(df, batch, "id")
    assert sorted((r["id"], r["_v"]) for r in new.collect()) == [(1, 2), (2, 1)]
    assert sorted(r["id"] for r in conflicts.collect()) == [2, 3]


def test_texts(spark):
    row = spark.range(1).select(*[values.duration_text(F.lit(n)).alias(str(n)) for n in (5, 1_500, 2_500_000, 3_000_000_000)], values.rate_text(F.lit(1500)).alias("r")).first()
    assert list(row) == ["5 ns", "1.50 µs", "2.50 ms", "3.00 s", "1.50 K/s"]


def test_formats(spark, tmp_path):
    formats.register(spark)
    rows = [(f"key_{i:05}".encode(), i, None if i % 7 == 0 else b"v" * (i % 300)) for i in range(3000) if i % 300 or i % 7 == 0]
    run = formats.Run(formats.write_run(rows))
    assert list(run.rows()) == rows and run.entries == len(rows) and len(run.places) > 5
    assert list(run.rows(b"key_00100", b"key_00200")) == [r for r in rows if b"key_00100" <= r[0] < b"key_00200"]
    assert run.get(b"key_01234")[1] == 1234 and run.get(b"none") is None and run.get(b"key_01234", before=1234) is None
    data = b"".join(formats.log_record(*r) for r in rows)
    assert list(formats.read_log(data)) == rows and list(formats.read_log(data + b"xy")) == rows
    with pytest.raises(errors.CorruptFile):
        list(formats.read_log(data[:-1] + b"!"))
    df = spark.createDataFrame(rows, "key binary, seq bigint, value binary").repartition(3)
    for name in ("cairn_runs", "cairn_log"):
        path = f"{tmp_path}/{name}"
        df.write.format(name).mode("append").save(path)
        back = spark.read.format(name).load(path)
        assert sorted((bytes(r["key"]), r["seq"], r["value"] and bytes(r["value"])) for r in back.collect()) == rows
        assert back.where((F.col("key") >= F.lit(b"key_00100")) & (F.col("key") < F.lit(b"key_00110"))).count() == 10


def test_membership_and_index_reads_reach_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    spark.createDataFrame([(1, "a", 5), (2, None, None), (3, "null", 12)], "id int, s string, n long").write.parquet(path)
    df = spark.read.parquet(path)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    found = df.where(In("n", (5, 12, "x", None)).column(TypedFields(df)))
    assert "PushedFilters: [Or(In(n, [" in plan(found) and "IsNull(n))]" in plan(found) and found.count() == 3
    assert df.where(In("n", ()).column(TypedFields(df))).count() == 0 and df.where(In("s", (5,)).column(TypedFields(df))).count() == 0
    ids = lambda d: sorted(r["id"] for r in d.collect())
    exact = indexes.lookup(df, F.col("n"), "12")
    assert "EqualTo(n,12)" in plan(exact) and ids(exact) == [3]
    assert "EqualTo(s,a)" in plan(indexes.lookup(df, F.col("s"), "a"))
    assert ids(indexes.lookup(df, F.col("s"), "null")) == [2, 3] and ids(indexes.lookup(df, F.col("n"), "null")) == [2]
    assert ids(indexes.lookup(df, F.col("s"), "nu", prefix=True)) == [2, 3] and ids(indexes.lookup(df, F.col("n"), "1", prefix=True)) == [3]
    assert ids(indexes.lookup(df, F.col("n"), "012")) == ids(indexes.lookup(df, F.col("n"), "1" * 19 + "9")) == []


def test_bloom_positions(spark):
    keys = [f"user_{i}" for i in range(500)] + ["key1", "", "é"]
    rows = spark.createDataFrame([(k,) for k in keys], "key string").select("key", values.bloom_positions(F.col("key")).alias("p")).collect()
    for r in rows:
        data = r["key"].encode()
        one, two = (zlib.crc32(bytes([seed, 0, 0, 0]) + data) for seed in (0, 1))
        assert r["p"] == [one % 131_072, two % 131_072, (one + two) % 131_072] == list(formats.bloom_bits(data))
    assert next(r["p"] for r in rows if r["key"] == "key1") == [25637, 25787, 51424]


def foreign_run(rows):
    """A run put together by hand, one block to an entry."""
    out, index, bloom = b"", [], bytearray(16_384)
    framed = lambda body: struct.pack("<I", len(body)) + body + struct.pack("<I", zlib.crc32(body))
    for key, seq, value in rows:
        index.append((key, len(out)))
        out += framed(struct.pack("<HI", len(key), len(value)) + key + struct.pack("<Q", seq) + value)
        one, two = (zlib.crc32(bytes([seed, 0, 0, 0]) + key) for seed in (0, 1))
        for bit in (one, two, one + two):
            bloom[bit % 131_072 // 8] |= 1 << (bit % 8)
    index_at = len(out)
    out += framed(struct.pack("<I", len(index)) + b"".join(struct.pack("<HQ", len(k), at) + k for k, at in index))
    bloom_at = len(out)
    out += framed(bytes(bloom))
    return out + struct.pack("<QIQQQQQ", 0x4B45594C54, 1, index_at, bloom_at, len(rows), rows[0][1], rows[-1][1])


def test_foreign_run(spark, tmp_path):
    formats.register(spark)
    rows = [(f"key_{i:04}".encode(), i + 10, b"v%d" % i) for i in range(200)]
    data = foreign_run(rows)
    run = formats.Run(data)
    assert all(run.get(k) == (k, s, v) for k, s, v in rows) and run.get(b"key_9999") is None
    (tmp_path / "sst-1.db").write_bytes(data)
    back = spark.read.format("cairn_runs").load(str(tmp_path))
    assert back.count() == 200
    assert [r["seq"] for r in back.where(F.col("key") == F.lit(b"key_0042")).collect()] == [52]
    assert back.where(F.col("key") == F.lit(b"absent")).count() == 0
    assert back.where(F.col("seq") < 10).count() == 0 and back.where(F.col("seq") < 12).count() == 2


def test_format_commits(spark, tmp_path):
    formats.register(spark)
    path = f"{tmp_path}/runs"
    rows = lambda *keys: spark.createDataFrame([(k.encode(), 1, b"x") for k in keys], "key binary, seq bigint, value binary")
    keys = lambda: sorted(bytes(r["key"]).decode() for r in spark.read.format("cairn_runs").load(path).collect())
    rows("a", "b").write.format("cairn_runs").mode("append").save(path)
    rows("c").write.format("cairn_runs").mode("append").save(path)
    assert keys() == ["a", "b", "c"]
    rows("d").write.format("cairn_runs").mode("overwrite").save(path)
    assert keys() == ["d"]
    broken = rows("e", "f").repartition(2).unionByName(rows("x" * 70_000))
    with pytest.raises(Exception, match="65535"):
        broken.write.format("cairn_runs").mode("overwrite").save(path)
    assert keys() == ["d"]
    # an attempt that doesn't count leaves nothing a reader sees
    formats._Writer(path, True, False).write(iter([{"key": b"z", "seq": 1, "value": b"x"}]))
    assert keys() == ["d"]
    with pytest.raises(errors.KeyTooLong):
        formats.log_record(b"x" * 70_000, 1, None)


def test_commit_is_durable(spark, tmp_path):
    path = f"file://{tmp_path}/kv"
    one = KVTable(spark, path)
    one.put("held", "in memory")
    txn = one.begin()
    txn.put("a", "1")
    txn.put("b", "2")
    seq = txn.commit()
    again = KVTable(spark, path)  # as after a crash
    assert again.get("a") == b"1" and again.get("b") == b"2" and again.get("held") == b"in memory"
    assert {r["seq"] for r in again.log().where(F.col("key").isin(b"a", b"b")).collect()} == {seq} and again.seq == seq + 1


def test_stream_into_store(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z"), ("b", 4, "")], "key string, op long, value string").coalesce(1).write.parquet(source)
    store = SegmentStore(spark, f"file://{tmp_path}/store", "string", "string")
    stream = spark.readStream.schema("key string, op long, value string").parquet(source)
    q = ingest.writer(stream, store).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["key"], r["value"]) for r in store.log().collect()} == {("a", "z"), ("b", None)}
    assert store.extra["last_batch"] == 0


def test_shell(spark, tmp_path):
    shell = Shell(spark, f"file://{tmp_path}/t")
    assert [shell.run(x) for x in ("PUT k some value", "get k", "get none", "del k", "get k", "ping", "bad")][:6] == ["OK", "some value", "(nil)", "OK", "(nil)", "PONG"]
    assert shell.run("scan").endswith("(0 entries)") and shell.run(".quit") is None
