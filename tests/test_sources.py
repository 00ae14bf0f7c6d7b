from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from wardenry.operators import dml, reconcile
from wardenry.sources import files, sinks, tables, topics
from wardenry.sources.versioned import CommitConflict


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_json_documents_keep_key_presence_and_quarantine(spark, tmp_path):
    put(tmp_path, "a.json", '[{"a":1,"b":null},\n {"a":2}]')
    put(tmp_path, "bad.json", '[{"a":1,')
    put(tmp_path, "one.json", '{"a":3}')
    put(tmp_path, "sub/c.json", "[]")
    put(tmp_path, "skip.txt", "[]")
    rows = files.json_documents(spark, str(tmp_path), "*.json").select("record", "malformed").collect()
    assert sorted(tuple(r) for r in rows) == [('[{"a":1,', True), ('{"a":1,"b":null}', False), ('{"a":2}', False), ('{"a":3}', False)]


def test_json_lines(spark, tmp_path):
    put(tmp_path, "a.jsonl", '{"a":1}\nnot json\n[1]\n')
    assert sorted(r.malformed for r in files.json_lines(spark, str(tmp_path)).collect()) == [False, True, True]
    assert files.json_columns(spark, str(tmp_path / "a.jsonl"), "a int", lines=True).where("a = 1").count() == 1


def test_csv_rules(spark, tmp_path):
    put(tmp_path, "a.csv", 'id,name,note\n1,Ann,\n2,"say ""hi""",x\n3,"two\nlines",y\n4\n5,a,b,c\n')
    rows = {r.id: r for r in files.csv_table(spark, str(tmp_path), ["id", "name", "note"], multi_line=True).collect()}
    assert (rows["1"].name, rows["1"].note, rows["1"].malformed) == ("Ann", "", False)
    assert rows["2"].name == 'say "hi"' and rows["3"].name == "two\nlines"
    assert rows["4"].malformed and rows["4"].note is None
    assert rows["5"].malformed and rows["5"].raw == "5,a,b,c"
    counted = files.csv_table(spark, str(tmp_path), ["id", "name", "note"], multi_line=True).where("malformed").count()
    assert counted == 2


def test_landing_zone_mixes_formats(spark, tmp_path):
    put(tmp_path, "in/a.json", '[{"id":1},{"id":2}]')
    put(tmp_path, "in/b.csv", "id,name\n3,c\n")
    without_parquet = files.landing_zone(spark, str(tmp_path / "in"), ["id", "name"])
    assert without_parquet.count() == 3
    spark.createDataFrame([(4, None)], "id int, name string").write.parquet(str(tmp_path / "in/p"))
    got = files.landing_zone(spark, str(tmp_path / "in"), ["id", "name"]).select("record", "malformed").collect()
    assert sorted(r.record for r in got) == ['{"id":"3","name":"c"}', '{"id":1}', '{"id":2}', '{"id":4,"name":null}']


def test_tenant_objects(spark, tmp_path):
    put(tmp_path, "t1/docs/a.bin", "hello")
    put(tmp_path, "t1/docs/b.bin", "hi")
    put(tmp_path, "t1/c.bin", "x")
    put(tmp_path, "t2/docs/a.bin", "other")
    root = f"file:{tmp_path}"
    assert bytes(files.read_object(spark, root, "t1", "docs/a.bin").first().content) == b"hello"
    assert sorted(r.key for r in files.list_objects(spark, root, "t1", "docs/").collect()) == ["t1/docs/a.bin", "t1/docs/b.bin"]
    assert files.list_objects(spark, root, "t1").count() == 3
    for tenant, path in (("../t2", "a"), ("t1", "../t2/a"), ("t1", "/etc"), ("", "a"), ("t1", "")):
        with pytest.raises(ValueError):
            files.read_object(spark, root, tenant, path)
    with pytest.raises(ValueError):
        files.list_objects(spark, root, "t1", "../")


@pytest.mark.parametrize("text", ["x' OR '1'='1", "'; DROP TABLE t; --", '"quoted"', "a\\b", "你"])
def test_parameters_are_bound(spark, text):
    df = spark.createDataFrame([(text,), ("other",)], "name string")
    assert tables.query(spark, "SELECT * FROM {t} WHERE name = :n", {"n": text}, t=df).count() == 1
    assert tables.query(spark, "SELECT * FROM {t} WHERE name = ?", [text], t=df).count() == 1


def test_query_arguments(spark):
    for sql in ("", "  ", None):
        with pytest.raises(ValueError):
            tables.query(spark, sql)
    with pytest.raises(TypeError):
        tables.query(spark, "SELECT 1", "x")


def test_jdbc_options():
    plain = tables.jdbc_options("jdbc:x", sql="SELECT 1")
    assert plain["query"] == "SELECT 1" and plain["pushDownPredicate"] == "true"
    split = tables.jdbc_options("jdbc:x", sql="SELECT 1", partition_column="id", lower=0, upper=9, partitions=4)
    assert "query" not in split and split["dbtable"].startswith("(SELECT 1)") and split["numPartitions"] == "4"
    with pytest.raises(ValueError):
        tables.jdbc_options("jdbc:x")


@pytest.mark.parametrize("wanted, ids", [
    ('{"name": "alice"}', ["1"]), ('{"tenant_id": {"$ne": "t1"}}', ["2", "3"]), ("{}", ["1", "2", "3"]), ("", ["1", "2", "3"]),
    ('{"age": null}', ["3"]), ('{"age": {"$ne": null}}', ["1", "2"]), ('{"age": {"$gte": 5, "$lt": 7}}', ["1"]),
    ('{"name": {"$in": ["bob", null]}}', ["2", "3"]), ('{"name": {"$nin": ["bob"]}}', ["1", "3"]),
    ('{"$or": [{"name": "bob"}, {"age": 5}]}', ["1", "2"]), ('{"$and": [{"name": "bob"}, {"age": 5}]}', []),
])
def test_document_filters(spark, wanted, ids):
    df = spark.createDataFrame([(1, "alice", "t1", 5), (2, "bob", "t2", 7), (3, None, None, None)], "_id int, name string, tenant_id string, age int")
    assert sorted(r._id for r in tables.find(df, wanted).collect()) == ids


def test_bad_document_filters(spark):
    df = spark.createDataFrame([(1,)], "_id int")
    for bad in ("[1]", '{"_id": {"$where": 1}}'):
        with pytest.raises(ValueError):
            tables.find(df, bad)


def test_topic_options():
    options = topics.kafka_options("h:1", "orders", "t1", group="g")
    assert options["subscribe"] == "t1_orders" and options["kafka.group.id"] == "t1_g" and options["startingOffsets"] == "earliest"
    assert json.loads(topics.offsets_from("orders", 7, "t1")) == {"t1_orders": {"0": 7}}
    for offset in ("7", True, 1.0):
        with pytest.raises(TypeError):
            topics.offsets_from("orders", offset, "t1")
    for offset, topic in ((-1, "orders"), (1, " ")):
        with pytest.raises(ValueError):
            topics.offsets_from(topic, offset, "t1")


def test_messages_keep_nulls_and_nesting(spark):
    df = spark.createDataFrame([("k", None, ([1, 2, 3],))], "key string, number int, nested struct<data:array<int>>")
    row = topics.messages(df, "events", "t1").first()
    assert row.topic == "t1_events" and json.loads(row.value) == {"key": "k", "number": None, "nested": {"data": [1, 2, 3]}}
    with pytest.raises(ValueError):
        topics.messages(df, "")


def test_replay_and_redelivery(spark):
    df = spark.createDataFrame([(o, p, f"{p}-{o}") for p in range(2) for o in range(5)], "offset long, partition int, message_id string")
    assert sorted(r.offset for r in topics.replay_landed(df, 3).collect()) == [3, 4]
    assert topics.once(df.unionByName(df)).count() == 10


def test_uniform_read_and_write(spark, store, tmp_path):
    root = f"file:{tmp_path}"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sinks.write_any("s3", "d/x", df, tenant_id="t1", root=root) == 2
    assert sinks.read_any(spark, "s3", "d/x", tenant_id="t1", root=root, fmt="parquet").count() == 2
    assert sinks.write_any("postgresql", "items", df, tenant_id="t1", store=store) == 2
    store.read("items").createOrReplaceTempView("items_view")
    assert sinks.read_any(spark, "postgresql", "SELECT * FROM items_view WHERE id > :n", tenant_id="t1", params={"n": 1}).count() == 1
    assert sinks.read_any(spark, "snowflake", "SELECT * FROM items_view", tenant_id="t2").count() == 0
    assert sinks.read_any(spark, "mongodb", '{"v": "a"}', tenant_id="t1", collection=store.read("items")).count() == 1
    assert sinks.write_any("pubsub", "t", df, tenant_id="t1", root=root) == 2
    assert sinks.read_any(spark, "pubsub", "t", tenant_id="t1", root=root).count() == 2
    for kind in ("s3", "ftp", "kafka"):
        with pytest.raises(ValueError):
            sinks.write_any(kind, "x", df, tenant_id="t1")
    with pytest.raises(ValueError):
        sinks.read_any(spark, "ftp", "x", tenant_id="t1")
    with pytest.raises(ValueError):
        sinks.read_any(spark, "s3", "", tenant_id="t1", root=root)


def test_overwrite_touches_only_its_tenants(spark, tmp_path):
    path = f"file:{tmp_path}/t"
    df = spark.createDataFrame([("a", 1), ("b", 1)], "tenant_id string, v int")
    sinks.write_by_tenant(df, path)
    sinks.write_by_tenant(spark.createDataFrame([("a", 2)], df.schema), path)
    assert {(r.tenant_id, r.v) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 1)}


def test_append_aligns_and_counts(spark, store):
    schema = spark.createDataFrame([], "id long, name string").schema
    assert sinks.append(store, "t", spark.createDataFrame([("x", 1, 9)], "name string, id int, extra int"), schema) == 1
    assert sinks.append(store, "t", spark.createDataFrame([(2,)], "id int"), schema) == 1
    assert sinks.append(store, "t", spark.createDataFrame([], schema), schema) == 0
    assert store.version() == 2
    assert {tuple(r) for r in store.read("t").collect()} == {(1, "x"), (2, None)}
    assert sinks.align(spark.createDataFrame([(1, 2)], "id int, extra int"), schema)[1] == ["extra"]


def test_transaction_publishes_all_or_nothing(spark, store):
    df = spark.range(3)
    with store.transaction() as change:
        change.append("a", df)
        change.append("b", df)
    with pytest.raises(ZeroDivisionError):
        with store.transaction() as change:
            change.replace("a", df.limit(0))
            raise ZeroDivisionError
    assert store.tables() == ["a", "b"] and store.read("a").count() == 3 and store.version() == 1
    with pytest.raises(KeyError):
        store.read("c")


def test_a_job_may_replace_what_it_reads(spark, store):
    with store.transaction() as change:
        change.append("a", spark.range(10))
    old = store.read("a")
    with store.transaction() as change:
        change.replace("a", old.where("id < 4"))
    assert store.read("a").count() == 4 and old.count() == 10 and store.read("a", version=1).count() == 10


def test_concurrent_writers(spark, store):
    with store.transaction() as change:
        change.append("a", spark.range(1))
    with store.transaction() as outer:
        outer.append("a", spark.range(1))
        with store.transaction() as inner:
            inner.append("a", spark.range(1))
    assert store.read("a").count() == 3
    with pytest.raises(CommitConflict):
        with store.transaction() as outer:
            outer.replace("a", spark.range(0))
            with store.transaction() as inner:
                inner.append("a", spark.range(1))
    assert store.read("a").count() == 4
    with pytest.raises(CommitConflict):
        with store.transaction() as outer:
            outer.append("a", spark.range(1))
            with store.transaction() as inner:
                inner.replace("a", spark.range(2))
    assert store.read("a").count() == 2


def test_partitions_and_compaction(spark, store):
    for day in ("2024-01-01", "2024-01-02"):
        with store.transaction() as change:
            change.append("a", spark.createDataFrame([(1, "007", day), (2, "1e5", day)], "id int, tenant_id string, dt string"), ["tenant_id"])
    assert sorted({r.tenant_id for r in store.read("a").collect()}) == ["007", "1e5"]
    plan = store.read("a").where("tenant_id = '007'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan
    store.compact("a", ["tenant_id"])
    assert store.read("a").count() == 4
    with pytest.raises(ValueError):
        with store.transaction() as change:
            change.append("a", spark.createDataFrame([(1, "x", "y")], "id int, tenant_id string, dt string"), ["dt"])
    with store.transaction() as change:
        change.append("a", spark.createDataFrame([(1, "x/y=%", "z")], "id int, tenant_id string, dt string"))
    assert store.partition_columns("a") == ["tenant_id"] and store.read("a").where("tenant_id = 'x/y=%'").count() == 1


def test_only_affected_partitions_are_replaced(spark, store):
    schema = "id int, tenant_id string, dt string"
    rows = [(i, t, d) for i, (t, d) in enumerate([("a/b", "1"), ("a/b", "2"), ("c", "1"), (None, "1")])]
    for _ in range(2):
        with store.transaction() as change:
            change.append("x", spark.createDataFrame(rows, schema), ["tenant_id", "dt"])
    def untouched():
        rows = store.read("x").where("tenant_id = 'c' OR tenant_id IS NULL")
        return {r[0] for r in rows.select("_metadata.file_path").distinct().collect()}

    before = untouched()
    with store.transaction() as change:
        left = store.read("x").where("tenant_id = 'a/b' AND id = 1")
        change.replace_partitions("x", left, lambda values: values["tenant_id"] == "a/b")
    assert sorted((r.id, r.tenant_id) for r in store.read("x").where("tenant_id IS NOT NULL").collect()) == [(1, "a/b")] * 2 + [(2, "c")] * 2
    assert untouched() == before
    with store.transaction() as change:
        change.replace_partitions("x", store.read("x").limit(0), lambda values: values["dt"] == "1")
    assert {(r.id, r.dt) for r in store.read("x").collect()} == {(1, "2")}


def test_dml(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id int, v string")
    changes = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "c", 1)], "id int, v string, at int")
    assert {tuple(r) for r in dml.upsert(target, changes, ["id"], "at").collect()} == {(1, "a"), (2, "new"), (3, "c"), (None, "n")}
    assert {r.v for r in dml.delete_where(target, F.col("id") == 1).collect()} == {"b", "n"}
    assert {r.v for r in dml.delete_keys(target, changes, ["id"]).collect()} == {"a", "n"}
    assert {r.v for r in dml.update_where(target, F.col("id") > 1, {"v": F.lit("z")}).collect()} == {"a", "z", "n"}
    assert sorted(r.v for r in dml.update_one(target, F.col("id") > 0, {"v": F.lit("z")}, "id").collect()) == ["b", "n", "z"]
    assert sorted(r.v for r in dml.delete_one(target, F.col("id") > 0, "id").collect()) == ["b", "n"]
    assert dml.delete_one(target, F.col("v") == "none", "id").count() == 3
    assert dml.affected(target, F.col("id") > 0).first()[0] == 2


def test_reconciliation(spark):
    source = spark.createDataFrame([("t", 1, "a"), ("t", 2, None), ("u", 3, "c"), ("u", 4, "d"), ("u", 4, "d")], "tenant_id string, id int, v string")
    target = spark.createDataFrame([("t", 1, "a"), ("t", 2, ""), ("u", 4, "d"), ("u", 5, "e")], "tenant_id string, id int, v string")
    assert {(r.id, r.difference) for r in reconcile.compare_rows(source, target, ["id"], ["v"]).collect()} == {
        (2, "values_differ"), (3, "missing_in_target"), (4, "row_count_differs"), (5, "extra_in_target")}
    counts = {r.tenant_id: (r.verification_status, r.warning) for r in reconcile.count_check(source, target, ["tenant_id"]).collect()}
    assert counts == {"t": ("passed", None), "u": ("failed_mismatch", "Record count mismatch: 1 records not written")}
