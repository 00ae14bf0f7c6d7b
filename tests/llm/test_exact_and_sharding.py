from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.oracle import compare, connect
from wardenry.llm import queries
from wardenry.llm.exact_dedup import exact_dedup
from wardenry.llm.sharding import rendezvous, shard_rows

SF_DIR = "/root/testdata/sf0.01"


def test_exact_dedup_equals_its_sql(spark):
    df = queries.QUERIES["op3_exact_dedup"](spark, SF_DIR)
    assert compare(df, connect(SF_DIR), queries.ORACLES["op3_exact_dedup"]) == []


def test_exact_dedup_plan_moves_texts_once_and_runs_no_python(spark):
    text = exact_dedup(spark.read.parquet(f"{SF_DIR}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange rangepartitioning") == 1 and "Python" not in text and "InArrow" not in text
    assert "SinglePartition" not in text


def test_exact_dedup_of_odd_rows(odd, empty):
    rows = [r.asDict() for r in exact_dedup(odd, carry=odd.columns).collect()]
    assert len(rows) == 11 and all(r["text"] is not None or r["text_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
    groups = defaultdict(list)
    for r in rows:
        groups[r["text_sha256"]].append(r)
    for group in groups.values():
        ids = [r["doc_id"] for r in group if r["doc_id"] is not None]
        assert sum(r["kept"] for r in group) == 1
        assert {r["keep_id"] for r in group} == {max(ids, default=None)} and {r["group_size"] for r in group} == {len(group)}
    assert exact_dedup(empty).count() == 0


def test_hot_text_is_salted(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "same").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    found = exact_dedup(docs, hot_shares=64)
    assert found.where("kept").count() == 1501
    assert found.where("text_sha256 = sha2('same', 256)").select("keep_id", "group_size").distinct().collect() == [(1499, 1500)]


def test_shards(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = shard_rows(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    slots = defaultdict(list)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {r.doc_id: (r.shard, r.slot, r.grown_shard) for r in shard_rows(docs.repartition(5)).collect()}
    assert again == {r.doc_id: (r.shard, r.slot, r.grown_shard) for r in rows}


def test_weights_and_odd_rows(spark, odd, empty):
    ids = spark.range(20_000)
    parts = Counter(r[0] for r in ids.select(rendezvous(F.col("id"), [1, 3, 0, 1])).collect())
    assert 2 not in parts and abs(parts[1] / 20_000 - 0.6) < 0.02
    found = shard_rows(odd).collect()
    assert len(found) == 11 and {r["size"] for r in found if r.text_crc32 == 0} == {1}
    assert shard_rows(empty).count() == 0
