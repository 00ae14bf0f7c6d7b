from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from tests.llm.test_near_duplicates import parts, plain_fingerprint
from wardenry.llm.common import frozen

SF_DIR = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, {}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        current = frozen(stage(spark, current, SF_DIR), name)
        kept[name] = current.collect()
        if name != "packing":
            assert current.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    good = {d.doc_id for d in kept["quality"]}
    assert sum(q == 1 and i not in good for i, q in labels.items()) <= 2 and sum(q == 0 and i in good for i, q in labels.items()) <= 2
    first = defaultdict(int)
    for d in kept["quality"]:
        first[d.text] = max(first[d.text], d.doc_id)
    assert {d.doc_id for d in kept["exact_dedup"]} == set(first.values())
    fps = {d.doc_id: plain_fingerprint(d.text) for d in kept["exact_dedup"]}
    ids = sorted(fps)
    part = parts(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert {d.doc_id for d in kept["simhash_dedup"]} == set(part.values())
    assert {d.doc_id for d in kept["mixing"]} <= {d.doc_id for d in kept["simhash_dedup"]}
    times = defaultdict(int)
    for d in kept["mixing"]:
        times[d.doc_id] += 1
    tokens, size = defaultdict(int), {}
    for r in kept["packing"]:
        tokens[r.doc_id] += r.length
        size[r.doc_id] = r.doc_tokens
    assert {i: n // size[i] for i, n in tokens.items()} == times and all(tokens[i] % size[i] == 0 for i in tokens)


def test_stages_on_odd_rows(spark, odd, empty):
    for rows in (odd, empty):
        current = rows
        for name, stage in corpus_pipeline.STAGES:
            current = frozen(stage(spark, current, SF_DIR), name)
            assert name == "packing" or current.columns == rows.columns
