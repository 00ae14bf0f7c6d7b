from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wardenry.llm import line_dedup

LOWER = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)


def key(line):
    return line.strip(line_dedup.BLANKS).translate(LOWER)


def plain(rows):
    """(id, n_lines, n_dropped, kept text) of every row."""
    holders = defaultdict(set)
    smallest = lambda doc_id: line_dedup.NULL_ID if doc_id is None else doc_id
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(smallest(doc_id))
    stays = {k: max(ids) for k, ids in holders.items() if len(ids) >= 3}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if stays.get(key(line), smallest(doc_id)) == smallest(doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in line_dedup.line_dedup(df).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)


def corpus(seed, docs=90):
    rng = random.Random(seed)
    lines = [f"line number {i} of the shared ones " + "x" * rng.randrange(30) for i in range(25)] + ["short", "", "exactly twenty chars", "exactly 19 chars ..", "Ärger und Öl in der Straße", "ärger und Öl in der Straße"]
    rows = []
    for i in range(docs):
        text = ["the line that a third of all documents hold"] * rng.choice([0, 0, 1, 2]) + [rng.choice(lines) for _ in range(rng.randrange(12))] + [f"own line of document {i} and no other"]
        rng.shuffle(text)
        rows.append((i, rng.choice(["\n", "\n", " \t\n\r"]).join(rng.choice([t, t, t.upper(), "  " + t + "\r"]) if t.isascii() else t for t in text)))
    return rows


@pytest.mark.parametrize("partitions, batch", [(1, 10_000), (1, 3), (13, 10_000), (60, 2)])
def test_lines_equal_brute_force(spark, partitions, batch):
    """With many ranges most keys lie over a border of one, and in small batches they lie over several batches."""
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}
    before = {k: spark.conf.get(k) for k in settings}
    rows = corpus(partitions + batch)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == plain(rows) and sum(r[2] for r in got) > 200


def test_bitmaps_make_the_texts(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r.doc_id: r.text for r in line_dedup.kept_text(df).collect()}
    for r in line_dedup.line_dedup(df).collect():
        keep = line_dedup.bitmap_of(bytes(r.keep), r.n_lines)
        lines = dict(rows)[r.doc_id].split("\n")
        assert keep.sum() == r.n_lines - r.n_dropped and texts[r.doc_id] == "\n".join(line for line, stays in zip(lines, keep) if stays)
    assert len(line_dedup._packed(line_dedup.bitmap_of(None, 100_000))) < 200


def test_odd_rows(spark, odd, empty):
    line = "a line that is long enough\n"
    extra = [(None, line + "x"), (None, line), (9, line * 3), (9, line + "other text"), (10, line * 50_000), (11, "\r\n \x0bA LINE that is long enough\x0c\n"), (11, "\r\n \x0bA LINE that is long enough\x0c\n"), (12, "\n\n"), (13, "x" * 300_000)]
    rows = [(r.doc_id, r.text) for r in odd.collect()] + extra
    df = odd.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    assert found(df) == plain(rows)
    assert line_dedup.line_dedup(empty).count() == 0
    clashing = df.select("*", F.lit(1).alias("id"), F.lit("y").alias("key"), F.lit(2).alias("at"), F.lit(3).alias("n_dropped"))
    assert found(clashing) == plain(rows)
