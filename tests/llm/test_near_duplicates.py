from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from wardenry.llm import queries, simhash_dedup
from wardenry.llm.common import components
from wardenry.llm.vector_dedup import _block_task, audit_recall, near_vectors

SF_DIR = "/root/testdata/sf0.01"


def parts(nodes, edges):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000 + i, 2001 + i) for i in range(200)]
    expected = parts({n for e in edges for n in e}, edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in expected.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    fps = {d.doc_id: plain_fingerprint(d.text) for d in docs}
    ids = sorted(fps)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3]
    expected = parts(ids, edges)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op5_simhash_dedup"](spark, SF_DIR).collect()}
    assert got == {i: (f"{fps[i]:016x}", expected[i]) for i in ids}


@pytest.mark.parametrize("bucket", [256, 40])
def test_links_of_crowded_fingerprints(spark, monkeypatch, bucket):
    """Fingerprints in a small ball fill every signature; refining must lose none of their links."""
    monkeypatch.setattr(simhash_dedup, "BUCKET", bucket)
    rng = random.Random(bucket)
    centre, fps = rng.getrandbits(64), set()
    while len(fps) < 120:
        x = centre
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    expected = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash_dedup.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == expected


def test_every_link_shares_a_signature():
    rng, masks = random.Random(5), simhash_dedup.first_masks()
    for _ in range(20_000):
        difference = 0
        for _ in range(rng.randrange(4)):
            difference |= 1 << rng.randrange(64)
        mask = next(m for m in masks if not difference & m)
        while mask.bit_count() < 61:
            mask = next(m for m in simhash_dedup.refined(mask) if not difference & m)


def test_simhash_of_odd_rows(odd, empty):
    rows = simhash_dedup.simhash_groups(odd).collect()
    assert len(rows) == 11
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {3}
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1} and [r.doc_id for r in rows if r.kept and r.doc_id in (1, 2)] == [1]
    assert simhash_dedup.simhash_groups(empty).count() == 0


def test_long_texts_in_slices(monkeypatch):
    text = " ".join(str(i % 97) for i in range(5000))
    whole = simhash_dedup.fingerprint(text)
    monkeypatch.setattr(simhash_dedup, "SLICE_BYTES", 100)
    assert simhash_dedup.fingerprint(text) == whole == (plain_fingerprint(text) ^ (1 << 63)) - (1 << 63)


def plain_vectors(rows):
    x = {i: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for i, v, _ in rows}
    label = {i: k for i, _, k in rows}
    ids = sorted(x)
    edges = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if label[a] == label[b] and x[a] @ x[b] >= 0.93]
    count = {i: 0 for i in ids}
    for a, b in edges:
        count[a] += 1
        count[b] += 1
    return count, parts(ids, edges)


@pytest.mark.parametrize("shard_rows", [2048, 60])
def test_vectors_against_all_pairs(spark, shard_rows):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    count, part = plain_vectors([tuple(r) for r in table.select("vec_id", "embedding", "label").collect()])
    got = near_vectors(table, shard_rows=shard_rows)
    rows = got.collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows} == {i: (count[i], part[i], part[i] == i) for i in count}
    assert audit_recall(table, got).first().recall >= 0.9


def test_dense_core_and_copies(spark):
    """Copies and a ball of near copies that no leader can part, with neighbours at its rim."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    ball = [centre + 0.02 * rng.normal(size=16) * np.linalg.norm(centre) / 4 for _ in range(150)]
    rim = [centre + s * rng.normal(size=16) * np.linalg.norm(centre) / 4 for s in (0.25, 0.3, 0.35) for _ in range(12)]
    vectors = [*ball, *rim, *[ball[0]] * 30, *(rng.normal(size=16) for _ in range(60))]
    rows = [(i, [float(a) for a in v], 1) for i, v in enumerate(vectors)]
    count, part = plain_vectors(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(table, shard_rows=40).collect()}
    exact = sum(got[i][0] == count[i] for i in count)
    assert sum(c for c, _ in got.values()) >= 0.97 * sum(count.values()) and exact >= 0.8 * len(count)
    assert all(got[i][0] <= count[i] for i in count)


def chains_and_loose_groups(seed, chains=12, groups=4):
    """Chains whose next but one is out of range, and groups of which few pairs are in range, under ids in random order."""
    rng = np.random.default_rng(seed)
    vectors = []
    for n in range(chains):
        a, b = np.linalg.qr(rng.normal(size=(24, 2)))[0].T
        vectors += [np.cos(t) * a + np.sin(t) * b for t in np.radians(15 * np.arange(3 + n % 6))]
    for _ in range(groups):
        centre = rng.normal(size=24)
        vectors += [centre + 0.3 * rng.normal(size=24) for _ in range(25)]
    ids = rng.permutation(len(vectors))
    return [(int(i), [float(a) for a in v], 1) for i, v in zip(ids, vectors)]


@pytest.mark.parametrize("seed", [0, 1])
def test_chains_and_loose_groups_are_whole(spark, seed):
    rows = chains_and_loose_groups(seed)
    count, part = plain_vectors(rows)
    assert len(set(part.values())) < len(rows) - 40
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (count[i], part[i], part[i] == i) for i in count}


@pytest.mark.parametrize("blocks", [1, 2])
def test_block_links_keep_chains(blocks):
    """Links 0-2, 2-3 and 3-1: neither end of 2-3 has the other as its smallest neighbour."""
    at = {0: 0, 2: 15, 3: 30, 1: 45}
    x = [np.array([np.cos(np.radians(at[n])), np.sin(np.radians(at[n]))]) for n in range(4)]
    block = [0, 0, 1 % blocks, 0]
    met = []
    for one, two in [(0, 0)] if blocks == 1 else [(0, 0), (0, 1), (1, 1)]:
        nodes = [n for n in range(4) if block[n] in (one, two)]
        table = pa.table({"group": [7] * len(nodes), "one": [one] * len(nodes), "two": [two] * len(nodes), "node": nodes, "m": [1] * len(nodes), "v": [x[n].tobytes() for n in nodes],
                          "core": [0] * len(nodes), "block": [block[n] for n in nodes], "homes": [[7]] * len(nodes)})
        met += _block_task(0.93)((pa.scalar(7), pa.scalar(one), pa.scalar(two)), table).to_pylist()
    assert set(parts(range(4), [(r["node"], r["peer"]) for r in met]).values()) == {0}
    assert [sum(r["links"] for r in met if r["node"] == n) for n in range(4)] == [1, 1, 2, 2]


def test_audit_of_planted_links_over_shards(spark):
    """Pairs and loose groups in one label that is split into shards: the audit meets links, and nearly all are found."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(300, 24))
    vectors = [c + s * rng.normal(size=24) for c in centres for s in (0, 0.1, 0.25)]
    rows = [(i, [float(a) for a in v], 1) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = near_vectors(table, shard_rows=100)
    audit = audit_recall(table, got, every=3).first()
    assert audit.expected >= 300 and audit.recall >= 0.9
    _, part = plain_vectors(rows)
    assert sum(r.component_id == part[r.vec_id] for r in got.collect()) >= 0.97 * len(rows)


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.1], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1), (8, [float("inf"), 1.0], 1),
            (9, [1.0, 0.0], 2), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (12, [1e200, 0.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    got = near_vectors(table).collect()
    assert len(got) == 14
    assert {(r.n_links, r.component_id) for r in got if r.vec_id in (1, 2, 12, None)} == {(4, 1)}
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got if r.vec_id in range(3, 12))
    assert near_vectors(table.limit(0)).count() == 0
