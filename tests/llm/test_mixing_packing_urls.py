from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict
from sys import getsizeof

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardenry.llm import common, mixing, packing, queries, url_rules

SF_DIR = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(w for s, w in weight.items() if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / free for s in sizes}
        above = {s for s in sizes if s not in capped and target[s] > 3 * sizes[s]}
        if not above:
            return target
        capped |= above


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mix(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    given = {r.doc_id: r for r in docs.collect()}
    rows = mixing.mix_sources(docs).collect()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        d = given[r.doc_id]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", d.text)) and r.taken <= 3 * r["size"]
        sizes[d.source] += r["size"]
        taken[d.source] += r.taken
        largest[d.source] = max(largest[d.source], r["size"])
    target = plain_targets(sizes)
    assert len(rows) == len(given)
    for r in rows:
        source = given[r.doc_id].source
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source])
    assert all(abs(taken[s] - target[s]) <= 1.5 * largest[s] for s in sizes)
    again = {r.doc_id: r.taken for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_flight_keeps_totals_and_expectations():
    rng = random.Random(1)
    sizes = [float(rng.randrange(1, 500)) for _ in range(300)]
    chances = [rng.random() for _ in sizes]
    moved = mixing.flight(chances, sizes, rng)
    assert sum(0 < c < 1 for c in moved) <= 2
    assert sum(moved) == pytest.approx(sum(chances)) and np.dot(moved, sizes) == pytest.approx(np.dot(chances, sizes))
    means = np.mean([mixing.land(mixing.flight([0.3, 0.6, 0.5, 0.2], [1.0, 2.0, 3.0, 9.0], r), [1.0, 2.0, 3.0, 9.0], r) for r in [random.Random(i) for i in range(4000)]], axis=0)
    assert np.abs(means - [0.3, 0.6, 0.5, 0.2]).max() < 0.04


def test_blocks_of_blocks(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    units = mixing.mix_units(docs, weights=(1.0, 1.0, 1.0, 9.0), group_rows=20).collect()
    for s in ("0", "1", "2"):
        mine = [u for u in units if u.source == s]
        assert abs(sum(u["size"] * (u.whole * u.rows + u.more) for u in mine) - mine[0].target) <= 75


def test_mix_of_odd_rows(odd, empty):
    rows = mixing.mix_sources(odd).collect()
    assert len(rows) == 11 and all(r.taken <= 3 * r["size"] for r in rows) and all(r.taken == 0 for r in rows if not r["size"])
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    counted = mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert counted == sum(r.taken for r in rows)
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def check_packing(docs, rows):
    tokenizer = Tokenizer.from_file(PATH)
    texts = {d.doc_id: d.text or "" for d in docs}
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, found in pieces.items():
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == len(ids[i])
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 4096
    return sum(map(len, ids.values())) / (4096 * len(sequences))


@pytest.mark.parametrize("group_pieces", [16_384, 150])
def test_packing_is_a_round_trip(spark, group_pieces):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = packing.pack(docs, PATH, group_pieces=group_pieces).collect()
    assert check_packing(docs.collect(), rows) > 0.95


def test_packing_of_odd_rows(odd, empty):
    rows = packing.pack(odd, PATH).collect()
    assert sorted(r.doc_tokens for r in rows if r.doc_id in (3, 4, 5)) == [1, 1, 1]
    one_each = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(one_each.collect(), packing.pack(one_each, PATH).collect())
    assert sum(r.length for r in rows if r.doc_id == 2 and r.start == 0) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 2)
    assert packing.pack(empty, PATH).count() == 0


def test_chunks_are_tokenised_as_whole_texts():
    tokenizer, encoder = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    rng = random.Random(2)
    pool = ["it's", "'s", " ", "\n", "\t", " ", "\u00a0", "\x1c", "e\u0301", "é", "ΑΣ", "İ", "ß", "Ä", "µ", "²", "1", "23", "!!", "<|endoftext|>", "x<|startoftext|>y", "日本", "\u200b", "\x85", "Don't", "ab'll", "O'Neill"]
    for _ in range(5000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(9)))
        got = np.frombuffer(b"".join(encoder(text)), "<u4").tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_memory_of_the_encoder():
    """What is remembered, and what Arrow holds of a block, is bounded in bytes."""
    memo = packing._Recent(lambda key: b"x" * 1000)
    assert all(memo[f"word {i}"] == b"x" * 1000 for i in range(100_000)) and memo["word 1"] == b"x" * 1000
    assert 10_000_000 < sum(getsizeof(k) + getsizeof(v) for part in (memo, memo.old) for k, v in part.items()) < 60_000_000
    memo = packing._Recent(str.encode, 16_000)
    assert memo["b" * 2000] == b"b" * 2000 and not memo and memo["b"] == b"b" and "b" in memo
    encoder, words = packing.Encoder(PATH), [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    texts, usual = pa.array([" ".join(random.Random(n).choices(words, k=1000)) for n in range(100)] * 40), pa.default_memory_pool()
    pool = pa.proxy_memory_pool(usual)
    pa.set_memory_pool(pool)
    try:
        found = [*packing.cut_block(encoder, texts)]
    finally:
        pa.set_memory_pool(usual)
    assert found == [packing.cut(encoder, t.as_py()) for t in texts[:100]] * 40
    assert texts.nbytes > 11_000_000 and pool.max_memory() < 45_000_000


def test_rows_come_to_python_in_batches(spark):
    counts = lambda: max(r.n for r in spark.range(0, 3000, 1, 1).mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in it), "n long").collect())
    usual = spark.conf.get(common.ARROW_ROWS, None)
    with common.arrow_batches(spark, 1000):
        assert counts() == 1000
        with common.arrow_batches(spark, 2000):
            assert counts() == 1000
        assert counts() == 1000
    assert spark.conf.get(common.ARROW_ROWS, None) == usual and counts() == 3000


def test_bounded_space_best_fit():
    bins, offsets, fills, still = packing.place([6, 5, 4, 5, 9, 8], 10, 2)
    assert bins == [0, 1, 0, 1, 2, 3] and offsets == [0, 0, 6, 5, 0, 0] and fills == [10, 10, 9, 8] and still == [False, False, True, True]
    # None fits and both windows are taken: the fullest is closed.
    assert packing.place([9, 8, 7, 2], 10, 2)[0] == [0, 1, 2, 1]


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_urls(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url").collect()}
    rows = queries.QUERIES["op9_url_rules"](spark, SF_DIR).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = plain_rule(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)


def test_mined_rules_against_counting(spark):
    urls = [f"https://a{i % 4}.example.{t}/{d}/{i}.html" for i, (t, d) in enumerate([("org", "es"), ("org", "fr"), ("com", "fr"), ("com", "de"), ("org", "en")] * 30)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    host, path = url_rules.url_host(F.col("url")), url_rules.url_path(F.col("url"))
    rows = pages.select(url_rules.url_tokens(F.col("url"), host, path).alias("tokens"), url_rules.longest_rule(host, path, queries.URL_RULES)["verdict"].alias("verdict"))
    labelled = [(set(r.tokens), r.verdict) for r in rows.collect()]
    rules = url_rules.mine_rules(rows, 0.05, 0.6).collect()
    assert rules
    for r in rules:
        having = [v for t, v in labelled if set(r.tokens) <= t]
        right = sum(v == r.verdict for v in having)
        assert r.confidence == pytest.approx(right / len(having)) and r.confidence >= 0.6 and right >= 0.05 * len(labelled)
    sets = rows.select("tokens").distinct().withColumn("set", F.concat_ws(" ", "tokens"))
    for r in url_rules.apply_rules(sets, url_rules.mine_rules(rows, 0.05, 0.6)).join(sets, "set").collect():
        best = max((x.confidence, x.support, len(x.tokens), x.verdict) for x in rules if set(x.tokens) <= set(r.tokens))
        assert r.verdict == best[3]


def test_rules_see_every_part_of_a_url(spark):
    """Later path segments, query names and values part urls whose first segment is the same number."""
    rules = (("a.com", "/2024/casino", "block"), ("a.com", "/2024/news", "allow"), ("c.com", "/", "block"), ("d.com", "/", "allow"))
    urls = [f"http://a.com/2024/{d}/p{i}?cat={c}" for i in range(40) for d, c in (("casino", "bets"), ("news", "sport"))]
    urls += [f"http://c.com/x{i}?ref=spam" for i in range(40)] + [f"http://d.com/x{i}?ref=mail" for i in range(40)]
    asked = {"http://b.net/2024/casino/win?cat=bets": "block", "http://b.net/2024/news/x?cat=sport": "allow", "http://e.net/1/2/3/casino": "block", "http://e.net/z?y=1&ref=spam": "block", "http://e.net/z?y=1&ref=mail": "allow"}
    pages = spark.createDataFrame(list(enumerate([*urls, *asked])), "page_id long, url string")
    found = {r.page_id: r.verdict for r in url_rules.filter_urls(pages, rules).collect()}
    assert {u: found[len(urls) + i] for i, u in enumerate(asked)} == asked
    tokens = [set(r.t) for r in spark.createDataFrame([(u,) for u in asked], "u string").select(url_rules.url_tokens(F.col("u"), url_rules.url_host(F.col("u")), url_rules.url_path(F.col("u"))).alias("t")).collect()]
    assert tokens[0] - tokens[1] == {"dir=casino", "dir=win", "pair=cat=bets"}


def test_frequent_tokens_against_counting(spark):
    rows = [(["a", "b", "c", "z"] if i % 2 else ["a", "d", f"u{i}"], "x") for i in range(100)] + [(["é"], "x")] * 5
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string").repartition(3)
    # b, c and z come in the same rows; every u is rarer.
    known = [("a", "a"), ("b", "b"), ("c", "b"), ("d", "d"), ("z", "b")]
    assert url_rules.frequent_tokens(df, 0.05) == known
    assert url_rules.frequent_tokens(df, 0.04) == [*known, ("é", "é")] and url_rules.frequent_tokens(df.limit(0)) == []
    kept = spark.createDataFrame([(["a", "c", "q", "z", ""],), ([],), (None,)], "t array<string>").select(url_rules.only(F.col("t"), known).alias("t"))
    assert [r.t for r in kept.collect()] == [["a", "b"], [], None]


def test_odd_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (None, "HTTP://A.EXAMPLE.ORG/es/x?y#z"), (5, "http://example.org#a/b"), (5, "http://example.org#a/b"), (6, "x://org")]
    table = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("verdict", F.lit(2))
    got = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in url_rules.filter_urls(table, queries.URL_RULES).collect()), key=str)
    assert len(got) == 8
    assert (0, "a.example.org", "/es/x", "example.org/es/", "block") in got and (5, "example.org", "", None) in [g[:4] for g in got]
    assert all(g[1:4] == ("", "", None) for g in got if g[0] in (1, 2, 3, 4))
    assert url_rules.filter_urls(table.limit(0), queries.URL_RULES).count() == 0


def test_url_filter_runs_no_python(spark):
    text = queries.QUERIES["op9_url_rules"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "InArrow" not in text and "CartesianProduct" not in text


def test_texts_cut_in_blocks_equal_single_texts(monkeypatch):
    """Blocks of any size give what each text gives alone, and look up a chunk once however often it comes."""
    encoder = packing.Encoder(PATH)
    texts = ["", None, " ", "\n\n", "a" * 30_000, "\ta\tb é×÷ª İ x's I'll 12 ³", "x " * 4095, "x " * 4096, "word, " * 9000, "  z", "语言 <unk> e\u0301", ""]
    for size in (1, 10, 1000, 1 << 24):
        monkeypatch.setattr(packing, "BLOCK_BYTES", size)
        assert [*packing.cut_block(encoder, pa.array(["other", *texts]).slice(1), 16)] == [packing.cut(encoder, t, 16) for t in texts]
        assert [*packing.cut_block(encoder, pa.array(texts))] == [packing.cut(encoder, t) for t in texts]
    whole = b"".join(i.to_bytes(4, "little") for t in texts for i in encoder.tokenizer.encode(t or "", add_special_tokens=False).ids)
    data, starts = encoder.block(pa.array(texts))
    assert bytes(data[: starts[-1]]) == whole
    asked = []
    monkeypatch.setattr(encoder, "_plain", lambda chunk: asked.append(chunk) or b"")
    encoder.block(pa.array(["one two one\none"] * 50))
    assert sorted(asked) == ["one", "two"]
    assert [*packing.cut_block(encoder, pa.array([], pa.string()))] == []
