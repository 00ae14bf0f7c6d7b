from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from wardenry.llm import spelling

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain_words(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= 7:
                total[word] += 1
    return {w: n for w, n in total.items() if n >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(words):
    out, form = {}, {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = len(others)
    def root(w):
        return w if form[w] is None else root(form[w])
    return {w: (form[w], root(w), words[w], out[w], words.get(form[w])) for w in words}


def corpus(seed, docs=60):
    """Words of one alphabet of few letters, so that many are near each other, and copies with one edit of frequent ones."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdéß") for _ in range(rng.randint(7, 9))) for _ in range(40)] + ["straßen", "Ümlaute", "ANAGRAMS", "margnsaa"]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(150):
            w = base[min(int(rng.expovariate(0.15)), len(base) - 1)]
            if rng.random() < 0.1:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcé") + w[at:], w[:at] + rng.choice("abcé") + w[at + 1 :]])
            words.append(w)
        rows.append((i, rng.choice([" ", ", ", "1"]).join(words)))
    return rows


def variants(df, **options):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(df, **options).collect()}


@pytest.mark.parametrize("bucket", [256, 2, 0])
def test_variants_equal_brute_force(spark, bucket):
    """Also with buckets so small that all words are parted once more by what is left of them without a letter."""
    rows = corpus(bucket)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_variants(plain_words(rows))
    assert variants(df, bucket=bucket) == want
    assert any(f for f, *_ in want.values()) and any(v[3] > 5 for v in want.values())


def test_chains_end_at_their_root(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "zzzzzzz": 3}
    found = {r.word: r.root for r in spelling.roots(spark.createDataFrame([("aaaaaaa", "aaaaaab"), ("aaaaaab", "aaaaabb"), ("aaaaabb", "aaaabbb")], "word string, form string"), max(counts.values())).collect()}
    assert found == dict.fromkeys(["aaaaaaa", "aaaaaab", "aaaaabb"], "aaaabbb")


def test_near_words_share_a_signature():
    """What PartEnum promises, for random words and all of their edits."""
    rng = random.Random(5)
    for _ in range(60):
        w = "".join(rng.choice("abcdefghéÿ") for _ in range(rng.randint(7, 12)))
        at = rng.randrange(len(w))
        edits = [w[:at] + x + w[at + 1 :] for x in "azé" if x != w[at]] + [w[:at] + x + w[at:] for x in "azé"]
        keys = [[(role, int(key[i])) for role, _, key in spelling.signatures([w, *edits])] for i in range(len(edits) + 1)]
        for edit, theirs in zip(edits, keys[1:]):
            if len(edit) == len(w):
                shared = {k for r, k in keys[0] if r == spelling.SAME} & {k for r, k in theirs if r == spelling.SAME}
            else:
                shared = {k for r, k in keys[0] if r == spelling.SHORTER} & {k for r, k in theirs if r == spelling.LONGER}
            assert shared


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    rows = corpus(9, 4) + [(77, "x" * 5000 + " " + "x" * 5000), (78, "漢字 aaaaaaaé漢aaaaaaaé")]
    monkeypatch.setattr(spelling, "SLICE_CHARS", 50)
    found = {r.word: r.n for r in spelling.count_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == plain_words(rows)


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()] * 3
    tripled = odd.unionByName(odd).unionByName(odd)
    assert variants(tripled) == plain_variants(plain_words(rows))
    assert spelling.spelling_variants(empty).count() == 0 and spelling.spelling_variants(odd.where("text IS NULL OR text = ''")).count() == 0
    clashing = spark.createDataFrame([(1, "Straßenbahn Straßenbahn", 5, "x", 1)], "doc_id long, text string, n int, word string, key int")
    assert variants(clashing) == plain_variants(plain_words([(1, "Straßenbahn Straßenbahn")]))
