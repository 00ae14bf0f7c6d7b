from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardenry.llm import language_id, quality, toxicity

SF_DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def rated(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language_of_held_out_documents(docs):
    found = language_id.language_id(docs)
    assert all(r.held_out == is_held_out(r.doc_id) for r in found.collect())
    joined = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert joined.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_code_lengths_are_those_of_the_context_trees():
    """Every next byte's probabilities follow the counts and escapes, computed here one by one."""
    text = "abracadabra abrakadabra"
    data = b"   " + text.encode()
    counts = {}
    for i in range(3, len(data)):
        gram = int.from_bytes(data[i - 3 : i + 1], "big")
        counts[gram] = counts.get(gram, 0) + 1
    trees = language_id.build_trees([("x", g, n) for g, n in counts.items()])

    def bits(context, byte):
        follows = {}
        for g, n in counts.items():
            raw = g.to_bytes(4, "big")
            if raw[3 - len(context) : 3] == context:
                follows[raw[3]] = follows.get(raw[3], 0) + n
        total, kinds = sum(follows.values()), len(follows)
        if byte in follows:
            return np.log2((total + kinds) / follows[byte])
        below = bits(context[1:], byte) if context else 8.0
        return below + (np.log2((total + kinds) / kinds) if follows else 0)

    for other in ("abra", "cadabra!", "zzz", "abrakad ö"):
        raw = b"   " + other.encode()
        expected = sum(bits(raw[i - 3 : i], raw[i]) for i in range(3, len(raw)))
        assert trees.lengths(other)[0] == pytest.approx(expected, rel=1e-5)


def test_long_text_in_slices(monkeypatch):
    trees = language_id.build_trees([("x", 0x20202061, 3), ("x", 0x20206162, 2), ("y", 0x20616263, 5)])
    text = "abc " * 1000
    whole = trees.lengths(text)
    monkeypatch.setattr(language_id, "SLICE_BYTES", 77)
    assert trees.lengths(text) == pytest.approx(whole)


def test_language_of_odd_rows(odd, empty):
    rows = language_id.language_id(odd).collect()
    assert len(rows) == 11
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 6)} == {"und"}
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2)} == {"en"} and {r.lang_pred for r in rows if r.doc_id == 7} == {"de"}
    assert all(0 <= r.score <= 1 for r in rows) and language_id.language_id(empty).count() == 0


def test_toxicity_of_held_out_documents(docs, rated):
    joined = toxicity.toxicity(docs, rated).join(rated, "doc_id").where("held_out").collect()
    hits = [r.predicted for r in joined if r.toxic == 1]
    wrong = [r.predicted for r in joined if r.toxic == 0]
    assert sum(hits) / len(hits) > 0.95 and sum(wrong) / len(wrong) < 0.02


def test_kernel_and_table_agree():
    machine = toxicity.learn(["you idiot here", "an idiot there", "what an idiot", "idiot idiot"] * 3, ["you are here", "over there now", "what a day", "it is fine"] * 3)
    assert machine.probability(machine.margins(["idiot"])[0]) > 0.5 > machine.probability(machine.margins(["there"])[0])
    scorer = toxicity._Scorer(machine)
    assert scorer.top("my i d i o t") == scorer.top("my i*d-i0ot") == pytest.approx(machine.margins(["idiot"])[0])
    words = ["idiot", "there", "idiocy"]
    assert np.allclose(np.diag(toxicity._kernel(words, words)), 1, atol=0.35) and toxicity._kernel(words, words)[0, 2] > toxicity._kernel(words, words)[0, 1]


def plain_features(word):
    """Occurrences of three characters with at most two others between them and of four with at most one, each with its weight."""
    framed, out = f" {word} ", {}
    for size, most in ((3, 2), (4, 1)):
        for places in itertools.combinations(range(len(framed)), size):
            others = places[-1] - places[0] + 1 - size
            if others <= most:
                key = tuple(b - a for a, b in zip(places, places[1:])), "".join(framed[i] for i in places)
                out.setdefault(key[1], []).append(toxicity.DECAY**others)
    return {k: sum(v) for k, v in out.items()}, sum(w * w for v in out.values() for w in v)


def test_kernel_equals_brute_force():
    words = ["idiot", "i", "idioot", "xidiot", "moron", "aaaaaa", "réêen"]
    found = toxicity._kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            (x, nx), (y, ny) = plain_features(a), plain_features(b)
            assert found[i, j] == pytest.approx(sum(w * y.get(k, 0) for k, w in x.items()) / (nx * ny) ** 0.5)
    assert found[0, 2] > found[0, 4] and found[0, 3] > found[0, 4]


def test_toxic_words_that_come_singly_in_clean_texts():
    """A stem that clean texts hold once by chance, toxic ones in several words; nothing else tells them apart."""
    rng = np.random.default_rng(2)
    syllables = ["ra", "lo", "mi", "te", "ba", "su", "ko", "ne", "po", "du"]
    word = lambda: "".join(rng.choice(syllables, 3))
    stem = lambda: "zuxi" + "".join(rng.choice(syllables, 1))
    clean = [" ".join([*(word() for _ in range(30)), *([stem()] if i % 40 == 0 else [])]) for i in range(200)]
    toxic = [" ".join([*(word() for _ in range(30)), *(stem() for _ in range(4))]) for _ in range(60)]
    machine = toxicity.learn(toxic[:40], clean[:150])
    score = lambda text: machine.probability(toxicity._Scorer(machine).top(text))
    assert all(score(t) > 0.5 for t in toxic[40:]) and sum(score(t) > 0.5 for t in clean[150:]) <= 5


def test_long_toxic_texts_are_learned_from(spark, monkeypatch):
    filler = "the cat sat on the mat near the door. "
    rows = [(i, (filler * 30) + ("what an idiot you are. " * 5 if i % 2 else "") + filler * 30, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"), train_docs=1000).collect()
    machine = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), train_chars=1500)
    assert all(r.predicted == r.doc_id % 2 for r in found) and machine is not None
    assert machine.probability(toxicity._Scorer(machine).top("an idiot")) > 0.5 > machine.probability(toxicity._Scorer(machine).top("the mat"))


def test_toxicity_of_odd_rows(odd, empty, labels):
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}


def test_quality_of_held_out_documents(docs, rated):
    joined = quality.quality_classifier(docs, rated).join(rated, "doc_id").where("held_out").collect()
    right = [r.kept == (r.quality == 1) for r in joined]
    clean = [r.kept for r in joined if r.quality == 1]
    assert sum(right) / len(right) > 0.98 and sum(clean) / len(clean) > 0.99


def test_thresholds_are_ordered_and_learned():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    z = x @ np.array([2.0, -1.0, 0.0, 0.5])
    y = np.digitize(z, [-1.0, 0.5, 2.0])
    model = quality.fit(x, y, steps=600)
    assert (np.diff(model.thresholds) > 0).all() and model.grades == [0, 1, 2, 3]
    above = model.at_least(x)
    assert (np.diff(above, axis=1) <= 0).all() and (np.abs(above.sum(axis=1) - y) < 0.75).mean() > 0.9


def same_shape_texts(spark, seed=3, rows=600):
    """Sentences of ordinary case and punctuation, all of the same shape: bad ones differ in the words they hold alone."""
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(400)]
    pools = [vocabulary[:240], vocabulary[160:]]
    sentence = lambda pool: " ".join(rng.choice(pool, 8)).capitalize() + "."
    texts = [(i, " ".join(sentence(pools[i % 2]) for _ in range(5)), i % 2, 0) for i in range(rows)]
    return spark.createDataFrame(texts, "doc_id long, text string, quality int, toxic int")


def test_quality_sees_words(spark):
    texts = same_shape_texts(spark)
    found = quality.quality_classifier(texts.select("doc_id", "text"), texts.select("doc_id", "quality", "toxic")).where("held_out").collect()
    right = [r.kept == (r.doc_id % 2 == 1) for r in found]
    assert len(right) > 80 and sum(right) / len(right) > 0.95


def test_quality_features_in_slices(monkeypatch):
    text = "Über 12 Katzen, cats & dogs -- " * 20 + "\U0001f600 漢字 END"
    index, value = quality.features(text)
    monkeypatch.setattr(quality, "SLICE_CHARS", 7)
    sliced = quality.features(text)
    assert (index == sliced[0]).all() and value == pytest.approx(sliced[1])
    words, other = (set(quality.features(t)[0]) for t in ("one two", "two one"))
    assert words != other and (value**2).sum() == pytest.approx(1)


def test_quality_of_odd_rows(odd, empty, labels):
    rows = quality.quality_classifier(odd, labels).collect()
    assert len(rows) == 11
    assert quality.quality_classifier(empty, labels).count() == 0
    assert all(r.kept and r.tail_probability is None for r in quality.quality_classifier(odd, labels.limit(0)).collect())
    model = quality.train(odd, quality.ratings_of(labels))
    assert quality.keep_documents(odd, model).columns == odd.columns
