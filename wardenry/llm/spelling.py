"""Spelling variants: words one edit apart, found by PartEnum signatures over letter multisets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenry.llm.common import frozen
from wardenry.operators.joins import lookup_join
from wardenry.session import broadcast_if_small

# Least code points and occurrences of a word; a form occurs at least so many times as often as the word.
MIN_LENGTH, MIN_COUNT, FORM_RATIO = 7, 2, 10
# One occurrence of a word in a document in so many loses a letter.
NOISE = 31
LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A text is cut into words in slices of about so many characters.
SLICE_CHARS = 1 << 20
# PartEnum by size of the multisets, as (role, letters more than the shorter word has, differing places, parts): the dimensions are
# dealt over the parts and a signature leaves out as many parts as places may differ, so that near words share a signature.
# A replaced letter differs in two places among words of one length, a further letter in one place among lengths m and m + 1.
SAME, SHORTER, LONGER = 0, 1, 2
CLASSES = ((SAME, 0, 2, 4), (SHORTER, 0, 1, 2), (LONGER, 1, 1, 2))
# Words of a signature that are compared with each other; the words of a larger one are parted once more, by what is left of them without a letter.
BUCKET = 256


def noisy_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All words of ``docs``, one row ``(word)`` each occurrence.

    A word is a maximal run of letters with A-Z in lower case. Where the CRC-32 of ``<id>:<word>`` (a null id is ``null``) is a
    multiple of NOISE, the occurrence loses the letter at that CRC modulo its length. Long texts are cut behind a run of letters.
    """
    text = F.col(text_col).cast("string")
    slices = F.when(F.length(text) <= SLICE_CHARS, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SLICE_CHARS}}}{LETTERS}*+"), F.lit(0)))
    cut = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.explode(slices).alias("part"))
    runs = cut.select("id", F.explode(F.regexp_extract_all("part", F.lit(f"{LETTERS}+"), F.lit(0))).alias("run"))
    # ``lower`` is fast and right for ASCII alone; other runs keep the case of their other letters.
    lowered = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    words = runs.select("id", lowered.alias("run")).select("run", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")).alias("crc"))
    at = (F.col("crc") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return words.select(F.when(F.col("crc") % NOISE == 0, less).otherwise(F.col("run")).alias("word"))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of words with MIN_LENGTH code points and MIN_COUNT occurrences or more; counts combine before they are shuffled."""
    long = noisy_words(docs, id_col, text_col).where(F.length("word") >= MIN_LENGTH)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Words:
    """Code points of many words, and hashes of their starts and ends."""

    def __init__(self, words: list[str]):
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
        self.owner = np.repeat(np.arange(len(words)), self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        at = np.arange(len(self.codes)) - self.starts[self.owner]
        back = self.lengths[self.owner] - 1 - at
        zero = np.zeros(1, np.uint64)
        self._heads = np.concatenate([zero, np.cumsum(self.codes * _mix(at.astype(np.uint64) + np.uint64(99)))])
        self._tails = np.concatenate([zero, np.cumsum(self.codes * _mix(back.astype(np.uint64) + np.uint64(1099)))])

    def head(self, letters: np.ndarray) -> np.ndarray:
        return self._heads[self.starts + letters] - self._heads[self.starts]

    def tail(self, letters: np.ndarray) -> np.ndarray:
        ends = self.starts + self.lengths
        return self._tails[ends] - self._tails[ends - letters]

    def multisets(self, parts: int) -> np.ndarray:
        """A hash of each word's letter multiset in each part of the dimensions; a dimension is a letter and how often it came before."""
        order = np.lexsort((self.codes, self.owner))
        owner, codes = self.owner[order], self.codes[order]
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (codes[1:] != codes[:-1])]))
        before = np.arange(len(owner)) - np.repeat(new, np.diff(np.append(new, len(owner))))
        out = np.zeros(len(self.lengths) * parts, np.uint64)
        part = (codes.astype(np.int64) + 3 * before) % parts
        np.add.at(out, owner * parts + part, _mix(codes * np.uint64(1_000_003) + before.astype(np.uint64) + np.uint64(7)))
        return out.reshape(-1, parts)


def signatures(words: list[str]) -> list[tuple[int, int, np.ndarray]]:
    """For each signature (role, side, key of every word): words one edit apart share a key, one of them as SAME or as SHORTER and LONGER.

    A key joins the PartEnum signature with the letters of one half. One edit leaves the letters before it and behind it as they
    are, so the first (side 0) or the last half (side 1) of the shorter word is in both.
    """
    found = _Words(words)
    out = []
    for role, more, places, parts in CLASSES:
        shorter = found.lengths - more
        # Letters that an edit leaves at one of both ends: of m - 1 beside a replaced letter, of m beside a further one.
        half = (shorter - (role == SAME) + 1) // 2
        multisets = found.multisets(parts)
        whole = multisets.sum(axis=1)
        for number, left_out in enumerate(combinations(range(parts), places)):
            tag = np.uint64(((2 * number + 1) * 0xD6E8FEB86659FD93 + (role != SAME)) % 2**64)
            signature = _mix(whole - multisets[:, list(left_out)].sum(axis=1) + tag)
            for side, ends in enumerate((found.head(half), found.tail(half))):
                key = _mix(signature ^ _mix(ends + np.uint64(side))) + shorter.astype(np.uint64)
                out.append((role, side, key.view(np.int64)))
    return out


def _keyed(words: DataFrame) -> DataFrame:
    """(key, role, side, word, n): a row for each signature of each word."""
    layout = [(role, side) for role, _, places, parts in CLASSES for _ in combinations(range(parts), places) for side in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.stack([key for _, _, key in signatures(batch.column(0).to_pylist())], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["word", "n", "keys"])

    found = words.select("word", "n").mapInArrow(run, "word string, n long, keys array<long>")
    entry = lambda i: F.struct(F.get("keys", F.lit(i)).alias("key"), F.lit(layout[i][0]).cast("byte").alias("role"), F.lit(layout[i][1]).cast("byte").alias("side"))
    return found.select(F.explode(F.array(*map(entry, range(len(layout))))).alias("s"), "word", "n").select("s.key", "s.role", "s.side", "word", "n")


def _near(a: str, b: str) -> Column:
    return F.levenshtein(F.col(a), F.col(b), 1) == 1


def _pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Verified near words (a, a_n, b, b_n) of equal ``on``; the comparison is part of the join, so other pairs are never rows."""
    a = left.select(*on, F.col("role").alias("a_role"), F.col("side").alias("a_side"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = right.select(*(F.col(c).alias(f"__{c}") for c in on), F.col("role").alias("b_role"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    condition = F.lit(True)
    for c in on:
        condition = condition & (F.col(c) == F.col(f"__{c}"))
    same = (F.col("a_role") == SAME) & (F.col("b_role") == SAME) & (F.col("a") < F.col("b"))
    longer = (F.col("a_role") == SHORTER) & (F.col("b_role") == LONGER)
    # Words that share both halves are met on the first side.
    half = F.floor((F.length("a") - F.when(F.col("a_role") == SAME, 1).otherwise(0) + 1) / 2).cast("int")
    first = (F.col("a_side") == 0) | (F.left("a", half) != F.left("b", half))
    return a.join(b, condition & (same | longer) & first & _near("a", "b")).select("a", "a_n", "b", "b_n")


def _without_a_letter(rows: DataFrame) -> DataFrame:
    """Rows of large buckets once for each letter they can lose: (key, rest, at). Shorter words come as they are.

    Words of one length that are one edit apart leave the same rest at the same place, and a longer one leaves the shorter.
    """
    places = F.when(F.col("role") == SHORTER, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.length("word") - 1))
    split = rows.withColumn("__at", F.explode(places))
    less = F.concat(F.substring("word", F.lit(1), F.col("__at")), F.substring("word", F.col("__at") + 2, F.length("word")))
    rest = F.xxhash64(F.when(F.col("__at") < 0, F.col("word")).otherwise(less))
    return split.select("key", rest.alias("rest"), F.when(F.col("role") == SAME, F.col("__at")).otherwise(-1).alias("at"), "role", "side", "word", "n")


def near_words(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """All pairs (a, a_n, b, b_n) of ``words`` (word, n; distinct, MIN_LENGTH or longer) at edit distance one; a pair may come more than once.

    Signatures are joined with each other and what they meet is verified. A signature of more than ``bucket`` words is first parted by
    what its words are without one letter: there only near words meet, at most one a letter of the alphabet and place.
    """
    keyed = _keyed(words)
    large = broadcast_if_small(frozen(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > bucket).select("key"), "large"))
    usual = lookup_join(keyed, large, ["key"], "left_anti")
    parted = _without_a_letter(lookup_join(keyed, large, ["key"], "left_semi"))
    return _pairs(usual, usual, ["key"]).unionByName(_pairs(parted, parted, ["key", "rest", "at"]))


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root): the end of the chain of forms, for words that have a form.

    Each step of a chain multiplies the occurrences by FORM_RATIO, so chains end, and ``most`` occurrences bound their length. A round
    doubles the steps that are followed.
    """
    ends = frozen(forms.select("word", F.col("form").alias("root")), "roots")
    longest = max(1, math.ceil(math.log(max(most, 2), FORM_RATIO)))
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = frozen(ends.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return ends


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Group the words of a corpus with the spelling they vary from.

    Returns one row a word: ``word``, ``form`` (its near word with the most occurrences, ties by code point order, if that has at least
    FORM_RATIO times its own; else null), ``root`` (the end of the chain of forms; the word itself without one), ``n``, ``n_near``
    (words at edit distance one) and ``form_n``. Null and empty texts hold no words; repeated rows count as often as they come; a
    null id spells as ``null``; an empty table gives no rows. Other columns are not read.
    """
    words = frozen(count_words(docs, id_col, text_col), "words")
    pairs = near_words(words, bucket)
    side = lambda w, o, n: F.struct(F.col(w).alias("word"), F.struct((-F.col(n)).alias("less"), F.col(o).alias("form")).alias("near"))
    sides = pairs.select(F.explode(F.array(side("a", "b", "b_n"), side("b", "a", "a_n"))).alias("s")).select("s.word", "s.near")
    # A word has a bounded number of near words: one for each letter of the alphabet and place at most.
    near = sides.groupBy("word").agg(F.collect_set("near").alias("near")).select("word", F.size("near").cast("long").alias("n_near"), F.array_min("near").alias("best"))
    joined = words.join(near, "word", "left")
    enough = -F.col("best")["less"] >= F.col("n") * FORM_RATIO
    found = frozen(joined.select(
        "word", F.when(enough, F.col("best")["form"]).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, -F.col("best")["less"]).alias("form_n"),
    ), "forms")
    most = found.agg(F.max("n")).first()[0] or 0
    ends = roots(found.where(F.col("form").isNotNull()), most)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
