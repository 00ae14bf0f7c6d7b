"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenry.llm.common import held_out, nullable
from wardenry.session import broadcast_if_small

ORDER = 3
# Expected documents a language is learned from, and cells of the table of code lengths (four bytes each).
TRAIN_DOCS = 1500
TABLE_CELLS = 12_000_000
SLICE_BYTES = 1 << 19
UNKNOWN = "und"
_PAD = b" " * ORDER


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8")


@dataclass
class ContextTrees:
    """Code lengths in bits for every language, context of up to three bytes and next byte, as one table.

    ``row_of`` names the longest known context of any three symbols; ``bits[row, symbol]`` has a length per language.
    """

    langs: list[str]
    symbol_of: np.ndarray
    row_of: np.ndarray
    bits: np.ndarray

    @property
    def symbols(self) -> int:
        return self.bits.shape[1]

    def lengths(self, text: str) -> np.ndarray:
        """The code length of a whole text in each language."""
        data, total, k = _PAD + _bytes(text), np.zeros(len(self.langs)), self.symbols
        flat = self.bits.reshape(-1, len(self.langs))
        for at in range(ORDER, len(data), SLICE_BYTES):
            s = self.symbol_of[np.frombuffer(data, np.uint8, min(len(data) - at, SLICE_BYTES) + ORDER, at - ORDER)]
            rows = self.row_of[(s[:-3] * k + s[1:-2]) * k + s[2:-1]]
            total += flat.take(rows * k + s[3:], axis=0).sum(axis=0, dtype=np.float64)
        return total


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, rows): how often each run of four bytes occurs in texts (lang, text); three blanks stand before a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                b = np.frombuffer(_PAD + _bytes(text.as_py()), np.uint8).astype(np.int64)
                grams, counts = np.unique(((b[:-3] << 8 | b[1:-2]) << 8 | b[2:-1]) << 8 | b[3:], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], names=["lang", "gram", "rows"])

    return rows.mapInArrow(run, "lang string, gram long, rows long").groupBy("lang", "gram").agg(F.sum("rows").alias("rows"))


def build_trees(counts: list[tuple[str, int, int]], cells: int = TABLE_CELLS) -> ContextTrees:
    """Freeze counts (lang, four bytes as a number, occurrences) into code lengths.

    A context seen n times with d different successors gives a successor seen c times the probability c / (n + d), and escapes to
    the context without its oldest byte with d / (n + d); below the empty context all bytes are equally likely. A context that a
    language has not seen costs nothing. If the table would outgrow ``cells``, the rarest contexts are left out and served by shorter ones.
    """
    langs = sorted({lang for lang, _, _ in counts})
    seen = sorted({g >> 8 * i & 255 for _, g, _ in counts for i in range(ORDER + 1)})
    symbol_of = np.zeros(256, dtype=np.int32)
    symbol_of[seen] = np.arange(1, len(seen) + 1)
    k, n_langs = len(seen) + 1, len(langs)
    of = {lang: i for i, lang in enumerate(langs)}
    lang = np.array([of[x[0]] for x in counts])
    gram = np.array([x[1] for x in counts], dtype=np.int64)
    times = np.array([x[2] for x in counts], dtype=np.float64)
    parts = [symbol_of[gram >> 8 * i & 255].astype(np.int64) for i in range(ORDER, -1, -1)]  # oldest first
    # Contexts by (order, code); the code is read from the oldest byte on.
    contexts = [(0, np.zeros(1, np.int64), np.array([np.inf]))]
    for order in range(1, ORDER + 1):
        code = np.zeros(len(gram), np.int64)
        for part in parts[ORDER - order : ORDER]:
            code = code * k + part
        codes, back = np.unique(code, return_inverse=True)
        contexts.append((order, codes, np.bincount(back, times)))
    room = max(1, cells // (k * n_langs))
    uses = np.concatenate([c[2] for c in contexts])
    least = np.sort(uses)[-room] if len(uses) > room else 0
    bits = [np.full((1, k, n_langs), 8.0)]  # below the empty context
    row_of = np.zeros((k, k, k), dtype=np.int32)
    done, rows_before = {}, 1
    for order, codes, use in contexts:
        keep = codes[(use >= least) if order else slice(None)]
        code = np.zeros(len(gram), np.int64)
        for part in parts[ORDER - order : ORDER]:
            code = code * k + part
        at = np.minimum(np.searchsorted(keep, code), max(len(keep) - 1, 0))
        known = keep[at] == code if len(keep) else np.zeros(len(code), bool)
        cells_ = np.zeros(len(keep) * k * n_langs)
        np.add.at(cells_, (at[known] * k + parts[ORDER][known]) * n_langs + lang[known], times[known])
        c = cells_.reshape(len(keep), k, n_langs)
        n, d = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
        if order == 0:
            shorter = bits[0]
        else:
            tail = keep % k ** (order - 1)
            codes_below, first = done[order - 1]
            j = np.minimum(np.searchsorted(codes_below, tail), len(codes_below) - 1)
            rows = first + j
            rows = np.where(codes_below[j] == tail, rows, 1)
            shorter = np.concatenate(bits)[rows]
        with np.errstate(divide="ignore", invalid="ignore"):
            direct = np.log2(n + d) - np.log2(c)
            escape = np.log2(n + d) - np.log2(d) + shorter
        bits.append(np.where(n == 0, shorter, np.where(c > 0, direct, escape)))
        done[order] = (keep, rows_before)
        rows = np.arange(rows_before, rows_before + len(keep), dtype=np.int32)
        if order == 0:
            row_of[:] = 1
        elif order == 1:
            row_of[:, :, keep] = rows
        elif order == 2:
            row_of[:, keep // k, keep % k] = rows
        else:
            row_of[keep // (k * k), keep // k % k, keep % k] = rows
        rows_before += len(keep)
    return ContextTrees(langs, symbol_of, row_of.ravel(), np.concatenate(bits).astype(np.float32))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, cells: int = TABLE_CELLS) -> ContextTrees | None:
    """Learn from texts with a language whose key is not held out: per language an expected ``train_docs`` documents, chosen by hash.

    What reaches the driver are counts of byte runs in that bounded sample. None if there is nothing to learn from.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(id_col), F.lit(1 << 20)).alias("draw")
    )
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    share = F.lit(train_docs * float(1 << 20)) / F.col("rows")
    # One row a language, as the trees hold: with a broadcast the corpus is not shuffled by its few languages.
    drawn = rows.join(broadcast_if_small(sizes), "lang").where(F.col("draw") < share).select("lang", "text")
    counts = [(r["lang"], r["gram"], r["rows"]) for r in gram_counts(drawn).collect()]
    return build_trees(counts, cells) if counts else None


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, trees: ContextTrees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``lang_pred``, ``score``): the language with the shortest code for the whole text and its share of the probability.

    ``und`` with score 0 for texts that are null or have no letter, and for all texts if nothing was learned. Ties go to the language
    that sorts first. Rows are judged each on its own, where they are read.
    """
    rows = docs.select(id_col, has_letter(F.col(text_col)).alias("__letter"), F.col(text_col).cast("string").alias("__text"))
    schema = nullable(rows.select(id_col, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs, scores = [], []
            for letter, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                if not letter or model is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                bits = model.lengths(text.as_py())
                best = int(bits.argmin())
                langs.append(model.langs[best])
                scores.append(float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Learn from ``docs`` and predict all of it: (``id_col``, ``held_out``, ``lang_pred``, ``score``). Repeated rows are predicted alike."""
    found = identify(docs, train(docs, id_col, text_col, lang_col, train_docs), id_col, text_col)
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
