"""Line deduplication: hashes of lines in sorted ranges, first occurrences streamed, and a bitmap of kept lines per document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenry.llm.common import frozen, nullable
from wardenry.operators.joins import lookup_join
from wardenry.session import broadcast_if_small

# Code points of a line, and documents that hold it, from which on it counts as repeated.
MIN_LENGTH, MIN_DOCS = 20, 3
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A null id stands for the smallest document.
NULL_ID = -(1 << 63)
# What the stream says of a line: drop it; its key crosses a border of the range; or a document that holds a key at a border.
DROP, OPEN, WITNESS = 0, 1, 2
_MARKS = "kind byte, h1 long, h2 long, id long, text_hash long, at int"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    known = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID).cast("long"))
    return docs.select(F.col(id_col).alias("own_id"), known.alias("id"), text.alias("text"), F.xxhash64(text, F.length(text)).alias("text_hash"))


def _line_hashes(documents: DataFrame, min_length: int) -> DataFrame:
    """(h1, h2, id, text_hash, at): 128 bits of the key of every line long enough, with its document and position."""
    lines = documents.select("id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    keys = lines.select("id", "text_hash", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_length)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"), "id", "text_hash", "at")


class _Range:
    """One sorted range of hashes, read batch by batch: documents of a key come in descending order.

    The first document of a key keeps its lines. Those of the second wait until a further one shows that there are enough; later ones
    are decided as they come. So what is held is one document's lines of one key. The first and the last key of a range may go on in
    its neighbours: lines that hang on them are handed on as OPEN, with the first documents of the key as WITNESS.
    """

    def __init__(self, min_docs: int):
        self.min_docs, self.key, self.first, self.docs, self.seen, self.waiting = min_docs, None, True, [], 0, []

    def batch(self, batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        if not batch.num_rows:
            return []
        h1, h2, ids = (batch.column(i).to_numpy() for i in range(3))
        new_key = np.concatenate([[self.key != (h1[0], h2[0])], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        new_doc = new_key.copy()
        new_doc[1:] |= ids[1:] != ids[:-1]
        new_doc[0] |= not new_key[0] and self.docs[-1] != ids[0]
        starts = np.flatnonzero(new_key)
        group = np.cumsum(new_key) - (1 if new_key[0] else 0)
        heads = starts if new_key[0] else np.concatenate([[0], starts])
        # The number of its document among those of its key, from 1.
        number = np.cumsum(new_doc)
        number -= (number[heads] - new_doc[heads])[group]
        if not new_key[0]:
            number[group == 0] += self.seen
        docs_of = np.maximum.reduceat(number, heads)
        out, ends = [], np.append(heads[1:], len(h1))
        inner = slice(0, 0)
        if len(heads) > 1:
            begin = 0
            if not new_key[0] or self.key is None:
                # The key that was open when this batch came, or the first key of the range.
                out += self._extend(batch, h1, h2, ids, number, heads[0], ends[0])
                begin = 1
            out += self._close(last=False)
            if begin < len(heads) - 1:
                inner = slice(heads[begin], heads[-1])
            whole = (docs_of[group[inner]] >= self.min_docs) & (number[inner] >= 2)
            out += self._rows(batch, np.flatnonzero(whole) + inner.start, DROP)
            self._open()
        elif new_key[0] and self.key is not None:
            out += self._close(last=False)
            self._open()
        out += self._extend(batch, h1, h2, ids, number, heads[-1], ends[-1])
        return out

    def _open(self) -> None:
        self.first, self.docs, self.seen, self.waiting = False, [], 0, []

    def _rows(self, batch: pa.RecordBatch, at: np.ndarray, kind: int) -> list[pa.RecordBatch]:
        if not len(at):
            return []
        taken = batch.take(pa.array(at))
        return [pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int8)), *taken.columns], names=["kind", *taken.schema.names])]

    def _extend(self, batch: pa.RecordBatch, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, number: np.ndarray, begin: int, end: int) -> list[pa.RecordBatch]:
        self.key = (h1[begin], h2[begin])
        mine = np.arange(begin, end)
        for n in range(self.seen + 1, self.min_docs + 1):
            found = np.flatnonzero(number[begin:end] == n)
            if len(found):
                self.docs.append(ids[begin + found[0]])
        last = int(number[end - 1])
        if last > len(self.docs):  # only the last document is compared with the next batch's
            self.docs = [*self.docs[: self.min_docs], ids[end - 1]]
        self.seen = last
        if self.first:
            return self._rows(batch, mine, OPEN)
        later = mine[number[begin:end] >= 2]
        if self.seen >= self.min_docs:
            return self._release(DROP) + self._rows(batch, later, DROP)
        self.waiting += self._rows(batch, later, DROP)
        return []

    def _release(self, kind: int) -> list[pa.RecordBatch]:
        out = [b.set_column(0, "kind", pa.array(np.full(b.num_rows, kind, np.int8))) for b in self.waiting]
        self.waiting = []
        return out

    def _close(self, last: bool) -> list[pa.RecordBatch]:
        if self.key is None:
            return []
        out = []
        if self.first or last:
            out = self._release(OPEN) if not self.first else []
            docs = np.array(self.docs[: self.min_docs], np.int64)
            k = len(docs)
            out.append(pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, WITNESS, np.int8)), pa.array(np.full(k, self.key[0])), pa.array(np.full(k, self.key[1])), pa.array(docs), pa.array(np.zeros(k, np.int64)), pa.array(np.zeros(k, np.int32))],
                names=["kind", "h1", "h2", "id", "text_hash", "at"]))
        self.waiting = []
        return out

    def end(self) -> list[pa.RecordBatch]:
        return self._close(last=True)


def repeated_lines(documents: DataFrame, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, text_hash, at) of the lines to drop.

    Hashes are range-partitioned together with their document, so a key of any size is dealt over as many ranges as it fills, and
    sorted by document, largest first, and position. Only keys at the borders of ranges, two a range, are settled in a further step.
    """
    hashes = _line_hashes(documents, min_length)
    order = ["h1", "h2", F.desc("id"), "text_hash", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Range(min_docs)
        for batch in batches:
            yield from found.batch(batch)
        yield from found.end()

    marks = frozen(hashes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _MARKS), "lines")
    border = marks.where(F.col("kind") == WITNESS).select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("stays"))
    settled = lookup_join(marks.where(F.col("kind") == OPEN), broadcast_if_small(border.where(F.col("docs") >= min_docs)), ["h1", "h2"], "inner").where(F.col("id") < F.col("stays"))
    return marks.where(F.col("kind") == DROP).select("id", "text_hash", "at").unionByName(settled.select("id", "text_hash", "at"))


def _packed(flags: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(flags, bitorder="little").tobytes(), 1)


def bitmap_of(packed: bytes | None, lines: int) -> np.ndarray:
    """The flags of a compressed bitmap, one for each of ``lines`` lines; those behind its end are False."""
    flags = np.zeros(lines, bool)
    if packed:
        held = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), bitorder="little")[:lines].astype(bool)
        flags[: len(held)] = held
    return flags


def dropped_bitmaps(dropped: DataFrame) -> DataFrame:
    """(id, text_hash, n_dropped, dropped): for each document that loses lines their number and a compressed bitmap of them."""
    keys = ["id", "text_hash"]
    # Rows with equal id and text each name the same lines.
    ordered = dropped.distinct().repartition(*keys).sortWithinPartitions(*keys, "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def closed(found: list[tuple]) -> pa.RecordBatch:
            ids, hashes, counts, maps = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], names=["id", "text_hash", "n_dropped", "dropped"])

        def one() -> tuple:
            at = np.concatenate(held)
            flags = np.zeros(int(at[-1]) + 1, bool)
            flags[at] = True
            return (*now, len(at), _packed(flags))

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, hashes, at = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])) + 1, [len(ids)]])
            found = []
            for begin, end in zip(cuts[:-1], cuts[1:]):
                key = (int(ids[begin]), int(hashes[begin]))
                if key != now:
                    if held:
                        found.append(one())
                    now, held = key, []
                held.append(at[begin:end])
            if found:
                yield closed(found)
        if held:
            yield closed([one()])

    return ordered.mapInArrow(run, "id long, text_hash long, n_dropped long, dropped binary")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """Drop lines that many documents share from all but the largest id among them.

    Returns every row with ``id_col``, ``n_lines`` (before), ``n_dropped``, ``kept_sha256`` (of the lines that stay, joined by line ends)
    and ``keep``, the compressed bitmap of kept lines (``bitmap_of`` reads it); ``kept_text`` makes texts of it. A null text is
    empty, an empty text is one empty line. Ids are whole numbers; rows of equal id are one document that holds the lines of all of them,
    and rows with a null id are one document, the smallest. Lines shorter than ``min_length`` always stay. An empty table gives no rows;
    other columns are not read.
    """
    return _with_bitmaps(docs, id_col, text_col, min_length, min_docs, False)


def kept_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """(``id_col``, ``text_col``): every row with the lines that ``line_dedup`` keeps."""
    return _with_bitmaps(docs, id_col, text_col, min_length, min_docs, True)


def _with_bitmaps(docs: DataFrame, id_col: str, text_col: str, min_length: int, min_docs: int, as_text: bool) -> DataFrame:
    documents = _documents(docs, id_col, text_col)
    maps = dropped_bitmaps(repeated_lines(documents, min_length, min_docs))
    joined = lookup_join(documents, broadcast_if_small(frozen(maps, "bitmaps")), ["id", "text_hash"], "left").select("own_id", "text", F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "dropped")
    names = [id_col, text_col] if as_text else [id_col, "n_lines", "n_dropped", "keep", "kept"]
    text_part = [F.lit("").alias(text_col)] if as_text else [F.lit(0).cast("long").alias("n_lines"), "n_dropped", F.lit(b"").alias("keep"), F.lit("").alias("kept")]
    schema = nullable(joined.select(F.col("own_id").alias(id_col), *text_part).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keeps, texts = [], [], []
            for text, dropped in zip(batch.column(1), batch.column(3)):
                text, dropped = text.as_py(), dropped.as_py()
                lines = text.split("\n") if dropped is not None else None
                n = text.count("\n") + 1
                keep = ~bitmap_of(dropped, n)
                texts.append(text if lines is None else "\n".join(line for line, stays in zip(lines, keep) if stays))
                if not as_text:
                    counts.append(n)
                    keeps.append(_packed(keep))
            kept = pa.array(texts, pa.string())
            columns = [batch.column(0), kept] if as_text else [batch.column(0), pa.array(counts, pa.int64()), batch.column(2), pa.array(keeps, pa.binary()), kept]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = joined.mapInArrow(run, schema)
    return out if as_text else out.select(id_col, "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"), "keep")
