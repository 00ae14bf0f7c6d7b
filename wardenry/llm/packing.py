"""Packing tokenised documents into sequences by bounded-space online packing."""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenry.llm.common import arrow_batches, bucket_of, frozen, groups_of

WINDOW = 4096
END_ID = 2
# Windows a packing group keeps open, and pieces in a group.
OPEN_WINDOWS = 64
GROUP_PIECES = 16_384
# Bytes of words, and of chunks, that a worker remembers, twice each, and what an entry takes beside its text and its ids.
REMEMBERED_BYTES, ENTRY_BYTES = 3 << 23, 80
SLICE_CHARS = 1 << 20
# Bytes of texts whose chunks are found together, at several times their size in memory; a longer text is cut on its own.
BLOCK_BYTES = 1 << 22
# Documents that come to a worker at a time: Spark holds a batch twice beside its heap, the worker once more.
BATCH_ROWS = 1000

# Text that needs nothing but lower case before it is cut: printable ASCII and the letters of Latin-1.
_PLAIN = re.compile(r"[\x21-\x3b\x3d-\x7eÀ-ÿ]+")
# The tokenizer's words in such text, in lower case.
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself if printable, else from U+0100 on in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class _Recent(dict):
    """A memo of two generations, each of at most ``limit`` bytes: what was not used since the last change is forgotten.

    An entry that would fill a sixteenth of a generation alone is made anew each time.
    """

    def __init__(self, make, limit: int = REMEMBERED_BYTES):
        self.make, self.limit, self.size, self.old = make, limit, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        size = ENTRY_BYTES + getsizeof(key) + getsizeof(value)
        if size > self.limit // 16:
            return value
        if self.size + size > self.limit:
            self.old, self.size = dict(self), 0
            self.clear()
        self[key] = value
        self.size += size
        return value


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary never joins text across white space, so a text's ids are those of its chunks between blanks, in order, and a chunk
    that was seen before is not tokenised again. Chunks of plain letters and signs are cut here as the tokenizer cuts them, and
    their words go to its model; any other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = _byte_letters()
        self.table = {b: letters[b] for b in range(256)}
        self.words = _Recent(self._word)
        self.chunks = _Recent(self._chunk)

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.table)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk):
            return self._plain(chunk)
        ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, chunk: str) -> bytes:
        text = chunk.lower()
        return self.words[text] if text.isalpha() else b"".join(map(self.words.__getitem__, _PRETOKEN.findall(text)))

    def __call__(self, text: str) -> Iterator[bytes]:
        at, size = 0, len(text)
        while at < size:
            end = min(size, at + SLICE_CHARS)
            while end < size and text[end] not in " \n":
                end += 1
            yield b"".join(map(self.chunks.__getitem__, text[at:end].replace("\n", " ").split(" ")))
            at = end

    def block(self, texts: pa.Array) -> tuple[memoryview, list[int]]:
        """Ids of many texts, null ones empty, behind one another, and where each text's begin, the end of all last.

        Arrow cuts the texts at blanks and numbers the chunks, so each different chunk of the block is looked up once. Only words, and
        chunks that are not plain, are remembered beyond the block.
        """
        chunks = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        numbered = chunks.flatten().dictionary_encode()
        # No chunk holds a blank, so all of them come to Python as one text.
        different = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(numbered.dictionary)], pa.int32()), numbered.dictionary), " ")[0].as_py().split(" ")
        plain, word, other = _PLAIN.fullmatch, self._plain, self.chunks
        ids = pa.array([word(c) if plain(c) else other[c] for c in different], pa.large_binary()).take(numbered.indices)
        _, ends, data = ids.buffers()
        first = np.frombuffer(ends, np.int64)[ids.offset : ids.offset + len(ids) + 1]
        return memoryview(data or b""), first[np.asarray(chunks.offsets) - chunks.offsets[0].as_py()].tolist()


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(encoder: Encoder, text: str | None, window: int = WINDOW, end_id: int = END_ID) -> tuple[int, list[tuple[int, int, int]]]:
    """A text's number of ids, its end id included, and its pieces (start, length, crc32 of the ids)."""
    pieces, start, waiting, most = [], 0, bytearray(), 4 * window

    def emit(until: int) -> None:
        nonlocal start
        pieces.append((start, until // 4, zlib.crc32(waiting[:until])))
        start += until // 4
        del waiting[:until]

    for ids in encoder(text or ""):
        waiting += ids
        while len(waiting) > most:
            emit(most)
    waiting += end_id.to_bytes(4, "little")
    while waiting:
        emit(min(most, len(waiting)))
    return start, pieces


def cut_block(encoder: Encoder, texts: pa.Array, window: int = WINDOW, end_id: int = END_ID) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """What ``cut`` gives for each text, in order; texts are taken together up to ``BLOCK_BYTES``."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    end, most, at = end_id.to_bytes(4, "little"), 4 * window, 0
    while at < len(texts):
        until = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK_BYTES, side="right")))
        if sizes[at] > BLOCK_BYTES:
            yield cut(encoder, texts[at].as_py(), window, end_id)
        else:
            data, starts = encoder.block(texts.slice(at, until - at))
            for first, last in zip(starts, starts[1:]):
                pieces = [((b - first) // 4, most // 4, zlib.crc32(data[b : b + most])) for b in range(first, last - most + 1, most)]
                rest = first + most * len(pieces)
                pieces.append(((rest - first) // 4, (last - rest) // 4 + 1, zlib.crc32(end, zlib.crc32(data[rest:last]))))
                yield (last - first) // 4 + 1, pieces
        at = until


def tokenised(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: (``id_col``, start, length, ids_crc32, doc_tokens, piece). Null texts count as empty: the end id alone."""
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))
    kinds = rows.select(id_col, *(F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32", "doc_tokens", "piece"))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = _encoder(tokenizer_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            at, columns = [], [[], [], [], [], []]
            for i, (tokens, pieces) in enumerate(cut_block(encoder, batch.column(1), window, end_id)):
                for start, length, crc in pieces:
                    at.append(i)
                    for column, value in zip(columns, (start, length, crc, tokens, number)):
                        column.append(value)
                    number += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=kinds.names)

    return rows.mapInArrow(run, kinds)


def place(lengths: list[int], window: int, open_windows: int) -> tuple[list[int], list[int], list[int], list[bool]]:
    """Bounded-space best fit, in order: each item's bin and offset, each bin's fill, and whether it was still open at the end.

    An item goes to the open window with the least room that holds it. If none does, and all windows are taken, the fullest is closed.
    """
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending: the first is the fullest
    bins, offsets, fills = [], [], []
    for length in lengths:
        at = bisect_left(rooms, (length, -1))
        if at < len(rooms):
            room, number = rooms.pop(at)
        else:
            if len(rooms) >= open_windows:
                rooms.pop(0)
            room, number = window, len(fills)
            fills.append(0)
        bins.append(number)
        offsets.append(fills[number])
        fills[number] += length
        if room > length:
            insort(rooms, (room - length, number))
    still = {number for _, number in rooms}
    return bins, offsets, fills, [n in still for n in range(len(fills))]


def _packed(items: DataFrame, level: int, groups: int, window: int, open_windows: int) -> DataFrame:
    """Items (item, length) in bins: (item, bin, fill, open, offset); bins have numbers of their own over all levels and groups."""
    dealt = items.withColumn("group", bucket_of([F.col("item"), F.lit(level)], groups))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("item")
        bins, offsets, fills, still = place(table["length"].to_pylist(), window, open_windows)
        first = (level << 58) | (key[0].as_py() << 24)
        return pa.table({
            "item": table["item"], "bin": pa.array([first + b for b in bins], pa.int64()), "fill": pa.array([fills[b] for b in bins], pa.int64()),
            "open": pa.array([still[b] for b in bins], pa.bool_()), "offset": pa.array(offsets, pa.int64()),
        })

    return dealt.groupBy("group").applyInArrow(run, "item long, bin long, fill long, open boolean, offset long")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, open_windows: int = OPEN_WINDOWS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` ids: one row per piece.

    Columns: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (gapless from 0 in a
    sequence). A document longer than a window is cut into full windows and a rest. Pieces are dealt into groups of bounded size;
    in each, ``open_windows`` windows stay open, a piece goes to the one it fits best, and the fullest is closed when none fits.
    Windows still open at a group's end are packed again as wholes, over groups of them, until one group is left. Repeated rows are
    documents of their own; null and empty texts are the end id alone; an empty table gives no rows.
    """
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        pieces = frozen(tokenised(docs, tokenizer_path, id_col, text_col, window, end_id), "pieces")
    items, count, level, maps = pieces.select(F.col("piece").alias("item"), "length"), pieces.count(), 0, []
    while True:
        groups = groups_of(count, group_pieces)
        bins = frozen(_packed(items, level, groups, window, open_windows), "bins")
        maps.append(bins)
        if groups == 1:
            break
        items = bins.where("open").groupBy(F.col("bin").alias("item")).agg(F.first("fill").alias("length"))
        level, count = level + 1, bins.where("open").select("bin").distinct().count()
    # A window that was packed again moves into the bin of the next level, from the last level down.
    placed = maps[-1].select("item", "bin", "offset")
    for bins in reversed(maps[:-1]):
        later = placed.select(F.col("item").alias("bin"), F.col("bin").alias("__into"), F.col("offset").alias("__from"))
        closed = bins.where("not open").select("item", "bin", "offset")
        moved = bins.where("open").join(later, "bin").select("item", F.col("__into").alias("bin"), (F.col("offset") + F.col("__from")).alias("offset"))
        placed = closed.unionByName(moved)
    return pieces.join(placed.withColumnRenamed("item", "piece"), "piece").select(id_col, "start", "length", "ids_crc32", "doc_tokens", F.col("bin").alias("sequence_id"), "offset")
