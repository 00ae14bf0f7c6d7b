"""Near-duplicates by SimHash fingerprints and a pigeonring filter."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenry.llm.common import components, frozen

SHINGLE_WORDS = 3
SEED = 42
THRESHOLD = 3
# A ring of eight segments of eight bits.
SEGMENTS, SEGMENT_BITS = 8, 8
# Fingerprints of one signature that are compared with each other; a fuller signature is refined first.
BUCKET = 256
# Bytes of a text that are in words at a time.
SLICE_BYTES = 1 << 20
_BLANK = b" \t\n\x0b\x0c\r"


def _slices(data: bytes) -> Iterator[bytes]:
    """``data`` in slices that end between words."""
    at, size = 0, len(data)
    while at < size:
        end = min(size, at + SLICE_BYTES)
        while end < size and data[end] not in _BLANK:
            end += 1
        yield data[at:end]
        at = end


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed integer; 0 if it has no word."""
    counts, total, carried = np.zeros(64, dtype=np.int64), 0, []
    digest = xxhash.xxh64_intdigest

    def add(hashes: list[int]) -> None:
        nonlocal counts, total
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)

    for part in _slices((text or "").encode("utf-8").lower()):  # bytes.lower() changes A-Z alone
        words = carried + part.split()  # bytes.split() parts at 0x20 and 0x09 to 0x0D alone
        if len(words) >= shingle:
            line = b" ".join(words)
            ends = list(accumulate(map(len, words), lambda done, size: done + 1 + size))
            starts = [0, *(end + 1 for end in ends)]
            add([digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])])
        carried = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
    if not total:
        if not carried:
            return 0
        add([digest(b" ".join(carried), seed)])
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(``id_col``, ``text_hash``, ``fp``) of every row; ``text_hash`` tells rows of one id apart."""
    rows = docs.select(F.col(id_col), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(x.as_py(), shingle, seed) for x in batch.column(2)], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], names=[id_col, "text_hash", "fp"])

    return rows.mapInArrow(run, rows.select(id_col, "text_hash", F.lit(0).cast("long").alias("fp")).schema)


def _segment_masks() -> list[int]:
    return [((1 << SEGMENT_BITS) - 1) << (SEGMENT_BITS * i) for i in range(SEGMENTS)]


def first_masks() -> list[int]:
    """Signatures that every linked pair shares at least one of, by the pigeonring principle.

    With ``THRESHOLD`` differing bits on a ring of m segments there is a start from which every chain of l segments differs in at
    most ``l * THRESHOLD / m`` bits. For 3 bits and 8 segments chains of 1 and 2 segments allow none and chains of 3 to 5 allow
    one: two equal segments, and at most one differing segment among the next three. A mask has those four segments, 32 bits.
    """
    parts = _segment_masks()
    at = lambda i: parts[i % SEGMENTS]
    return [at(i) | at(i + 1) | at(i + x) | at(i + y) for i in range(SEGMENTS) for x, y in ((2, 3), (2, 4), (3, 4))]


def refined(mask: int) -> list[int]:
    """Masks of which every linked pair that agrees on ``mask`` agrees on at least one: its free bits in more parts than can differ."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // (THRESHOLD + 1) for k in range(THRESHOLD + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def chain_holds(difference: Column) -> Column:
    """True if from some segment on all chains of the ring keep within their proportional budgets."""
    ones = [F.bit_count(difference.bitwiseAND(_long(m))) for m in _segment_masks()]
    starts = []
    for i in range(SEGMENTS):
        total, holds = F.lit(0), F.lit(True)
        for length in range(1, SEGMENTS + 1):
            total = total + ones[(i + length - 1) % SEGMENTS]
            holds = holds & (total <= length * THRESHOLD // SEGMENTS)
        starts.append(holds)
    found = starts[0]
    for holds in starts[1:]:
        found = found | holds
    return found


def _long(mask: int) -> Column:
    return F.lit(_signed(mask)).cast("long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    table = F.array(*(_long(m) for m in masks))
    return fps.select("fp", F.explode(table).alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def links(fps: DataFrame) -> DataFrame:
    """All pairs (a < b) of distinct fingerprints with at most ``THRESHOLD`` differing bits, out of ``fps`` (one column, distinct).

    A signature's fingerprints are compared with each other while there are at most ``BUCKET`` of them. Fuller signatures are
    refined by ``THRESHOLD + 1`` longer ones each, again and again, until none is too full. So no link is lost, and the pairs that
    are tried grow with the rows, however many fingerprints lie close together. A pair may come several times.
    """
    keyed, found = _keyed(fps.select("fp"), first_masks()), []
    while True:
        sizes = frozen(keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "buckets")
        fit = keyed.join(sizes.where(F.col("rows") <= BUCKET).drop("rows"), ["mask", "key"])
        full = fit.groupBy("mask", "key").agg(F.sort_array(F.collect_list("fp")).alias("all"))
        pairs = full.select(F.posexplode("all").alias("at", "a"), "all").select("a", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("b"))
        apart = F.col("a").bitwiseXOR(F.col("b"))
        found.append(frozen(pairs.where(chain_holds(apart)).where(F.bit_count(apart) <= THRESHOLD), "pairs"))
        wide = sizes.where(F.col("rows") > BUCKET)
        # Only the masks of full signatures come to the driver, never their fingerprints: a few numbers of a fixed family.
        over = [r["mask"] for r in wide.select("mask").distinct().collect()]
        if not over:
            break
        finer = fps.sparkSession.createDataFrame([(m, _signed(f)) for m in over for f in refined(m & ((1 << 64) - 1))], "mask long, finer long")
        crowded = keyed.join(wide.drop("rows"), ["mask", "key"]).select("fp", "mask").join(F.broadcast(finer), "mask")
        keyed = frozen(crowded.select("fp", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key")).distinct(), "finer")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """Near-duplicate classes: one row per input row with ``id_col``, ``text_hash``, ``fingerprint``, ``component_id``, ``kept``.

    Texts are lower-cased in A-Z and cut into words of anything but blanks; a text of fewer words than a shingle counts as one
    shingle, and one without words (null or empty too) has fingerprint zero, linked like any other. Fingerprints that differ in at
    most three bits are linked; ``component_id`` is the smallest id reachable (null if all are null). ``kept`` marks the row of that
    id, of several the one whose text hash is smallest; rows equal in id and text share one mark. An empty table gives no rows.
    """
    rows = frozen(with_fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("text_hash").alias("hash"))
    fps = frozen(rows.groupBy("fp").agg(F.min(order).alias("least")), "fingerprints")
    joined = components(links(fps))
    classed = fps.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class", F.coalesce("component", "fp"))
    least = classed.groupBy("class").agg(F.min("least").alias("first"))
    named = frozen(classed.select("fp", "class").join(least, "class").select("fp", "first"), "classes")
    return rows.join(named, "fp").select(
        id_col, "text_hash", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.id").alias("component_id"),
        (F.col(id_col).eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.hash"))).alias("kept"),
    )
