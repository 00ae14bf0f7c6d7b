"""Hard-negative mining by slot-decomposed selection over blocks of integer inner products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardenry.llm.common import frozen, groups_of
from wardenry.operators.joins import lookup_join

# Anchors are the rows whose id this divides; an anchor's positives, and the negatives of each.
ANCHORS, POSITIVES, NEGATIVES = 50, 5, 3
# A negative scores between these percentages of the positive.
LEAST, MOST = 50, 95
# Vectors and anchors of a block, of at most so many components on average, and anchors whose scores are in memory at a time.
BLOCK, BLOCK_COMPONENTS, CHUNK = 8192, 1 << 22, 256
# Components are integers of at most this size, so that an inner product of up to 2^14 of them fits a long.
SCALE, COMPONENT = 256.0, 1 << 24


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows that take part: (row, id, label, vector of integers), ``row`` a number of its own for each.

    Rows with a null label, a null vector or a null or non-finite component are left out. Where 7 divides the id, the label becomes
    ``(label + 1) % 10``. Components become ``floor(256 * x)``, at most ``COMPONENT`` in size.
    """
    x = F.col(vector_col).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    moved = F.when(F.coalesce(F.col(id_col) % 7 == 0, F.lit(False)), (F.col(label_col).cast("long") + 1) % 10).otherwise(F.col(label_col).cast("long"))
    number = F.transform(x, lambda v: F.least(F.greatest(F.floor(v * SCALE).cast("double"), F.lit(-float(COMPONENT))), F.lit(float(COMPONENT))).cast("int"))
    found = vectors.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(whole)
    # Numbers of rows are stable once they are written.
    return frozen(found.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), moved.alias("label"), number.alias("vector")), "vectors")


def _block(row: str, blocks: Column | int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(blocks) if isinstance(blocks, int) else blocks).cast("int")


def _copies(blocks: Column | int) -> Column:
    return F.explode(F.sequence(F.lit(0), (F.lit(blocks) if isinstance(blocks, int) else blocks) - 1))


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """The vectors of ``size`` components as rows of a matrix of doubles."""
    values = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _by_size(table: pa.Table) -> dict[int, np.ndarray]:
    """Positions of rows by the size of their vectors: vectors of different sizes have no score with each other."""
    sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(table.column("vector")).to_pylist()], dtype=np.int64)
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products. Doubles hold them exactly below 2^53; larger ones are summed as integers."""
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    most = np.linalg.norm(anchors, axis=1).max() * np.linalg.norm(rows, axis=1).max()
    if most < 2**23:
        return (anchors.astype(np.float32) @ rows.astype(np.float32).T).astype(np.int64)
    if most < 2**52:
        return (anchors @ rows.T).astype(np.int64)
    return anchors.astype(np.int64) @ rows.astype(np.int64).T


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    """Ids that order ties; a null id comes last."""
    return pa.compute.fill_null(column, np.iinfo(np.int64).max).to_numpy()


def _top(at: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` entries of each (at, slot): higher scores first, then smaller ids, then rows."""
    order = np.lexsort((rows, ids, -score, slot, at))
    a, s = at[order], slot[order]
    starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])])) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


_FOUND = "anchor long, slot int, score long, id long, row long"


def _found(parts: list[tuple[np.ndarray, ...]], ids: pa.ChunkedArray) -> pa.Table:
    names = ["anchor", "slot", "score", "id", "row"]
    if not parts:
        return pa.table({n: pa.array([], pa.int32() if n == "slot" else pa.int64()) for n in names})
    anchor, slot, score, at, row = (np.concatenate(c) for c in zip(*parts))
    return pa.table([pa.array(anchor), pa.array(slot.astype(np.int32)), pa.array(score), ids.take(pa.array(at)).combine_chunks().cast(pa.int64()), pa.array(row)], names=names)


def _select(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The combiner of a block of anchors and a block of rows: the first ``k`` rows of each anchor and slot.

    ``upper`` holds an anchor's slot limits in descending order: slot i takes scores up to ``upper[i]`` and above ``upper[i + 1]``;
    scores above the first limit or below ``least`` are in no slot. ``same`` asks for rows of the anchor's label but itself, else rows
    of another label are taken.
    """
    if not anchors.num_rows or not rows.num_rows:
        return _found([], rows.column("id"))
    row, ids, label = rows.column("row").to_numpy(), _ids(rows.column("id")), rows.column("label").to_numpy()
    here, own_label = anchors.column("row").to_numpy(), anchors.column("label").to_numpy()
    least, same = anchors.column("least").to_numpy(), anchors.column("same").to_numpy(zero_copy_only=False).astype(bool)
    limits = anchors.column("upper").to_pylist()
    width = max(map(len, limits))
    # Missing limits lie below every score, so that their slots stay empty.
    upper = np.array([u + [np.iinfo(np.int64).min] * (width - len(u)) for u in limits], dtype=np.int64)
    others = _by_size(rows)
    parts = []
    for size, mine in _by_size(anchors).items():
        theirs = others.get(size)
        if theirs is None:
            continue
        left = _matrix(anchors.column("vector").take(pa.array(mine)), size) if size else np.zeros((len(mine), 0))
        right = _matrix(rows.column("vector").take(pa.array(theirs)), size) if size else np.zeros((len(theirs), 0))
        for first in range(0, len(mine), CHUNK):
            at = mine[first : first + CHUNK]
            scores = _scores(left[first : first + CHUNK], right)
            fits = (scores >= least[at, None]) & (scores <= upper[at, 0][:, None])
            alike = own_label[at, None] == label[theirs][None, :]
            fits &= np.where(same[at, None], alike & (here[at, None] != row[theirs][None, :]), ~alike)
            a, r = np.nonzero(fits)
            score = scores[a, r]
            slot = (upper[at[a]] >= score[:, None]).sum(axis=1) - 1
            kept = _top(a, slot, score, ids[theirs[r]], row[theirs[r]], k)
            parts.append((here[at[a[kept]]], slot[kept], score[kept], theirs[r[kept]], row[theirs[r[kept]]]))
    return _found(parts, rows.column("id"))


def _mined(anchors: DataFrame, rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(anchor, slot, score, id, row): the first ``k`` of each anchor and slot over all blocks. Blocks hand on ``k`` rows a slot at most."""
    def combine(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _select(left, right, k)

    # Both sides come from one table: new columns tell them apart.
    left, right = (side.toDF(*side.columns) for side in (anchors, rows))
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(combine, _FOUND)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k)


def positives(vectors: DataFrame, anchors: DataFrame, block: int = BLOCK, count: int = POSITIVES) -> DataFrame:
    """(anchor, score, id, row, __rank): the first ``count`` other rows of each anchor's label. Labels are cut into blocks by their own size."""
    sizes = frozen(vectors.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("is_anchor")).alias("anchors")).where("anchors > 0").select(
        "label", F.ceil(F.col("rows") / block).cast("int").alias("row_blocks"), F.ceil(F.col("anchors") / block).cast("int").alias("anchor_blocks")), "labels")
    long = 1 << 62
    left = lookup_join(anchors, sizes, ["label"], "inner").select(
        "row", "label", "vector", F.array(F.lit(long).cast("long")).alias("upper"), F.lit(-long).cast("long").alias("least"), F.lit(True).alias("same"),
        _block("row", F.col("anchor_blocks")).alias("i"), _copies(F.col("row_blocks")).alias("j"), F.col("label").alias("group"))
    right = lookup_join(vectors, sizes, ["label"], "inner").select(
        "row", "id", "label", "vector", _block("row", F.col("row_blocks")).alias("j"), _copies(F.col("anchor_blocks")).alias("i"), F.col("label").alias("group"))
    return _mined(left, right, ["group", "i", "j"], count)


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK,
    every: int = ANCHORS, positive_count: int = POSITIVES, negative_count: int = NEGATIVES,
) -> DataFrame:
    """For each anchor and positive the highest rows of other labels that score between LEAST and MOST percent of the positive.

    Returns ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``; a score is the
    integer inner product with the anchor, higher ones come first, ties by smaller id. Anchors are the rows whose id ``every`` divides.
    A repeated row is a row like any other (it may be the positive of its copy, and the anchors of equal id each have their own rows);
    a null id is no anchor and comes last among ties. Vectors of different sizes have no score. An empty table gives no rows.

    An anchor's positives set upper limits, which cut the scores into disjoint slots. Anchors meet all rows block by block, and each
    block hands on the first rows of each slot alone. The windows of the positives overlap: each begins at its own limit, so merging
    the slots from its limit downwards answers it, for all positives from one pass over the scores.
    """
    rows = quantised(vectors, id_col, vector_col, label_col).withColumn("is_anchor", F.coalesce(F.col("id") % every == 0, F.lit(False)))
    anchors = rows.where("is_anchor")
    total, components = rows.agg(F.count(F.lit(1)), F.sum(F.size("vector"))).first()
    block = max(CHUNK, min(block, BLOCK_COMPONENTS // max((components or 0) // max(total, 1), 1)))
    best = frozen(positives(rows, anchors, block, positive_count).select("anchor", F.col("__rank").alias("place"), "id", "score"), "positives")
    # The largest and smallest whole numbers with 100 * negative <= MOST * positive and 100 * negative >= LEAST * positive.
    upper = F.expr(f"(score * {MOST} - pmod(score * {MOST}, 100)) div 100")
    lower = F.expr(f"(score * {LEAST} + pmod(-score * {LEAST}, 100)) div 100")
    bounded = best.select("anchor", "place", "id", "score", upper.alias("upper"), lower.alias("lower")).where("lower <= upper")
    limits = bounded.groupBy("anchor").agg(
        F.sort_array(F.collect_set("upper"), asc=False).alias("upper"), F.min("lower").alias("least"),
        F.collect_list(F.struct("place", "id", "score", "upper", "lower")).alias("windows"))
    limits = frozen(limits, "limits")
    row_blocks, anchor_blocks = groups_of(total, block), groups_of(limits.count(), block)
    left = anchors.join(limits.withColumnRenamed("anchor", "row"), "row").select(
        "row", "label", "vector", "upper", "least", F.lit(False).alias("same"), _block("row", anchor_blocks).alias("i"), _copies(row_blocks).alias("j"))
    right = rows.select("row", "id", "label", "vector", _block("row", row_blocks).alias("j"), _copies(anchor_blocks).alias("i"))
    slots = _mined(left, right, ["i", "j"], negative_count)
    # At most negative_count rows for each of an anchor's slots.
    held = slots.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("id").isNull().alias("last"), "id", "row"))).alias("found"))
    merged = held.join(limits.select("anchor", "windows"), "anchor").select("anchor", "found", F.explode("windows").alias("w"))
    below = F.filter("found", lambda x: (-x["less"] <= F.col("w")["upper"]))
    chosen = F.filter(F.slice(below, 1, negative_count), lambda x: -x["less"] >= F.col("w")["lower"])
    out = merged.select("anchor", "w", F.posexplode(chosen).alias("at", "x"))
    return out.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select(
        "anchor_id", F.col("w")["id"].alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("x")["id"].alias("negative_id"),
        F.col("w")["score"].alias("positive_score"), (-F.col("x")["less"]).alias("negative_score"))
