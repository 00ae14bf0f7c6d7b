"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import random
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenry.llm.common import GROUP_ROWS, frozen, ranked

WORD = r"[^ \t-\r]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
SEED = 7
# Probabilities this close to 0 or 1 are decided.
EPSILON = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(units: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """(source, rank, source_size, target) from units (source, size, rows).

    Sources by code point, null last, take the weights in turn and share all sizes by them. A target stops at ``most`` times its
    source's size, and what is above goes to the others by weight until none is above: the targets are ``min(level * weight,
    most * size)`` for the level at which they add up. The level is found by one aggregate a step; it rises with every step.
    """
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    turn = F.array(*(F.lit(float(w)) for w in weights))
    table = frozen(ranked(sizes, "source", "rank").withColumn("weight", F.get(turn, (F.col("rank") % len(weights)).cast("int"))), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, limit = 0.0, F.col("source_size") * float(most)
    while total:
        above = limit <= F.col("weight") * level
        capped, free = table.agg(F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight")))).first()
        if not free:
            break
        risen = (total - (capped or 0.0)) / free
        if risen <= level:
            break
        level = risen
    return table.select("source", "rank", "source_size", F.least(limit, F.col("weight") * level).alias("target"))


def _null_direction(sizes: list[float], count: bool) -> list[float] | None:
    """A move of these units that leaves the token total, and with ``count`` the document total, as they are."""
    if count:
        a, b, c = sizes
        move = [c - b, a - c, b - a]
        return move if any(move) else [1.0, -1.0, 0.0]
    a, b = sizes
    return [b, -a] if a or b else [1.0, -1.0]


def flight(chances: list[float], sizes: list[float], rng: random.Random, count: bool = True) -> list[float]:
    """Move the chances through the constraints' null space until at most as many are undecided as there are constraints.

    Each step takes the first undecided units, one more than constraints, and goes along their null direction to one of the two
    faces of the cube, with the odds that keep every expected value. ``count`` balances documents and tokens, else tokens alone.
    """
    chances, need = list(chances), 3 if count else 2
    pool: list[int] = []
    for k, chance in enumerate(chances):
        if not EPSILON < chance < 1 - EPSILON:
            chances[k] = float(round(chance))
            continue
        pool.append(k)
        if len(pool) < need:
            continue
        move = _null_direction([sizes[i] for i in pool], count)
        up = min((1 - chances[i]) / m if m > 0 else chances[i] / -m for i, m in zip(pool, move) if m)
        down = min(chances[i] / m if m > 0 else (1 - chances[i]) / -m for i, m in zip(pool, move) if m)
        step = up if rng.random() * (up + down) < down else -down
        for i, m in zip(pool, move):
            chances[i] += step * m
            if not EPSILON < chances[i] < 1 - EPSILON:
                chances[i] = float(round(chances[i]))
        pool = [i for i in pool if 0 < chances[i] < 1]
    return chances


def land(chances: list[float], sizes: list[float], rng: random.Random) -> list[float]:
    """Decide what the flight left over: first without the document total, then the last unit by its chance."""
    chances = flight(chances, sizes, rng, count=False)
    return [float(rng.random() < c) if 0 < c < 1 else c for c in chances]


def _fly(seed: int, level: int):
    """The flight of one block; that of a source's only block goes on to the landing."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rank, block, blocks = (k.as_py() for k in key)
        table = table.sort_by("unit")
        rng = random.Random(f"{seed}/{level}/{rank}/{block}")
        sizes = [float(x) for x in table["size"].to_pylist()]
        chances = flight(table["chance"].to_pylist(), sizes, rng)
        chances = land(chances, sizes, rng) if blocks == 1 else chances
        return pa.table({"unit": table["unit"], "rank": table["rank"], "size": table["size"], "chance": pa.array(chances, pa.float64())})

    return run


def _decide(units: DataFrame, seed: int, group_rows: int) -> DataFrame:
    """``extra`` 0 or 1 for each unit (unit, rank, size, chance): flights in blocks, then over what the blocks leave, to the landing."""
    left, done, level = units, [], 0
    while True:
        counts = left.groupBy("rank").agg(F.ceil(F.count(F.lit(1)) / group_rows).cast("long").alias("blocks"))
        dealt = left.join(counts, "rank").withColumn("block", F.pmod(F.xxhash64("unit", F.lit(level)), F.col("blocks")))

        moved = frozen(dealt.groupBy("rank", "block", "blocks").applyInArrow(_fly(seed, level), "unit string, rank long, size long, chance double"), "flights")
        open_ = (F.col("chance") > 0) & (F.col("chance") < 1)
        done.append(moved.where(~open_))
        left, level = moved.where(open_), level + 1
        if left.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("unit", F.col("chance").cast("long").alias("extra"))


def _unit(id_: Column, source: Column, size: Column) -> Column:
    none = F.lit("\0")
    return F.concat_ws("\1", F.coalesce(id_.cast("string"), none), size.cast("string"), F.coalesce(source.cast("string"), none))


def mix_units(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, group_rows: int = GROUP_ROWS) -> DataFrame:
    """How often the mix takes each document: (unit, id, rows, size, source_size, target, whole, more).

    A unit stands for the rows of equal id, source and size. Every row is taken ``whole`` times, and the first ``more`` of a unit's
    rows once more. A row's expected takes are its source's target over its source's size, at most ``most``. The cube method settles
    the fractions: within a source the taken tokens and documents stay balanced up to a landing of two units.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    units = frozen(rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows")).withColumn("unit", _unit(F.col("id"), F.col("source"), F.col("size"))), "units")
    targets = frozen(source_targets(units, weights, most), "targets")
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    joined = units.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    whole = F.floor(share + EPSILON)
    fraction = F.greatest(F.col("rows") * (share - whole), F.lit(0.0))
    sure = F.floor(fraction + EPSILON)
    ready = frozen(joined.select("*", whole.alias("whole"), sure.alias("sure"), F.least(F.greatest(fraction - sure, F.lit(0.0)), F.lit(1.0)).alias("chance")), "units")
    # A document without words adds nothing to any total: it is never taken more than whole times.
    decided = _decide(ready.where((F.col("chance") > EPSILON) & (F.col("size") > 0)).select("unit", "rank", "size", "chance"), seed, group_rows)
    return ready.join(decided, "unit", "left").withColumn("more", (F.col("sure") + F.coalesce("extra", F.lit(0))).cast("long")).drop("extra", "sure", "chance")


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """One row per input row: ``id_col``, ``size`` (words), ``source_size``, ``target``, ``taken`` (words the mix takes, repeats counted).

    Null texts have size 0 and are taken 0 words; a source without words has target 0. Null ids and sources are values like others.
    Repeated rows are decided together, so that they add up to their share. The draw is seeded: reruns agree.
    """
    units = mix_units(docs, weights, most, id_col, text_col, source_col, seed)
    each = units.withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    takes = F.col("whole") + F.when(F.col("__row") <= F.col("more"), 1).otherwise(0)
    return each.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * takes).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with their columns.

    Rows that a unit takes once more than others are those whose text hashes are smallest.
    """
    from pyspark.sql import Window

    units = mix_units(docs, weights, most, id_col, text_col, source_col, seed)
    takes = units.where((F.col("whole") > 0) | (F.col("more") > 0)).select(F.col("unit").alias("__unit"), F.col("whole").alias("__whole"), F.col("more").alias("__more"), F.col("rows").alias("__rows"))
    keyed = docs.withColumn("__unit", _unit(F.col(id_col), F.col(source_col), word_count(F.col(text_col))))
    joined = keyed.join(takes, "__unit")
    # Only rows that share id, source and size need an order; a unit of one row is a group of its own.
    order = Window.partitionBy("__unit").orderBy(F.xxhash64(text_col))
    ranked_rows = joined.withColumn("__row", F.row_number().over(order))
    times = F.col("__whole") + F.when(F.col("__row") <= F.col("__more"), 1).otherwise(0)
    return ranked_rows.where(times > 0).withColumn("__time", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long")))).select(*docs.columns)
