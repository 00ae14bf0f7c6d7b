"""Near-duplicate vectors by robust-pruned graphs on overlapping cluster shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenry.llm.common import components, frozen, nullable

THRESHOLD = 0.93
# Vectors of a shard, expected leaders that a larger group is split by, and vectors that one split task reads.
SHARD_ROWS, LEADERS, SPLIT_ROWS = 2048, 128, 8192
# A vector also joins the groups of up to two more leaders that are at most so many degrees farther than its nearest.
OVERLAP_DEGREES = 4.0
# A child with this share of its group's rows is no progress: the group is compared in blocks instead.
NO_PROGRESS = 0.5
# Graph: candidates of a node, its most edges, pruning factor, random candidates, width of the greedy search.
POOL, DEGREE, ALPHA, RANDOM_EDGES, BEAM = 48, 32, 1.2, 4, 16


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1) if values else np.zeros((0, 1))


def unit_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, dim, v): v is the vector at length 1 as doubles, null if it is null, zero or holds null or non-finite components."""
    picked = rows.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    schema = nullable(picked.select("id", "label", F.lit(0).cast("long").alias("dim"), F.lit(b"").alias("v")).schema)

    def one(x: pa.ListScalar) -> bytes | None:
        if not x.is_valid or not len(x.values) or x.values.null_count:
            return None
        v = x.values.to_numpy(zero_copy_only=False)
        largest = np.abs(v).max()
        if not np.isfinite(largest) or largest == 0:
            return None
        v = v / largest
        return (v / np.sqrt((v**2).sum()) + 0.0).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs = [one(x) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(v) // 8 if v else 0 for v in vs], pa.int64()), pa.array(vs, pa.binary())], names=["id", "label", "dim", "v"])

    return picked.mapInArrow(run, schema)


def build_graph(x: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """A robust-pruned graph: each node's edges go to candidates that no nearer edge leads to; edges run both ways.

    Candidates are the nearest nodes of the shard and a few random ones. A candidate is pruned if an edge already taken is closer to
    it, by the factor ``ALPHA``, than the node is.
    """
    n, rng = len(x), np.random.default_rng(seed)
    if n < 2:
        return [np.zeros(0, np.int64) for _ in range(n)]
    near, edges = min(POOL, n - 1), [[] for _ in range(n)]
    for first in range(0, n, 256):
        own = np.arange(first, min(n, first + 256))
        sims = x[own] @ x.T
        sims[np.arange(len(own)), own] = -2
        pool = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        pool = np.hstack([pool, rng.integers(0, n, (len(own), RANDOM_EDGES))])
        to = np.take_along_axis(sims, pool, 1)
        order = np.argsort(-to, axis=1, kind="stable")
        pool, to = np.take_along_axis(pool, order, 1), np.take_along_axis(to, order, 1)
        away = np.sqrt(np.maximum(2 - 2 * to, 0))
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("bcd,bed->bce", x[pool], x[pool]), 0))
        alive, taken = to > -2, np.zeros(to.shape, bool)
        for c in range(pool.shape[1]):
            take = alive[:, c] & (taken.sum(axis=1) < DEGREE)
            taken[:, c] = take
            alive &= ~(take[:, None] & (ALPHA * between[:, c, :] <= away))
        for b, node in enumerate(own):
            kept = pool[b][taken[b]]
            edges[node].extend(kept.tolist())
            for k in kept.tolist():
                edges[k].append(int(node))
    return [np.unique(np.array(e, dtype=np.int64)) for e in edges]


def _padded(adjacency: list[np.ndarray]) -> np.ndarray:
    """Edges as a matrix, short rows filled with the node itself."""
    width = max(map(len, adjacency), default=0) or 1
    out = np.repeat(np.arange(len(adjacency))[:, None], width, 1)
    for i, e in enumerate(adjacency):
        out[i, : len(e)] = e
    return out


def greedy(x: np.ndarray, near: np.ndarray, medoid: int, queries: np.ndarray, beam: int = BEAM, most: int = 200) -> np.ndarray:
    """The ``beam`` best nodes that a greedy walk from the medoid reaches, for a block of queries at once."""
    q, rows = x[queries], np.arange(len(queries))
    seen = np.zeros((len(queries), len(x)), bool)
    seen[:, medoid] = True
    ids = np.full((len(queries), beam), medoid)
    sims = np.full((len(queries), beam), -3.0)
    sims[:, 0] = q @ x[medoid]
    opened = sims < -2
    for _ in range(most):
        left = np.where(opened, -4.0, sims)
        at = left.argmax(axis=1)
        active = left[rows, at] > -4
        if not active.any():
            break
        opened[rows, at] = True
        fresh = near[ids[rows, at]]
        new = ~seen[rows[:, None], fresh] & active[:, None]
        seen[rows[:, None], fresh] |= active[:, None]
        got = np.where(new, np.einsum("bd,bcd->bc", q, x[fresh]), -3.0)
        # A node that a padded row names twice counts once.
        order = np.argsort(fresh, axis=1, kind="stable")
        twice = np.zeros_like(new)
        sorted_ids = np.take_along_axis(fresh, order, 1)
        np.put_along_axis(twice, order[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], 1)
        got[twice] = -3.0
        ids, sims, opened = np.hstack([ids, fresh]), np.hstack([sims, got]), np.hstack([opened, got < -2])
        best = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        ids, sims, opened = (np.take_along_axis(m, best, 1) for m in (ids, sims, opened))
    return np.where(sims > -2, ids, medoid)


def range_search(x: np.ndarray, adjacency: list[np.ndarray], threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each node the nodes within the threshold: a greedy walk from the medoid, then every node in range opens its own edges."""
    near = _padded(adjacency)
    medoid = int((x @ x.mean(axis=0)).argmax())
    for first in range(0, len(x), 128):
        queries = np.arange(first, min(len(x), first + 128))
        for query, starts in zip(queries, greedy(x, near, medoid, queries)):
            seen = np.zeros(len(x), bool)
            frontier = np.unique(np.append(starts, query))
            seen[frontier] = True
            frontier = frontier[(x[frontier] @ x[query] >= threshold) | (frontier == query)]
            found = [frontier]
            while len(frontier):
                hood = np.zeros(len(x), bool)
                hood[near[frontier]] = True
                hood &= ~seen
                hood = np.flatnonzero(hood)
                seen[hood] = True
                frontier = hood[x[hood] @ x[query] >= threshold]
                found.append(frontier)
            hits = np.concatenate(found)
            yield int(query), hits[hits != query]


def _sample(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Leaders of the groups in ``sizes``: an expected ``LEADERS`` a group, chosen by hash, as rows (group, leader, lv)."""
    drawn = F.pmod(F.xxhash64("node", "group"), F.lit(1 << 20)) < F.lit(LEADERS * float(1 << 20)) / F.col("rows")
    return rows.join(sizes, "group").where(drawn).select("group", F.col("node").alias("leader"), F.col("v").alias("lv"))


def _split(rows: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Rows of too large groups in the groups of their nearest leaders: (group, node, m, v, parent, lead, core).

    Leaders that are in range of one another stand for one: the first. ``core`` marks vectors so close to the nearest leader that any
    two of them are in range of each other. Each task reads a bounded part of a group and all its leaders.
    """
    salts = F.ceil(F.col("rows") / SPLIT_ROWS).cast("long")
    leaders = _sample(rows, sizes).join(sizes, "group").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    members = rows.join(sizes, "group").withColumn("salt", F.pmod(F.xxhash64("node"), salts))
    both = members.select("group", "salt", "node", "m", "v", F.lit(False).alias("leads")).unionByName(leaders.select("group", "salt", F.col("leader").alias("node"), F.lit(0).cast("long").alias("m"), F.col("lv").alias("v"), F.lit(True).alias("leads")))
    half, overlap = np.arccos(threshold) / 2 - 1e-7, np.radians(OVERLAP_DEGREES)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        leads = np.array(table["leads"].to_pylist(), bool)
        mine, first = table.filter(pa.array(~leads)), table.filter(pa.array(leads))
        lx, ids = _matrix(first["v"]), np.array(first["node"].to_pylist(), np.int64)
        chosen: list[int] = []
        for i in range(len(ids)):
            if not chosen or (lx[chosen] @ lx[i]).max() < threshold:
                chosen.append(i)
        x = _matrix(mine["v"])
        if chosen and len(x):
            angles = np.arccos(np.clip(x @ lx[chosen].T, -1, 1))
        else:
            angles = np.zeros((len(x), 1))
        order = np.argsort(angles, axis=1, kind="stable")[:, :3]
        ranked = np.take_along_axis(angles, order, 1)
        keep = ranked <= ranked[:, :1] + overlap
        at, place = np.nonzero(keep)
        lead = ids[chosen][order[at, place]] if chosen else np.zeros(len(at), np.int64)
        core = (ranked[at, place] <= half) & (place == 0) if chosen else np.zeros(len(at), bool)
        out = mine.take(pa.array(at))
        return pa.table({"parent": pa.array([key[0].as_py()] * len(at), pa.int64()), "lead": pa.array(lead), "node": out["node"], "m": out["m"], "v": out["v"], "core": pa.array(core)})

    cut = both.groupBy("group", "salt").applyInArrow(run, "parent long, lead long, node long, m long, v binary, core boolean")
    return cut.withColumn("group", F.xxhash64("parent", "lead"))


def _shards(reps: DataFrame, threshold: float, shard_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Overlapping shards (group, node, m, v) of bounded size, and what could not be split: (group, node, m, v, core)."""
    left, fit, dense = reps.select(F.xxhash64("label", "dim").alias("group"), "node", "m", "v"), [], []
    while True:
        sizes = frozen(left.groupBy("group").agg(F.count(F.lit(1)).alias("rows")), "sizes")
        large = sizes.where(F.col("rows") > shard_rows)
        if large.isEmpty():
            fit.append(left)
            break
        fit.append(left.join(large.select("group"), "group", "left_anti"))
        cut = frozen(_split(left, large, threshold), "split")
        children = cut.groupBy("parent", "group").agg(F.count(F.lit(1)).alias("child")).join(large.select(F.col("group").alias("parent"), "rows"), "parent")
        stuck = frozen(children.where((F.col("child") > shard_rows) & (F.col("child") >= F.col("rows") * NO_PROGRESS)).select("group").distinct(), "stuck")
        dense.append(cut.join(stuck, "group", "left_semi").select("group", "node", "m", "v", "core"))
        left = frozen(cut.join(stuck, "group", "left_anti").select("group", "node", "m", "v"), "left")
    out = fit[0].select("group", "node", "m", "v")
    for more in fit[1:]:
        out = out.unionByName(more.select("group", "node", "m", "v"))
    rest = dense[0] if dense else None
    for more in dense[1:]:
        rest = rest.unionByName(more)
    return out, rest


_FOUND = "node long, links long, peer long"


def _unite(part: np.ndarray, linked: np.ndarray) -> None:
    """Nodes numbered ``linked`` and all that share a part with them become one part, named by its first number."""
    named = np.unique(part[linked])
    if len(named) > 1:
        part[np.isin(part, named)] = named[0]


def _search_task(threshold: float):
    """Links of one shard: per node the copies it is linked with here, and the smallest node that links of this shard lead to.

    A pair that meets in several shards counts in the one with the smallest number, and not at all where a core counts it.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        shard, x = key[0].as_py(), _matrix(table["v"])
        nodes, m = np.array(table["node"].to_pylist(), np.int64), np.array(table["m"].to_pylist(), np.int64)
        cores = np.array(table["core"].to_pylist(), np.int64)
        place = {node: i for i, node in enumerate(nodes.tolist())}
        adjacency = [np.array([place[e] for e in edges if e in place], np.int64) for edges in table["edges"].to_pylist()]
        homes = table["homes"].to_pylist()
        several = np.array([len(h) > 1 for h in homes])
        links, part = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for i, hits in range_search(x, adjacency, threshold):
            if not len(hits):
                continue
            _unite(part, np.append(hits, i))
            count = ~((cores[hits] == cores[i]) & (cores[i] != 0))
            if several[i]:
                mine = set(homes[i])
                for j in np.flatnonzero(several[hits] & count):
                    count[j] = min(mine.intersection(homes[hits[j]])) == shard
            links[i] = m[hits[count]].sum()
        return pa.table({"node": nodes, "links": links, "peer": nodes[part]})

    return run


def _graph_task(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = table.sort_by("node")
    nodes = np.array(table["node"].to_pylist(), np.int64)
    return pa.table({"node": table["node"], "edges": pa.array([nodes[e].tolist() for e in build_graph(_matrix(table["v"]))], pa.list_(pa.int64()))})


def _block_task(threshold: float):
    """Links between two blocks of a group that could not be split, or within one; pairs inside a core are counted elsewhere."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        group, one, two = key[0].as_py(), key[1].as_py(), key[2].as_py()
        x, nodes, m = _matrix(table["v"]), np.array(table["node"].to_pylist(), np.int64), np.array(table["m"].to_pylist(), np.int64)
        cores, block = np.array(table["core"].to_pylist(), np.int64), np.array(table["block"].to_pylist(), np.int64)
        homes = table["homes"].to_pylist()
        links, part = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for i in range(len(nodes)):
            hits = np.flatnonzero((x @ x[i] >= threshold) & ((block != block[i]) if one != two else True))
            hits = hits[hits != i]
            if not len(hits):
                continue
            _unite(part, np.append(hits, i))
            count = ~((cores[hits] == cores[i]) & (cores[i] != 0))
            mine = set(homes[i])
            for j in np.flatnonzero(count):
                count[j] = len(homes[hits[j]]) == 1 or min(mine.intersection(homes[hits[j]])) == group
            links[i] = m[hits[count]].sum()
        return pa.table({"node": nodes, "links": links, "peer": nodes[part]})

    return run


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per vector: ``id_col``, ``n_links``, ``component_id`` and ``kept`` (its id is the component's).

    Vectors of equal, non-null label are linked if their cosine in double precision is at least ``threshold``. A vector that is null or
    zero, holds null or non-finite components, has no label or another dimension links with nothing there and is its own component.
    ``component_id`` is the smallest id reachable. Rows of one id are vectors of their own; a null id is never the smallest.

    Equal vectors become one node with a count. Nodes of a label are dealt into overlapping shards by sampled leaders until every shard
    is small. Each shard gets a robust-pruned graph; a node's edges from all its shards are united, and a greedy walk from the shard's
    medoid goes on through every node in range. All links found are verified by their cosine. Groups that leaders cannot part, as
    thousands of near copies, are compared in blocks, but for their core, whose pairs are linked by the triangle inequality and
    counted in bulk. So no pairs are emitted: a task unites all its links and returns a count and, per node, the smallest node of its part.
    """
    vectors = frozen(unit_vectors(rows, id_col, vector_col, label_col), "vectors")
    linkable = F.col("v").isNotNull() & F.col("label").isNotNull()
    grouped = vectors.where(linkable).groupBy("label", "dim", "v").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("least"))
    reps = frozen(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    fit, dense = _shards(reps, threshold, shard_rows)
    placed = fit.select("group", "node") if dense is None else fit.select("group", "node").unionByName(dense.select("group", "node"))
    homes = placed.groupBy("node").agg(F.collect_set("group").alias("homes"))
    cores = reps.select("node", F.lit(0).cast("long").alias("core")) if dense is None else reps.select("node").join(dense.where("core").groupBy("node").agg(F.min("group").alias("c")), "node", "left").select("node", F.coalesce("c", F.lit(0)).alias("core"))
    about = frozen(homes.join(cores, "node"), "homes")
    graphs = frozen(fit.groupBy("group").applyInArrow(_graph_task, "node long, edges array<long>"), "graphs")
    # A node has few shards and bounded lists: their union is bounded too.
    united = graphs.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges"))
    ready = fit.join(united, "node").join(about, "node")
    found = frozen(ready.groupBy("group").applyInArrow(_search_task(threshold), _FOUND), "links")
    if dense is not None:
        full = dense.drop("core").join(about, "node").withColumn("outer", F.col("core") != F.col("group"))
        sizes = full.groupBy("group", "outer").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("long").alias("parts"), F.sum("m").alias("copies"), F.min("node").alias("first"))
        inner = sizes.where("not outer").select("group", F.col("parts").alias("inner_parts"), "copies", "first")
        outer = sizes.where("outer").select("group", F.col("parts").alias("outer_parts"))
        dealt = full.join(inner, "group", "left").join(outer, "group", "left").fillna(0, ["inner_parts", "outer_parts"])
        dealt = dealt.withColumn("block", F.when(F.col("outer"), F.col("inner_parts") + F.pmod(F.xxhash64("node"), F.greatest("outer_parts", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.greatest("inner_parts", F.lit(1)))))
        # Core blocks meet outer blocks, outer blocks meet all: never two core blocks.
        every = F.sequence(F.lit(0).cast("long"), F.col("inner_parts") + F.col("outer_parts") - 1)
        others = F.when(F.col("outer"), every).otherwise(F.filter(every, lambda b: b >= F.col("inner_parts")))
        pairs = dealt.withColumn("other", F.explode(others)).withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
        met = pairs.select("group", "one", "two", "node", "m", "v", "core", "block", "homes").groupBy("group", "one", "two").applyInArrow(_block_task(threshold), _FOUND)
        bulk = full.where("not outer").join(inner, "group").select("node", (F.col("copies") - F.col("m")).alias("links"), F.least("node", "first").alias("peer"))
        found = frozen(found.unionByName(met).unionByName(bulk), "links")
    joined = components(found.select("node", "peer"), "node", "peer")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = reps.join(counts, "node", "left").join(joined, "node", "left").withColumn("part", F.coalesce("component", "node"))
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    classes = frozen(named.join(least, "part").select("label", "dim", "v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id"), "classes")
    linked = vectors.where(linkable).join(classes, ["label", "dim", "v"]).select("id", "n_links", "component_id")
    alone = vectors.where(~linkable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def audit_recall(rows: DataFrame, found: DataFrame, threshold: float = THRESHOLD, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(expected, found, recall) of the links of rows whose id is divisible by ``every``, counted by brute force over all rows.

    Queries of one label meet that label's rows in blocks by a join on the label; only counts per query are kept.
    """
    vectors = frozen(unit_vectors(rows, id_col, vector_col, label_col).where("v is not null and label is not null"), "vectors")
    blocks = F.pmod(F.xxhash64("id"), F.lit(16))
    asked = vectors.where(F.col("id") % every == 0).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<long>"))).withColumn("asks", F.lit(True))
    both = asked.unionByName(vectors.withColumn("block", blocks.cast("long")).withColumn("asks", F.lit(False)))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        asks = np.array(table["asks"].to_pylist(), bool)
        queries, others = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        ids, theirs = np.array(queries["id"].to_pylist()), np.array(others["id"].to_pylist())
        x, y = _matrix(queries["v"]), _matrix(others["v"])
        rows = [int(((y @ x[i] >= threshold) & (theirs != ids[i])).sum()) if len(y) else 0 for i in range(len(ids))]
        return pa.table({"id": pa.array(ids, pa.int64()), "links": pa.array(rows, pa.int64())})

    exact = both.groupBy("label", "dim", "block").applyInArrow(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    joined = exact.join(found.select(F.col(id_col).alias("id"), "n_links"), "id")
    totals = joined.agg(F.sum("links").alias("expected"), F.sum(F.least("links", "n_links")).alias("found"))
    return totals.withColumn("recall", F.when(F.col("expected") > 0, F.col("found") / F.col("expected")).otherwise(1.0))
