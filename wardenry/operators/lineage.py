"""Lineage edges and graph queries (LIN-1..12)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardenry.operators import audit
from wardenry.operators.joins import lookup_join
from wardenry.schemas import moment
from wardenry.session import broadcast_if_small, scratch_path

SOURCE, TARGET = "source_dataset", "destination_dataset"


def track(rows: DataFrame, source: Column, destination: Column, transformation: Column, *, user: Column | None = None,
          tenant_id: str = "tenant_id", metadata: dict[str, Column] | None = None, ts: object | None = None) -> DataFrame:
    """Lineage rows derived from ``rows``, one each."""
    at = F.current_timestamp() if ts is None else moment(ts).cast("timestamp")
    pairs = [part for key, value in (metadata or {}).items() for part in (F.lit(key), value.cast("string"))]
    return rows.select(
        F.uuid().alias("event_id"), at.alias("ts"), source.cast("string").alias(SOURCE),
        destination.cast("string").alias(TARGET), transformation.cast("string").alias("transformation"),
        (F.lit("batch_job") if user is None else user).alias("user"), F.col(tenant_id),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def tracking_events(edges: DataFrame) -> DataFrame:
    """The audit row that accompanies every tracked edge."""
    return audit.events(
        edges, "LINEAGE_TRANSFORMATION_TRACKED", user=F.col("user"), record_id=F.col("event_id"), ts=F.col("ts"),
        details={SOURCE: F.col(SOURCE), TARGET: F.col(TARGET), "transformation": F.col("transformation")},
    )


def by_event(edges: DataFrame, event_id: str) -> DataFrame:
    return edges.where(F.col("event_id") == event_id)


def touching(edges: DataFrame, dataset: str) -> DataFrame:
    """Events with the dataset on either side, a self-loop once."""
    return edges.where((F.col(SOURCE) == dataset) | (F.col(TARGET) == dataset))


def upstream(edges: DataFrame, dataset: str) -> DataFrame:
    return edges.where(F.col(TARGET) == dataset)


def downstream(edges: DataFrame, dataset: str) -> DataFrame:
    return edges.where(F.col(SOURCE) == dataset)


def touching_many(edges: DataFrame, datasets: DataFrame) -> DataFrame:
    """Events touching each of many datasets: one narrow explode and one equi-join, a self-loop once."""
    sides = edges.withColumn("dataset", F.explode(F.array_distinct(F.array(SOURCE, TARGET))))
    return lookup_join(sides, datasets.select("dataset").distinct(), ["dataset"], "left_semi")


def neighbours(edges: DataFrame) -> DataFrame:
    """Graph summary of every dataset as rows ``(root, direction, neighbour)``.

    A self-loop counts as upstream only. Rows, not one array per dataset: a hub may touch most of the graph.
    """
    loop = F.col(SOURCE) == F.col(TARGET)
    as_target = F.struct(F.col(TARGET).alias("root"), F.lit("upstream").alias("direction"), F.col(SOURCE).alias("neighbour"))
    as_source = F.struct(F.col(SOURCE).alias("root"), F.lit("downstream").alias("direction"), F.col(TARGET).alias("neighbour"))
    return (
        edges.select(SOURCE, TARGET).distinct()
        .select(F.explode(F.array_compact(F.array(as_target, F.when(~loop, as_source)))).alias("_n"))
        .select("_n.*")
    )


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct connections source -> destination."""
    return edges.select(SOURCE, TARGET).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct upstream and downstream neighbours of every dataset, counted."""
    return neighbours(edges).groupBy("root").agg(
        F.count_if(F.col("direction") == "upstream").alias("upstream_count"),
        F.count_if(F.col("direction") == "downstream").alias("downstream_count"),
    )


def by_transformation(edges: DataFrame, transformation: str) -> DataFrame:
    return edges.where(F.col("transformation") == transformation)


def transformation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("transformation").agg(F.count("*").alias("event_count"))


def by_tenant(edges: DataFrame, tenant_id: str) -> DataFrame:
    return edges.where(F.col("tenant_id") == tenant_id)


def datasets(edges: DataFrame) -> DataFrame:
    """Distinct dataset names on either side."""
    return edges.select(F.explode(F.array(SOURCE, TARGET)).alias("dataset")).distinct()


def dataset_count(edges: DataFrame) -> DataFrame:
    return datasets(edges).agg(F.count("*").alias("dataset_count"))


def event_count(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("event_count"))


# Links of one dataset in a bucket; the links of a larger one are dealt over several. Hops whose finds are merged into one table.
HUB_LINKS, MERGED_HOPS = 1_000_000, 8
# The bits of a block of roots, the last one the sign; roots that one task numbers.
_BITS, ROOT_GROUP = [*(1 << n for n in range(63)), -(1 << 63)], 65_536


class _Bucketed:
    """Tables in the shared folder, bucketed by Spark and known to the catalog for as long as a traversal runs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, scratch_path(spark, "provenance")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.names: dict[str, str] = {}

    def write(self, df: DataFrame, name: str, by: list[str]) -> DataFrame:
        """``df`` in buckets of ``by``. It comes shuffled by these columns, so a task writes few buckets."""
        table = f"provenance_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, *by).option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(table)
        self.names[name] = table
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Forget tables and delete their files."""
        files = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for name in names:
            self.forget(name)
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}"), True)

    def forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(name)}")


def provenance(edges: DataFrame, roots: DataFrame, direction: str = "downstream", max_hops: int | None = None) -> DataFrame:
    """Everything reachable from each root with the least number of hops: ``(root, dataset, hops)``.

    Breadth first, one join per hop, until a hop finds nothing new; cycles and self-loops end by comparison with what was seen. Up to 64
    roots are searched together: a row is a dataset with one bit for each root of a block that reaches it, so a link is followed once for
    all roots that come to it by the same hop. Links are bucketed once by their near end, and what a hop finds by block and dataset: a hop
    shuffles its frontier and its finds, never the links or what was seen. The links of a hub are dealt over several buckets. Finds are
    tables in the shared folder, which cuts the lineage and survives lost executors; the links are deleted at the end. A root is listed
    only when a cycle leads back to it.
    """
    if direction not in ("downstream", "upstream"):
        raise ValueError("direction must be downstream or upstream")
    near, far = (SOURCE, TARGET) if direction == "downstream" else (TARGET, SOURCE)
    spark = edges.sparkSession
    tables = _Bucketed(spark)
    schema = "root string, dataset string, hops int"
    pairs = edges.select(F.col(near).alias("near"), F.col(far).alias("far")).distinct()
    # Counted with repeats, which at most gives a dataset more parts.
    spread = edges.groupBy(F.col(near).alias("near")).agg(F.ceil(F.count(F.lit(1)) / HUB_LINKS).cast("int").alias("parts")).where("parts > 1")
    path = f"{tables.folder}/hubs"
    spread.write.parquet(path)
    hubs = broadcast_if_small(spark.read.schema(spread.schema).parquet(path))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("far"), F.col("parts"))).cast("int").alias("part")
    dealt = pairs.join(hubs, "near", "left").select("near", part, "far").repartition(tables.buckets, "near", "part")
    links = tables.write(dealt, "links", ["near", "part"])
    numbered = _numbered(tables, roots)

    frontier = numbered.groupBy("block", "dataset").agg(F.bit_or("bits").alias("bits"))
    found_paths: list[str] = []
    seen: dict[str, DataFrame] = {}
    hop = 0
    try:
        while max_hops is None or hop < max_hops:
            hop += 1
            reached = tables.write(_hop(links, hubs, frontier, seen).withColumn("hops", F.lit(hop)), f"hop-{hop}", ["block", "dataset"])
            if reached.isEmpty():
                break
            found_paths.append(f"{tables.folder}/hop-{hop}")
            seen[f"hop-{hop}"] = reached
            frontier = reached.select("block", "dataset", "bits")
            if len(seen) > MERGED_HOPS:
                seen = _merged(tables, seen, hop)
        if not found_paths:
            return spark.createDataFrame([], schema)
        found = spark.read.schema(reached.schema).parquet(*found_paths)
        names = broadcast_if_small(numbered.select("block", F.col("bits").alias("bit"), F.col("dataset").alias("root")))
        return found.join(names, "block").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("root", "dataset", "hops")
    finally:
        for name in list(tables.names):
            if name.startswith("hop-"):
                tables.forget(name)
            else:
                tables.drop(name)


def _numbered(tables: _Bucketed, roots: DataFrame) -> DataFrame:
    """Each root in a block of up to 64, with a bit of its own there: ``(dataset, block, bits)``. Roots are numbered in groups of bounded size."""
    distinct = roots.select(F.col("dataset").cast("string").alias("dataset")).distinct()
    groups = distinct.count() // ROOT_GROUP + 1
    number = F.row_number().over(Window.partitionBy("group").orderBy("dataset")) - 1
    placed = distinct.withColumn("group", F.pmod(F.xxhash64("dataset"), F.lit(groups))).withColumn("number", number).select(
        "dataset", (F.floor(F.col("number") / len(_BITS)) * groups + F.col("group")).cast("long").alias("block"),
        F.get(F.array(*map(F.lit, _BITS)), F.col("number") % len(_BITS)).alias("bits"))
    path = f"{tables.folder}/roots"
    placed.write.parquet(path)
    return tables.spark.read.schema("dataset string, block long, bits long").parquet(path)


def _hop(links: DataFrame, hubs: DataFrame, frontier: DataFrame, seen: dict[str, DataFrame]) -> DataFrame:
    """New ``(block, dataset, bits)`` one link behind the frontier: the bits of roots that had not reached the dataset."""
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    asked = frontier.join(hubs.withColumnRenamed("near", "dataset"), "dataset", "left").select("block", F.col("dataset").alias("near"), parts, "bits")
    # A frontier is broadcast once it is counted; a large one is merged with the links, which are never moved.
    followed = links.join(_small_or_merged(asked), ["near", "part"]).select("block", F.col("far").alias("dataset"), "bits")
    found = followed.groupBy("block", "dataset").agg(F.bit_or("bits").alias("bits"))
    if not seen:
        return found
    left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("before", F.lit(0).cast("long"))))
    return found.join(_union(seen).withColumnRenamed("bits", "before"), ["block", "dataset"], "left").select("block", "dataset", left.alias("bits")).where("bits != 0")


def _small_or_merged(asked: DataFrame) -> DataFrame:
    small = broadcast_if_small(asked)
    return asked.hint("merge") if small is asked else small


def _union(seen: dict[str, DataFrame]) -> DataFrame:
    """All that was seen, a dataset once a block. The tables have equal buckets, so their union has them too and is not shuffled."""
    every = reduce(DataFrame.unionByName, [earlier.select("block", "dataset", "bits") for earlier in seen.values()])
    return every.groupBy("block", "dataset").agg(F.bit_or("bits").alias("bits")) if len(seen) > 1 else every


def _merged(tables: _Bucketed, seen: dict[str, DataFrame], hop: int) -> dict[str, DataFrame]:
    """What was seen as one table, so that a hop's comparisons stay few on deep graphs."""
    name = f"seen-{hop}"
    merged = tables.write(_union(seen), name, ["block", "dataset"])
    for old in seen:
        if old.startswith("seen-"):
            tables.drop(old)
    return {name: merged}
