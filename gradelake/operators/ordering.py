"""Keyed orders, positions, quotas and de-duplication.

Rows: columns that end in an underscore are the operators' own; no table may bring one (an error). Repeated rows stay unless an operator removes
them by key; nulls sort first; equal ranks are told apart by the tie column. Empty tables give empty results.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradelake.functions import native as N


#: Rows of a component that one task goes through in order; it holds their keys (about 30 MB).
GREEDY_ROWS = 100_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder; on a local master one is made where none is set, on a cluster that is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gradelake-')}"
        context.setCheckpointDir(found)
    return found


def settle(df: DataFrame) -> DataFrame:
    """df computed once into the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared checkpoint folder. Unlike a checkpoint it forgets what the optimiser had inferred of its columns, which in a loop grows
    from round to round."""
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def own_names(df: DataFrame) -> DataFrame:
    """df, if none of its columns has a name that operators use for themselves."""
    if taken := [c for c in df.columns if c.endswith("_")]:
        raise ValueError(f"columns {taken} end in an underscore; such names are the operators' own")
    return df


def dealt(df: DataFrame, small: DataFrame, key: str, by: str, how: str = "inner", parts: int = 8) -> DataFrame:
    """df joined with ``small`` (a row a key); the rows of each key are dealt over several tasks by a hash of the column ``by``. Null keys meet nothing."""
    many = small.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return df.withColumn("salt_", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")).join(many, [key, "salt_"], how).drop("salt_")


def position(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """df with its 0-based place in a total order: a range-partitioned sort and the counts of the partitions before, so no task sees all rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = own_names(df).repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part_"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at_"))
    placed = settle(placed)
    before = placed.groupBy("part_").count().withColumn("before_", F.sum("count").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)))
    return placed.join(F.broadcast(before.select("part_", F.coalesce("before_", F.lit(0)).alias("before_"))), "part_").withColumn(name, F.col("before_") + F.col("at_")).drop("part_", "at_", "before_")


def quotas(sizes: DataFrame, rows: int, name: str = "name", size: str = "size") -> DataFrame:
    """name, quota: ``rows`` shared out in proportion by largest remainders, ties by name. Sizes are a row a source; a source that would get no row is an error."""
    one = sizes.select(F.col(name).alias("name"), F.col(size).cast("long").alias("size"))
    total = one.agg(F.sum("size").alias("total"))
    parts = one.join(F.broadcast(total)).select("name", F.expr(f"size * {rows} div total").alias("base"), (F.col("size") * rows % F.col("total")).alias("rest"))
    left = F.lit(rows) - F.sum("base").over(Window.partitionBy(F.lit(0)))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rest"), "name"))
    quota = F.col("base") + F.when(place <= left, 1).otherwise(0)
    return parts.select("name", quota.alias("quota")).select("name", N.demand(F.col("quota") > 0, F.col("quota"), "a source would get no rows").alias("quota"))


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A first row of every key, by a grouped minimum that is pre-aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = own_names(df).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row_"))
    return best.select(*keys, *[F.col("row_")[c].alias(c) for c in rest]).select(df.columns)


def distinct_in_order(df: DataFrame, keys: list[str], *order: str, name: str = "place") -> DataFrame:
    """keys and the 0-based place of each distinct key among the keys by their first row in ``order``; rows that tie are told apart by their keys."""
    first = own_names(df).groupBy(*keys).agg(F.min(F.struct(*order)).alias("first_"))
    placed = position(first.withColumnRenamed("first_", "first"), "first", *keys, name=name)
    return placed.select(*keys, name)


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of an edge list (u, v: long): nodes of one connected component share a label, its least node.

    Large-star and small-star steps in turn: each node hands its neighbours on to the least of them, above it and then below it, until nothing changes; the
    number of rounds grows with the logarithm of a component's diameter. Minima are pre-aggregated, and the rows of a node of many edges are dealt out.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    links, told = written(edges.where("u <> v").distinct()), None
    while True:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m_"))
        links = dealt(both, least, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m_").alias("v")).where("u <> v").distinct()
        least = links.groupBy("u").agg(F.min("v").alias("m_"))
        lower = dealt(links, least, "u", "v").select(F.col("v").alias("u"), F.col("m_").alias("v")).where("u <> v")
        links = written(lower.union(least.select("u", F.col("m_").alias("v"))).distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == told:
            break
        told = now
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("root_")), "node", "left").select("node", F.coalesce("root_", "node").alias("label"))


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by label and scan: those that stay, component by component; only the keys of one component are held."""
    label, seen = None, (set(), set())
    for batch in batches:
        keep = []
        for own, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if own != label:
                label, seen = own, (set(), set())
            stays = a not in seen[0] and b not in seen[1]
            if stays:
                seen[0].update(() if a is None else (a,))
                seen[1].update(() if b is None else (b,))
            keep.append(stays)
        yield pa.RecordBatch.from_arrays([batch.column(3).filter(pa.array(keep, pa.bool_()))], ["scan_"])


def _rounds(open_: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(scans that stay, rows still open) after up to n rounds: open rows that come first of both their keys stay; open rows that share a key with one go."""
    kept = None
    for _ in range(n):
        lead = open_
        for key, least in (("a_", "least_a_"), ("b_", "least_b_")):
            lowest = open_.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("scan_").alias(least))
            lead = dealt(lead, lowest, key, "scan_", "left")
        stays = (F.col("scan_") == F.coalesce("least_a_", "scan_")) & (F.col("scan_") == F.coalesce("least_b_", "scan_"))
        new = written(lead.where(stays).select("scan_", "a_", "b_"))
        kept = new.select("scan_") if kept is None else kept.union(new.select("scan_"))
        rest = open_.join(new.select("scan_"), "scan_", "left_anti").select("scan_", "a_", "b_")
        for key in ("a_", "b_"):
            gone = new.select(key).where(F.col(key).isNotNull()).distinct().withColumn("gone_", F.lit(True))
            rest = dealt(rest, gone, key, "scan_", "left").where("gone_ IS NULL").select("scan_", "a_", "b_")
        open_ = written(rest)
        if open_.isEmpty():
            break
    return kept, open_


def two_key_dedupe(df: DataFrame, scan: str, first: str, second: str, reserved: DataFrame | None = None, most: int = GREEDY_ROWS) -> DataFrame:
    """Greedy de-duplication in the order of the unique column ``scan``: a row stays if no row that stays before it has its first or its second key.

    ``reserved`` (columns first, second) holds keys of earlier tables, whose rows go at once. A null key is no key: it meets no other. Keys are compared as
    text. Two rounds on grouped minima settle what depends on few others, groups of any size that share one key among them. What is left falls into
    connected components of keys: those of at most ``most`` rows are gone through in scan order, many to a task, each in one pass, so that a chain of
    dependent rows costs no rounds of its own; larger ones go through another two rounds, after which they fall apart further. A chain longer than
    ``most`` rows takes rounds in proportion to its length.
    """
    open_ = own_names(df)
    if reserved is not None:
        for key in (first, second):
            open_ = open_.join(reserved.select(F.col(key)).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(df.columns)
    whole = written(open_)
    kept, open_ = _rounds(whole.select(F.col(scan).alias("scan_"), F.col(first).cast("string").alias("a_"), F.col(second).cast("string").alias("b_")), 2)
    while not open_.isEmpty():
        node = lambda side, key: F.xxhash64(F.lit(side), F.col(key))
        u = F.when(F.col("a_").isNotNull(), node(1, "a_")).otherwise(node(2, "b_"))
        v = F.when(F.col("b_").isNotNull(), node(2, "b_")).otherwise(u)
        labels = written(components(open_.select(u.alias("u"), v.alias("v"))))
        told = written(dealt(open_.withColumn("node", u), labels, "node", "scan_").select("label", "a_", "b_", "scan_"))
        large = told.groupBy("label").agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") > most)
        large = written(large.select("label", F.lit(True).alias("large_")))
        split = dealt(told, large, "label", "scan_", "left")
        small = split.where("large_ IS NULL").select("label", "a_", "b_", "scan_").repartition("label").sortWithinPartitions("label", "scan_")
        kept = kept.union(written(small.mapInArrow(_greedy, small.select("scan_").schema)))
        rest = split.where("large_").select("scan_", "a_", "b_")
        if rest.isEmpty():
            break
        more, open_ = _rounds(written(rest), 2)
        kept = kept.union(more)
    return whole.join(kept.select(F.col("scan_").alias(scan)), scan, "left_semi").select(df.columns)


def top_by_rank(df: DataFrame, group: str, rank: str, tie: str, quota: DataFrame) -> DataFrame:
    """The ``quota`` (columns group and quota, a row a group) smallest rows of every group by (rank, tie); ranks are uniform hex digits.

    A group's rows are cut first at a rank that leaves its quota with all but certainty, so that only about that many meet in a task; a count then proves
    the cut, and groups that it left too few rows of are taken whole.
    """
    own_names(df)
    keyed = df.select(group, F.conv(F.substring(rank, 1, 8), 16, 10).cast("long").alias("high_"))
    sizes = keyed.groupBy(group).agg(F.count(F.lit(1)).alias("size_")).join(F.broadcast(quota.select(group, F.col("quota").alias("quota_"))), group)
    slack = F.col("quota_") + 8 * F.sqrt(F.col("quota_").cast("double")) + 64
    limits = settle(sizes.withColumn("cut_", F.ceil(slack / F.col("size_") * float(1 << 32)).cast("long")))
    proven = keyed.join(F.broadcast(limits), group).groupBy(group).agg(F.count_if(F.col("high_") < F.col("cut_")).alias("n_"), F.first("quota_").alias("quota_"), F.first("size_").alias("size_"), F.first("cut_").alias("cut_"))
    whole = F.col("n_") < F.least("quota_", "size_")
    limits = settle(proven.select(group, "quota_", F.when(whole, 1 << 32).otherwise(F.col("cut_")).alias("cut_")))
    few = df.join(F.broadcast(limits), group).where(F.conv(F.substring(rank, 1, 8), 16, 10).cast("long") < F.col("cut_"))
    return few.withColumn("n_", F.row_number().over(Window.partitionBy(group).orderBy(rank, tie))).where("n_ <= quota_").select(df.columns)
