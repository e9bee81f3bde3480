"""Connected components by repeated contraction."""
from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut_lineage, removed, shared_folder, stored_at


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each end of an edge (a, b), the smallest node it reaches.

    Each round points a node at its smallest neighbour, follows the pointers to their ends
    by doubling, and contracts the edges to those ends; rounds are logarithmic in the
    number of nodes. All states are tables of their own, which go when the next one is
    there. An empty table gives an empty table.
    """
    spark = edges.sparkSession
    base = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"
    steps = count()
    paths: dict[str, str] = {}

    def state(name: str, rows: DataFrame) -> DataFrame:
        path = f"{base}/{name}-{next(steps)}"
        new = stored_at(rows, path)
        if name in paths:
            removed(spark, paths[name])
        paths[name] = path
        return new

    left = state("left", edges.select("a", "b").where(F.col("a") != F.col("b")))
    labels = None
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = state("parent", both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("root")))
        while True:
            ends = parent.select(F.col("node").alias("mid"), F.col("root").alias("end"))
            further = state("further", parent.join(ends, F.col("root") == F.col("mid")).select("node", "root", "end"))
            parent = further.select("node", F.col("end").alias("root"))
            if further.where(F.col("end") != F.col("root")).isEmpty():
                break
        if labels is None:
            labels = state("labels", parent)
        else:
            labels = state("labels", labels.join(parent.toDF("n", "r"), F.col("root") == F.col("n"), "left").select(
                "node", F.coalesce("r", "root").alias("root")))
        a, b = parent.toDF("na", "ra"), parent.toDF("nb", "rb")
        left = state("left", left.join(a, F.col("a") == F.col("na")).join(b, F.col("b") == F.col("nb")).where(
            F.col("ra") != F.col("rb")).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if left.isEmpty():
            labels = cut_lineage(labels)
            removed(spark, base)
            return labels


def shared_rows(bands: DataFrame) -> DataFrame:
    """(band, id, k): the distinct rows of bands with several ids; k counts the rows of the band.

    One exchange of the rows by band; each band is read as a window, which spills if it is large.
    """
    own = Window.partitionBy("band")
    rows = bands.select("band", "id", F.count("*").over(own).alias("k"), F.min("id").over(own).alias("lo"), F.max("id").over(own).alias("hi"))
    return rows.where(F.col("lo") != F.col("hi")).select("band", "id", "k").distinct()


def linked(bands: DataFrame, links: DataFrame, verify: Callable[[DataFrame], DataFrame],
           compare: Callable[[DataFrame], DataFrame], rounds: int = 2) -> DataFrame:
    """(a, b): ``links`` and all pairs of a band that are similar enough, up to paths.

    ``bands`` has a row (band, id) for each band of an id. In each band the id that meets
    most others is compared with the rest (``verify`` takes pairs), so a large group around
    one text falls together at once. Of what is left, rows (band, id, comp) of bands with
    several components go to ``compare``, which handles all pairs of different components
    in blocks. Pairs inside a component need no comparison: the components are those of all
    accepted pairs.
    """
    met = shared_rows(bands).withColumn("met", F.sum("k").over(Window.partitionBy("id")))
    lead = met.withColumn("lead", F.max_by("id", F.struct("met", "id")).over(Window.partitionBy("band")))
    rest = cut_lineage(lead.where(F.col("id") != F.col("lead")).select("band", "id", "k", "lead"))
    tried = cut_lineage(rest.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct())
    links = cut_lineage(links.unionByName(verify(tried)))
    rows = _open(rest, components(links))
    for _ in range(rounds - 1):
        if rows.isEmpty():
            return links
        lead = rows.groupBy("band").agg(F.max(F.struct("k", F.xxhash64("id"), "id", "comp")).alias("lead"))
        rest = rows.join(lead, "band").where(F.col("id") != F.col("lead.id"))
        found = rest.where(F.col("comp") != F.col("lead.comp")).select(
            F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).distinct()
        links = cut_lineage(links.unionByName(verify(cut_lineage(found.join(tried, ["a", "b"], "left_anti")))))
        rows = _open(rest, components(links))
    if rows.isEmpty():
        return links
    return cut_lineage(links.unionByName(compare(rows.select("band", "id", "comp"))))


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, id, k, comp): the rows of bands that still hold several components."""
    marked = rows.select("band", "id", "k").join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "band", "id", "k", F.coalesce("root", "id").alias("comp"))
    mixed = marked.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi"))
    return cut_lineage(marked.join(mixed.select("band"), "band"))


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Adds ``blk`` and ``blks``: rows of a band are dealt by hash into blocks of about ``size``."""
    sizes = rows.groupBy("band").agg(F.ceil(F.count("*") / size).cast("int").alias("blks"))
    return rows.join(sizes, "band").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blks")).cast("int"))
