"""A Merkle manifest of a table: one digest for all rows, and for each row a proof that it is among them.

Every row is a leaf. The leaves of a source, in the order of their ids, are a tree: runs of 16 nodes that follow each other
have their digest for a parent, until one node is left, the source's root. The sources' roots, in the order of the sources,
are a tree again, and what is left of it is the root of all.

Nodes live in an external store, Parquet files by level: the sorted leaf runs are written first, each level is made from a
scan of the one below, and holds the digests of its children beside its own. Proofs are made on the way back: a level is
merged, by the coordinates (tree, place), with the paths of its nodes, and gives those of its children. A path is
shipped once for 16 leaves, never by leaf, and the leaves' rows are not shuffled again. Nothing but the number of levels
and the root goes to the driver.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.common import documents, ensure_checkpoint_dir

#: Children of a node.
FAN = 16
_PATH = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon, and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def lower_ascii(text: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def tree_key(source: Column) -> Column:
    """Text that orders sources as they are to be ordered (null first, then by their bytes) and is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


@dataclass
class Store:
    """Where a forest's nodes are, level by level, and how many levels there are above the leaves."""

    path: str
    height: int

    def level(self, spark, k: int) -> DataFrame:
        """key, at, n (nodes of the key's tree on this level), node, children (``payload`` and node; above the first level, nodes)."""
        return spark.read.parquet(f"{self.path}/level={k}")


def build(leaves: DataFrame, path: str, order: list[str]) -> Store:
    """Write the nodes above ``leaves`` (key, node and others) to ``path``; leaves of a key are put in the order of ``order``.

    Leaves that are equal in all of ``order`` may be in any order. A key's leaves are ranged over many tasks, however many.
    """
    spark = leaves.sparkSession
    deals = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = leaves.repartitionByRange(deals, "key", *order).sortWithinPartitions("key", *order)
    ranged.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)).write.parquet(f"{path}/runs")
    runs = spark.read.parquet(f"{path}/runs")
    parts = runs.groupBy("key", "part").agg(F.count("*").alias("m"), F.min("row").alias("first"))
    so_far = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.select(
        "key", "part", (F.sum("m").over(so_far) - F.col("m") - F.col("first")).alias("shift"), F.sum("m").over(Window.partitionBy("key")).alias("n")
    )
    payload = [c for c in leaves.columns if c not in ("key", "node")]
    placed = runs.join(parts, ["key", "part"]).select("key", (F.col("row") + F.col("shift")).alias("at"), "n", "node", F.struct(*payload, "node").alias("child"))
    placed.write.parquet(f"{path}/level=0")
    store = Store(path, 0)
    while (store.level(spark, store.height).agg(F.max("n")).first()[0] or 0) > 1:
        below = store.level(spark, store.height).where("n > 1")
        child = "child" if store.height == 0 else "node"
        run = below.groupBy("key", F.expr(f"at div {FAN}").alias("up")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", child))).alias("all"))
        children = F.col(f"all.{child}")
        nodes = F.col("all.child.node") if store.height == 0 else children
        store.height += 1
        run.select("key", F.col("up").alias("at"), F.ceil(F.col("n") / FAN).alias("n"), F.sha2(F.array_join(nodes, ""), 256).alias("node"), children.alias("children")).write.parquet(
            f"{path}/level={store.height}"
        )
    return store


def roots(spark, store: Store) -> DataFrame:
    """key, node: the root of each tree."""
    out = store.level(spark, 0).where("n = 1").select("key", "node")
    for k in range(1, store.height + 1):
        out = out.union(store.level(spark, k).where("n = 1").select("key", "node"))
    return out


def paths(spark, store: Store, above: DataFrame | None = None) -> DataFrame:
    """The payload of each leaf, ``path`` (before and after on each level, upwards) and what ``above`` has: key, path, and others.

    ``above`` has the path of each tree's root, which is empty without it. On each level the nodes are merged with their
    paths by key and place.
    """
    more = [] if above is None else [c for c in above.columns if c not in ("key", "path")]
    under = lambda top: top.withColumn("path", F.array().cast(_PATH)) if above is None else top.join(above, "key")
    payload = store.level(spark, 0).schema["child"].dataType.fieldNames()
    found = None
    for k in range(store.height, 0, -1):
        level = store.level(spark, k)
        tops = under(level.where("n = 1").select("key", "at", "children"))
        nodes = tops if found is None else tops.unionByName(level.where("n > 1").select("key", "at", "children").join(found, ["key", "at"]))
        child = nodes.select("key", "at", "path", *more, "children", F.posexplode("children").alias("i", "child"))
        names = F.col("children.node") if k == 1 else F.col("children")
        side = F.struct(
            F.array_join(F.slice(names, F.lit(1), F.col("i")), "").alias("before"), F.array_join(F.slice(names, F.col("i") + 2, F.lit(FAN)), "").alias("after")
        )
        found = child.select("key", (F.col("at") * FAN + F.col("i")).alias("at"), F.concat(F.array(side), "path").alias("path"), *more, "child")
        if k > 1:
            found = found.drop("child")
    alone = under(store.level(spark, 0).where("n = 1").select("key", "at", "child"))
    found = alone if found is None else found.unionByName(alone)
    return found.select("key", *[F.col(f"child.{c}").alias(c) for c in payload], "path", *more)


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with its path."""
    return F.aggregate(path, node, lambda digest, level: F.sha2(F.concat(level["before"], digest, level["after"]), 256))


def manifest(docs: DataFrame, folder: str, id_col: str, source_col: str, values: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """source key, id, leaf, subroot, root, path of each row of ``docs``, and the columns of ``more``, which are made from the row.

    A leaf is the digest of ``values``, nulls told from empty. Rows are ordered by source, id (null first) and leaf, so
    repeated ids and rows have a place each, and rows alike in all have the same results whichever comes first. ``folder`` is
    new and in a place that all executors share; the stores stay there. No rows give no rows.
    """
    spark = docs.sparkSession
    given = docs.select(
        tree_key(F.col(source_col)).alias("key"), leaf([F.col(c) for c in values]).alias("node"), F.col(id_col).alias("id"),
        *[c.alias(name) for name, c in (more or {}).items()],
    )
    leaves = build(given, f"{folder}/leaves", ["id", "node"])
    tops = roots(spark, leaves).select(F.lit("").alias("key"), "node", F.col("key").alias("source"))
    sources = build(tops, f"{folder}/sources", ["source"])
    root = (roots(spark, sources).first() or {"node": None})["node"]
    above = paths(spark, sources).select(F.col("source").alias("key"), "path", F.col("node").alias("subroot"))
    found = paths(spark, leaves, above)
    return found.withColumnRenamed("node", "leaf").withColumn("root", F.lit(root).cast("string"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/merkle-{uuid.uuid4()}"
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = documents(spark, sf_dir).select(*names)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    told = leaf([F.when(hit, lower_ascii(F.col(c))).otherwise(F.col(c)) if c == "text" else F.col(c) for c in names])
    found = manifest(docs, folder, "doc_id", "source", names, {"told": told})
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), ""), 256)
    found = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.col("told"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
