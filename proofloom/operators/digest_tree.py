"""Trees of digests over ranges of keys, and what differs between two tables found by going down only where digests differ.

A key's place is the md5 of its text, so ranges of places are even whatever the keys are. A node is the range of all places
with the same first hex digits, ``depth`` of them in a leaf. Its digest is made of sums over the digests of its rows, so a leaf
that holds a hot key is combined within tasks like any other, in no order, and no rows are gathered; the rows are read once for
all levels. Where a node is the same, so is every node below it.

Columns that change from run to run (times, machine names) are left out of the rows' digests: name them ``volatile``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.operators.digests import row_digest

#: Hex digits of a leaf: 65,536 leaves. The root has none.
DEPTH = 4
#: Hex digits of a folder of a stored table.
FOLDER = 2
_PIECES = 4


def place(keys: list[str]) -> Column:
    return F.md5(row_digest(*keys).cast("binary"))


def placed(rows: DataFrame, keys: list[str], volatile: list[str] = ()) -> DataFrame:
    """keys, place, digest of each row. Columns are taken by name, so their order in a table does not matter."""
    content = sorted(c for c in rows.columns if c not in volatile)
    return rows.select(*keys, place(keys).alias("place"), row_digest(*content).alias("digest"))


def tree(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """level, node, n, digest of every node that has rows, from rows with place and digest; the root is level 0, node ''.

    Equal digests of two roots mean equal multisets of rows: repeats count, for sums of digests count them.
    """
    names = [f"p{i}" for i in range(_PIECES)]
    pieces = [F.sum(F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(p) for i, p in enumerate(names)]
    leaves = rows.groupBy(F.substring("place", 1, depth).alias("leaf")).agg(F.count(F.lit(1)).alias("n"), *pieces)
    above = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("node", F.expr("substring(leaf, 1, level)"))
    nodes = above.groupBy("level", "node").agg(F.sum("n").alias("n"), *(F.sum(p).alias(p) for p in names))
    return nodes.select("level", "node", "n", row_digest("node", "n", *names).alias("digest"))


def differing(expected: DataFrame, found: DataFrame) -> DataFrame:
    """level, node of the nodes that differ between two trees, or two parts of trees."""
    a, b = (t.select("level", "node", F.col("digest").alias(name)) for t, name in ((expected, "__a"), (found, "__b")))
    return a.join(b, ["level", "node"], "full_outer").filter(~F.col("__a").eqNullSafe(F.col("__b"))).select("level", "node")


def changes(expected: DataFrame, found: DataFrame, leaves: DataFrame, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """keys, problem (``missing``, ``unexpected``, ``changed``) from the placed rows of two tables in leaves that differ.

    Rows of a key are compared as multisets: a key that is in both with other rows, or another number of them, is ``changed``.
    """
    within = [t.join(leaves.select(F.col("node").alias("__leaf")), F.substring("place", 1, depth) == F.col("__leaf"), "left_semi") for t in (expected, found)]
    signed = within[0].select(*keys, "digest", F.lit(1).alias("side")).unionByName(within[1].select(*keys, "digest", F.lit(-1).alias("side")))
    balance = signed.groupBy(*keys, "digest").agg(F.sum("side").alias("left"), F.count_if(F.col("side") == 1).alias("n_a"), F.count_if(F.col("side") == -1).alias("n_b"))
    per = balance.groupBy(*keys).agg(F.bool_or(F.col("left") != 0).alias("differs"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b")).filter("differs")
    return per.select(*keys, F.when(F.col("n_b") == 0, "missing").when(F.col("n_a") == 0, "unexpected").otherwise("changed").alias("problem"))


# ---- stored tables ----------------------------------------------------------------------------------------------


def seal(rows: DataFrame, path: str, keys: list[str], volatile: list[str] = (), depth: int = DEPTH) -> None:
    """Write the placed rows to ``path``/rows, one folder a range of places, their tree to ``path``/tree, their columns to ``path``/shape."""
    shelves = placed(rows, keys, volatile).withColumn("folder", F.substring("place", 1, FOLDER))
    salt = F.spark_partition_id() % 16  # a hot key lies in one folder
    shelves.repartition("folder", salt).write.partitionBy("folder").parquet(f"{path}/rows")
    shelves.limit(0).drop("folder").coalesce(1).write.parquet(f"{path}/shape")
    sealed = rows.sparkSession.read.schema(shelves.schema).parquet(f"{path}/rows")
    tree(sealed, depth).repartition(1).write.partitionBy("level").parquet(f"{path}/tree")


def sealed_changes(spark: SparkSession, expected: str, found: str, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """``changes`` between two sealed tables.

    First the nodes of whole folders are compared, then the leaves in those that differ, then the rows in the leaves that
    differ; folders that are the same are not opened. The driver takes names of folders, 256 at most.
    """
    schema = "level int, node string, n long, digest string"
    nodes = [spark.read.schema(schema).parquet(f"{p}/tree") for p in (expected, found)]
    tops = [t.filter(F.col("level") == FOLDER) for t in nodes]
    folders = [r["node"] for r in differing(*tops).collect()]
    leaves = differing(*(t.filter((F.col("level") == depth) & F.substring("node", 1, FOLDER).isin(folders)) for t in nodes))
    kept = []
    for path, top in zip((expected, found), tops):
        columns = spark.read.parquet(f"{path}/shape").schema
        own = [f"{path}/rows/folder={r['node']}" for r in top.filter(F.col("node").isin(folders)).select("node").collect()]
        kept.append(spark.read.schema(columns).parquet(*own) if own else spark.createDataFrame([], columns))
    return changes(*kept, leaves, keys, depth)
