"""Trees of digests: planted changes are found, equal ranges are neither entered nor read."""

from collections import Counter

from pyspark.sql import functions as F

from proofloom.operators import digest_tree


def rows(spark, n=600):
    return spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("x").alias("at"))


def trees(spark, *runs, depth=2):
    placed = [digest_tree.placed(r, ["k"], ["at"]) for r in runs]
    return placed, [digest_tree.tree(p, depth) for p in placed]


def found(spark, a, b, depth=2):
    placed, both = trees(spark, a, b, depth=depth)
    leaves = digest_tree.differing(*both).filter(F.col("level") == depth)
    return {r["k"]: r["problem"] for r in digest_tree.changes(*placed, leaves, ["k"], depth).collect()}


def test_planted_changes(spark):
    a = rows(spark)
    b = a.filter("k <> 7").withColumn("text", F.when(F.col("k") == 11, "other").otherwise(F.col("text"))).withColumn("at", F.lit("y")).unionByName(spark.createDataFrame([(-1, "new", "y")], a.schema))
    assert found(spark, a, b) == {7: "missing", 11: "changed", -1: "unexpected"}
    assert found(spark, a, a.withColumn("at", F.rand().cast("string")).repartition(7).select("at", "text", "k")) == {}


def test_repeats_nulls_and_empty_tables(spark):
    schema = "k long, text string, at string"
    a = spark.createDataFrame([(1, "a", ""), (1, "a", ""), (1, "b", ""), (None, None, ""), (2, None, "")], schema)
    b = spark.createDataFrame([(1, "a", ""), (1, "b", ""), (1, "b", ""), (None, None, ""), (2, "", "")], schema)
    assert found(spark, a, b) == {1: "changed", 2: "changed"}
    none = spark.createDataFrame([], schema)
    assert found(spark, none, none) == {}
    assert found(spark, none, a) == {1: "unexpected", 2: "unexpected", None: "unexpected"}


def test_counts_and_a_plain_tree(spark):
    a = rows(spark)
    _, (tree, _) = trees(spark, a, a)
    nodes = {(r["level"], r["node"]): r["n"] for r in tree.collect()}
    places = [r["place"] for r in digest_tree.placed(a, ["k"]).collect()]
    assert nodes == {(d, p): n for d in range(3) for p, n in Counter(x[:d] for x in places).items()}


def test_equal_subtrees_are_not_entered(spark):
    a = rows(spark)
    b = a.withColumn("text", F.when(F.col("k") == 11, "other").otherwise(F.col("text")))
    _, both = trees(spark, a, b)
    where = digest_tree.placed(a, ["k"]).filter("k = 11").first()["place"]
    assert {(r["level"], r["node"]) for r in digest_tree.differing(*both).collect()} == {(d, where[:d]) for d in range(3)}


def test_sealed_tables_read_only_folders_that_differ(spark, tmp_path):
    a = rows(spark)
    paths = [str(tmp_path / n) for n in "ab"]
    digest_tree.seal(a, paths[0], ["k"], ["at"])
    digest_tree.seal(a.withColumn("text", F.when(F.col("k") == 11, "other").otherwise(F.col("text"))), paths[1], ["k"], ["at"])
    where = digest_tree.placed(a, ["k"]).filter("k = 11").first()["place"][:2]
    assert [tuple(r) for r in digest_tree.sealed_changes(spark, paths[0], paths[0], ["k"]).collect()] == []
    for folder in tmp_path.glob("[ab]/rows/folder=*"):  # all other folders may be gone: nobody reads them
        if folder.name != f"folder={where}":
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"")
    assert [tuple(r) for r in digest_tree.sealed_changes(spark, *paths, ["k"]).collect()] == [(11, "changed")]
