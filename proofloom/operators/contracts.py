"""Guards over evaluation data: contracts of cases, protocol distributions, pairing, drift and leakage. Findings are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contiguous_ids(cases: DataFrame, key: str, ids: str, prefix: str) -> DataFrame:
    """Cases whose array of ids is not prefix1, prefix2, ... in order."""
    want = F.transform(F.col(ids), lambda _, i: F.concat(F.lit(prefix), (i + 1).cast("string")))
    return cases.filter(F.size(ids) > 0).filter(F.col(ids) != want).select(key)


def inconsistent_groups(rows: DataFrame, group: list[str], attributes: list[str]) -> DataFrame:
    """Groups whose rows disagree on an attribute, with the attribute."""
    per = rows.groupBy(*group).agg(*(F.count_distinct(F.coalesce(F.col(a).cast("string"), F.lit("␀"))).alias(a) for a in attributes))
    bad = F.array_compact(F.array(*(F.when(F.col(a) > 1, F.lit(a)) for a in attributes)))
    return per.select(*group, F.explode(bad).alias("attribute"))


def uncovered(domain: list, rows: DataFrame, column: str) -> DataFrame:
    """Values of a domain that no row has."""
    spark = rows.sparkSession
    kind = rows.schema[column].dataType.simpleString()
    return spark.createDataFrame([(v,) for v in domain], f"{column} {kind}").join(rows.select(column).distinct(), column, "left_anti")


def distribution(rows: DataFrame, columns: list[str]) -> DataFrame:
    """attribute, value, n_questions for each of several attributes, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns)))
    return rows.select(pairs.alias("p")).groupBy("p.attribute", "p.value").agg(F.count(F.lit(1)).alias("n_questions"))


def per_scenario_bounds(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_scenarios"), F.min("n").alias("min_questions"), F.max("n").alias("max_questions"))


def pairing_problems(questions: DataFrame, paired: DataFrame, same: list[str]) -> DataFrame:
    """(question_id, problem) of questions and their counterparts: missing on a side, or differing where they must not."""
    a = questions.select("question_id", *same)
    b = paired.select(F.col("paired_question_id").alias("question_id"), *(F.col(c).alias(f"__{c}") for c in same), F.lit(True).alias("__there"))
    rows = a.withColumn("__here", F.lit(True)).join(b, "question_id", "full_outer")
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    problem = F.when(F.col("__there").isNull(), "no_counterpart").when(F.col("__here").isNull(), "unknown_question").when(differs, "differs")
    return rows.withColumn("problem", problem).filter("problem is not null").select("question_id", "problem")


def restored_marks_only(before: Column, after: Column, strip) -> Column:
    """Whether two texts differ in nothing but diacritics. ``strip`` takes them off."""
    return (strip(before) == strip(after)) & (before != after)


def null_controls(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of two runs of one condition that are not the same; any row is a defect of the experiment."""
    right = b.select(*keys, *(F.col(v).alias(f"__{v}") for v in values), F.lit(True).alias("__b"))
    rows = a.select(*keys, *values).withColumn("__a", F.lit(True)).join(right, keys, "full_outer")
    same = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"__{v}"))
    return rows.filter(~same).select(*keys)


def expected_failures(results: DataFrame, matrix: DataFrame) -> DataFrame:
    """Failed checks with the class that a matrix of known failures gives them, else unexplained."""
    return results.filter(~F.col("passed")).join(F.broadcast(matrix), ["scenario", "check"], "left").withColumn("class", F.coalesce("class", F.lit("unexplained")))


def separation(signals: DataFrame) -> DataFrame:
    """question_id, top1 and the smallest and largest top1 of all other questions: only the two at each end matter."""
    rows = signals.select("question_id", "top1").filter("top1 is not null")

    def ends(order: Column) -> DataFrame:
        two = rows.orderBy(order, "question_id").limit(2)
        return two.agg(F.array_agg(F.struct("question_id", "top1")).alias("two"))

    low = ends(F.asc("top1")).select(F.array_sort("two", lambda x, y: F.when(x["top1"] < y["top1"], -1).when(x["top1"] > y["top1"], 1).otherwise(0)).alias("low"))
    high = ends(F.desc("top1")).select(F.array_sort("two", lambda x, y: F.when(x["top1"] > y["top1"], -1).when(x["top1"] < y["top1"], 1).otherwise(0)).alias("high"))
    other = lambda side: F.get(F.filter(side, lambda e: e["question_id"] != F.col("question_id")), F.lit(0))["top1"]
    both = signals.join(F.broadcast(low.join(high)))
    return both.select("question_id", "top1", other("low").alias("min_other"), other("high").alias("max_other"))


def question_set_problems(questions: DataFrame) -> DataFrame:
    """(question_id, problem) of a question set before it is sealed: blank text, confirmation without judgments, judgments where none may be, a reason missing."""
    c = F.col
    found = F.array_compact(
        F.array(
            F.when(F.trim("question") == "", "blank_question"),
            F.when((c("status") == "CONFIRMED") & ~c("no_relevant_evidence") & (c("n_judgments") == 0), "confirmed_without_judgments"),
            F.when(c("no_relevant_evidence") & (c("n_relevant") > 0), "relevant_where_none_expected"),
            F.when(c("excluded_from_metrics") & c("exclusion_reason").isNull(), "exclusion_without_reason"),
        )
    )
    return questions.select("question_id", F.explode(found).alias("problem"))
