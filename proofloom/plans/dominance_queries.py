"""Queries of dominance: customers stand for questions, their orders for items, and what an order holds for nine signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofloom.operators import dominance
from proofloom.plans.declare import query
from proofloom.sources import tables

SIGNALS = ["price", "lines", "quantity", "discount", "tax", "parts", "suppliers", "returned", "open_lines"]

_SCORED = """o AS (SELECT o_custkey AS question_id, o_orderkey AS item, floor(o_totalprice / 1000)::BIGINT AS price, count(l_linenumber) AS lines, coalesce(sum(l_quantity), 0)::BIGINT AS quantity,
    coalesce(max(round(l_discount * 100)), 0)::BIGINT AS discount, coalesce(max(round(l_tax * 100)), 0)::BIGINT AS tax, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers,
    count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_linestatus = 'O') AS open_lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
  s AS (SELECT *, price + 20 * lines + quantity + 5 * discount AS score FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, item) AS rank FROM s)"""


def orders_as_items(spark, sf_dir):
    """question_id, item, nine signals, score: one row an order."""
    c = F.col
    lines = tables.scan(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("l_linenumber").alias("lines"), F.sum("l_quantity").cast("long").alias("quantity"), F.max(F.round(c("l_discount") * 100)).cast("long").alias("discount"), F.max(F.round(c("l_tax") * 100)).cast("long").alias("tax"),
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_if(c("l_returnflag") == "R").alias("returned"), F.count_if(c("l_linestatus") == "O").alias("open_lines"),
    )
    orders = tables.scan(spark, sf_dir, "orders").select(c("o_custkey").alias("question_id"), c("o_orderkey").alias("item"), F.floor(c("o_totalprice") / 1000).alias("price"))
    rows = orders.join(lines, c("item") == c("l_orderkey"), "left").drop("l_orderkey").fillna(0, SIGNALS)
    return rows.withColumn("score", c("price") + 20 * c("lines") + c("quantity") + 5 * c("discount"))


def _compared(spark, sf_dir):
    """Each customer's newest order (the largest key) against those that the score puts before it."""
    items = orders_as_items(spark, sf_dir)
    newest = items.groupBy("question_id").agg(F.max_by(F.struct("item", "score", *SIGNALS), "item").alias("n")).select("question_id", "n.*")
    # Only whether an item is ranked before the target matters, so no ranking of a whole question is needed.
    ahead = items.join(newest.select("question_id", F.col("item").alias("__i"), F.col("score").alias("__s")), "question_id")
    before = (F.col("score") > F.col("__s")) | ((F.col("score") == F.col("__s")) & (F.col("item") < F.col("__i")))
    return dominance.compare(newest.withColumn("rank", F.lit(1)), ahead.withColumn("rank", F.when(before, 0).otherwise(1)).drop("__i", "__s"), SIGNALS)


_MASK = " + ".join(f"(CASE WHEN t.{s} > c.{s} THEN {1 << n} ELSE 0 END)" for n, s in enumerate(SIGNALS))
_NAMES = ", ".join(f"CASE WHEN m & {1 << SIGNALS.index(s)} > 0 THEN '{s}' END" for s in sorted(SIGNALS))
_PAIRS = f"""{_SCORED}, t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY item DESC) = 1),
  p AS (SELECT t.question_id, t.item AS target, c.item, ({_MASK})::INTEGER AS m, c.score - t.score AS score_gap FROM t JOIN r c ON c.question_id = t.question_id AND c.rank < t.rank)"""


@query(f"WITH {_PAIRS} SELECT question_id, target, item, array_to_string(list_filter([{_NAMES}], lambda x: x IS NOT NULL), ',') AS favours_target, m = 0 AS dominated, score_gap FROM p")
def signal_dominance(spark, sf_dir):
    """Target against competitor: the signals that favour the target, and whether it is dominated."""
    rows = _compared(spark, sf_dir)
    return rows.select("question_id", "target", "item", dominance.named(F.col("favours"), SIGNALS).alias("favours_target"), "dominated", "score_gap")


@query(f"""WITH {_PAIRS}, g AS (SELECT question_id, target, count(*) AS n_competitors, count_if(m = 0)::BIGINT AS n_dominating, bit_and(m) AS m FROM p GROUP BY ALL)
  SELECT question_id, target, n_competitors, n_dominating, array_to_string(list_filter([{_NAMES}], lambda x: x IS NOT NULL), ',') AS common_signals,
    CASE WHEN n_dominating > 0 THEN 'insufficient_signals' ELSE 'reweightable' END AS diagnosis FROM g""")
def ranking_cases(spark, sf_dir):
    """For each target how many competitors dominate it, and the signals that favour it against all of them."""
    return dominance.summary(_compared(spark, sf_dir), SIGNALS)


_OVER = " AND ".join(f"b.{s} >= a.{s}" for s in SIGNALS)
_SOME = " OR ".join(f"b.{s} > a.{s}" for s in SIGNALS)


@query(f"""WITH {_SCORED} SELECT a.question_id, a.item FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.question_id = a.question_id AND {_OVER} AND ({_SOME}))""")
def signal_skyline(spark, sf_dir):
    """The orders of each customer that no other of theirs beats in the nine signals: any of them is first under some monotone score."""
    return dominance.skyline(orders_as_items(spark, sf_dir), "question_id", "item", SIGNALS)
