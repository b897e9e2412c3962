"""Queries over the layout of stories. A customer stands for a building, its orders for space types."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandloom.operators import stories
from demandloom.plans import inputs
from demandloom.plans.registry import query


def space_types(spark, sf_dir):
    return inputs.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("model_id"), F.col("o_orderkey").alias("space_type"), F.col("o_orderkey").alias("type_order"),
        F.floor("o_totalprice").cast("double").alias("floor_area"),
    )


def building_stories(spark, sf_dir):
    """None to four equal stories per building."""
    totals = space_types(spark, sf_dir).groupBy("model_id").agg(F.sum("floor_area").alias("total"))
    n = F.col("model_id") % 5
    numbered = totals.where(n > 0).select("model_id", "total", n.alias("n"), F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("story_no"))
    return numbered.select(
        "model_id", "story_no", F.floor(F.col("total") / F.col("n")).cast("double").alias("story_area"),
        F.floor(F.col("total") / F.col("n") / 12).cast("double").alias("min_area"),
    )


LAYOUT_SQL = """
ty AS (SELECT o_custkey AS m, o_orderkey AS t, floor(o_totalprice) AS area,
              sum(floor(o_totalprice)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a1 FROM orders),
types AS (SELECT *, a1 - area AS a0 FROM ty),
st AS (SELECT m, CAST(s AS BIGINT) AS s, floor(total / n) AS area, floor(total / n / 12) AS least
  FROM (SELECT m, sum(area) AS total, m % 5 AS n FROM types GROUP BY m), range(1, 5) r(s) WHERE s <= n),
stories AS (SELECT *, (s - 1) * area AS s0, s * area AS s1, lead(area) OVER (PARTITION BY m ORDER BY s) AS next_area FROM st),
cut AS (SELECT x.m, s, least, a0, a1, s1, s1 - greatest(a0, s0) AS head, a1 - s1 AS tail, (s1 - s0) / 2 AS below, next_area / 2 AS above
  FROM stories x JOIN types y ON x.m = y.m AND a0 < s1 AND a1 > s1 WHERE next_area IS NOT NULL AND a1 - a0 >= least),
trade AS (SELECT *, head < least AS grows FROM (SELECT *, CASE
    WHEN head < least THEN least(5 * least, tail - least, below - head, above)
    WHEN tail < least THEN least(5 * least, head - least, below, above - tail) END AS swap FROM cut) WHERE swap >= least),
around AS (SELECT m, s, CASE WHEN grows THEN a0 - swap ELSE s1 - swap END AS b, CASE WHEN grows THEN a0 ELSE a1 END AS turn,
  CASE WHEN grows THEN s1 + swap ELSE a1 + swap END AS e FROM trade),
dealt AS (
  SELECT x.m, x.s, coalesce(l.e, s0) AS lo, coalesce(u.b, s1) AS hi FROM stories x
    LEFT JOIN around u ON u.m = x.m AND u.s = x.s LEFT JOIN around l ON l.m = x.m AND l.s = x.s - 1
  UNION ALL SELECT m, s + 1, b, turn FROM around UNION ALL SELECT m, s, turn, e FROM around)"""


@query(
    "story_space_types",
    f"""WITH {LAYOUT_SQL}
SELECT y.m AS model_id, s AS story_no, t AS space_type, round(sum(least(hi, a1) - greatest(lo, a0)), 4) AS area
FROM types y JOIN dealt d ON d.m = y.m AND lo < a1 AND hi > a0 GROUP BY ALL
UNION ALL SELECT y.m, NULL, t, round(a1 - greatest(a0, coalesce(top, 0)), 4)
FROM types y LEFT JOIN (SELECT m, max(s1) AS top FROM stories GROUP BY m) USING (m) WHERE a1 > coalesce(top, 0)""",
)
def story_space_types(spark, sf_dir):
    laid = stories.lay_over_stories(space_types(spark, sf_dir), building_stories(spark, sf_dir), block=4096)
    return laid.select("model_id", "story_no", "space_type", F.round("area", 4).alias("area"))
