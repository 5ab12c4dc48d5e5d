"""Further rounds of line dedup meet intervals of holders."""

from pyspark.sql import functions as F

from strandlab.llm.linededup import further_holders


def test_line_rounds_cut_holders_before_the_join(spark):
    """10,000 holders of one window: a round's join meets an interval of them, not all pairs."""
    n = 10_000
    held = spark.range(n).select(F.lit(1).cast("long").alias("k1"), F.lit(2).cast("long").alias("k2"), F.lit(n).alias("n"), F.col("id").alias("d"), F.lit(0).cast("long").alias("t"))
    tried = further_holders(held, held, 8, 64)
    plan = tried._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join Inner" in x]
    assert joins and all("shiftrightunsigned" not in x for x in joins) and "Filter" in plan and plan.index("Join Inner") < plan.index("shiftrightunsigned")
    holders = tried.select("od").distinct().count()
    assert 30 <= holders <= 90 and tried.count() <= n * holders
    every = sum(further_holders(held, held.where("d = 9999"), a, b).count() for a, b in ((0, 8), (8, 64), (64, 512), (512, 4096), (4096, 32768)))
    assert every == n - 1  # the intervals together are all earlier holders, each once
