"""Queries on the graph of states."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlab.operators import graphs as G
from strandlab.operators.orders import ranked
from strandlab.plans.counting import TRANSITIONS, event_transitions
from strandlab.plans.registry import query

_P = f"{TRANSITIONS}, e AS (SELECT from_state, to_state, n / sum(n) OVER (PARTITION BY from_state) AS p FROM tr), x AS (SELECT * FROM e WHERE from_state >= 2 AND to_state >= 2)"


def edges(spark, d: str) -> DataFrame:
    """from_state, to_state, p between the labelled states."""
    p = event_transitions(spark, d).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from_state")))
    return p.where("from_state >= 2 AND to_state >= 2").select("from_state", "to_state", "p")


@query("dot_edges", f"""WITH {_P} SELECT 'State' || from_state || ' -> State' || to_state || ' [label="' || printf('%.2f', p) || '"];' AS line FROM x WHERE p >= 0.2""")
def dot_edges(spark, d):
    return G.dot_lines(edges(spark, d), "p", 0.2)


@query("state_paths_enumerate", f"""WITH RECURSIVE {_P}, s AS (SELECT from_state AS f, to_state AS t, ln(p) AS lp FROM x WHERE p >= 0.19),
pth AS (SELECT [f, t] AS path, 1 AS length, lp FROM s UNION ALL SELECT list_append(path, s.t), length + 1, pth.lp + s.lp FROM pth JOIN s ON s.f = pth.path[-1] WHERE length < 4)
SELECT path, CAST(length AS INTEGER) AS length, round(lp, 5) AS log_p FROM pth""")
def state_paths_enumerate(spark, d):
    """All paths of up to four strong edges."""
    return G.paths(edges(spark, d), 4, 0.19).select("path", "length", F.round("log_p", 5).alias("log_p"))


@query("shortest_path_bounded", f"""WITH RECURSIVE {_P}, s AS (SELECT from_state AS f, to_state AS t, -ln(p) AS w FROM x WHERE p >= 0.19),
r AS (SELECT CAST(2 AS INTEGER) AS node, 0.0::DOUBLE AS distance, 0 AS hops UNION ALL SELECT s.t, r.distance + s.w, hops + 1 FROM r JOIN s ON s.f = r.node WHERE hops < 3)
SELECT node, round(min(distance), 6) AS distance FROM r GROUP BY node""")
def shortest_path_bounded(spark, d):
    """Distances from state 2 over at most three strong edges, weighted by -ln p."""
    e = edges(spark, d).where("p >= 0.19").select("from_state", "to_state", (-F.log("p")).alias("w"))
    return G.shortest(e, 2, 3).select("node", F.round("distance", 6).alias("distance"))


@query("shortest_path_example", f"""WITH RECURSIVE {_P}, s AS (SELECT from_state AS f, to_state AS t, -ln(p) AS w FROM x),
r AS (SELECT CAST(2 AS INTEGER) AS node, 0.0::DOUBLE AS distance, 0 AS hops UNION ALL SELECT s.t, r.distance + s.w, hops + 1 FROM r JOIN s ON s.f = r.node WHERE hops < 4)
SELECT node, round(min(distance), 6) AS distance FROM r GROUP BY node""")
def shortest_path_example(spark, d):
    """Distances from state 2 over all edges, by Dijkstra's rule; five states, so four edges reach any of them."""
    found, _ = G.dijkstra(_lengths(spark, d), 2)
    return spark.createDataFrame(sorted(found.items()), "node int, distance double").select("node", F.round("distance", 6).alias("distance"))


def _lengths(spark, d: str) -> list[tuple]:
    """(from, to, -ln p); at most states squared rows."""
    return [(r["from_state"], r["to_state"], -math.log(r["p"])) for r in edges(spark, d).orderBy("from_state", "to_state").collect()]


@query("state_paths_sorted", f"""WITH RECURSIVE {_P}, s AS (SELECT from_state AS f, to_state AS t, ln(p) AS lp FROM x WHERE p >= 0.19),
pth AS (SELECT [f, t] AS path, 1 AS length, lp FROM s UNION ALL SELECT list_append(path, s.t), length + 1, pth.lp + s.lp FROM pth JOIN s ON s.f = pth.path[-1] WHERE length < 3)
SELECT path, CAST(length AS INTEGER) AS length, row_number() OVER (ORDER BY length DESC, round(lp, 9) DESC, path) AS place FROM pth""")
def state_paths_sorted(spark, d):
    """Paths of up to three strong edges, the longest and then the likeliest first."""
    rows = G.paths(edges(spark, d), 3, 0.19).withColumn("lp", F.round("log_p", 9))
    return ranked(rows, [F.desc("length"), F.desc("lp"), "path"]).select("path", "length", "place")


@query("prune_edges")
def prune_edges(spark, d):
    """The state graph without half of its spare edges; other paths are searched in tasks."""
    return spark.createDataFrame(G.prune_weakest(edges(spark, d), 0.5), "from_state int, to_state int, p double")


@query("prune_edges_brute")
def prune_edges_brute(spark, d):
    """The same by trying every edge at every step, in tasks."""
    return spark.createDataFrame(G.prune_least(edges(spark, d), 0.5), "from_state int, to_state int, p double")


@query("graph_connectivity", f"""WITH RECURSIVE {_P}, s AS (SELECT from_state AS f, to_state AS t, -ln(p) AS w FROM x),
r AS (SELECT DISTINCT f AS a, f AS node, 0.0::DOUBLE AS distance, 0 AS hops FROM s UNION ALL SELECT a, s.t, r.distance + s.w, hops + 1 FROM r JOIN s ON s.f = r.node WHERE hops < 4)
SELECT round(avg(distance), 9) AS mean_distance FROM (SELECT a, node, min(distance) AS distance FROM r WHERE a <> node GROUP BY a, node)""")
def graph_connectivity(spark, d):
    """Mean shortest distance between the states."""
    return G.pair_distances(edges(spark, d)).agg(F.round(F.avg("distance"), 9).alias("mean_distance"))
