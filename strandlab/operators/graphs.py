"""State graphs: paths, shortest paths, connectivity, pruning, edge lists for drawing."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.session import for_python


def paths(edges: DataFrame, depth: int, least: float) -> DataFrame:
    """path (array of states), length, log_p of all paths of 1 .. depth edges over edges with p >= least.

    One join a step with the edges (states squared, at most); edges: from_state, to_state, p."""
    e = edges.where(F.col("p") >= least)
    now = e.select(F.array("from_state", "to_state").alias("path"), F.log("p").alias("log_p"))
    out = now
    step = e.select(F.col("from_state").alias("f"), F.col("to_state").alias("t"), F.log("p").alias("lp"))
    for _ in range(depth - 1):
        now = now.join(F.broadcast(step), F.element_at("path", -1) == F.col("f")).select(F.concat("path", F.array("t")).alias("path"), (F.col("log_p") + F.col("lp")).alias("log_p"))
        out = out.unionByName(now)
    return out.select("path", (F.size("path") - 1).alias("length"), "log_p")


def shortest(edges: DataFrame, source, hops: int) -> DataFrame:
    """node, distance from source over at most hops edges (from_state, to_state, w), relaxing all edges once a hop."""
    now = edges.sparkSession.createDataFrame([(source, 0.0)], "node " + dict(edges.dtypes)["from_state"] + ", distance double")
    for _ in range(hops):
        more = now.join(F.broadcast(edges), now["node"] == edges["from_state"]).select(F.col("to_state").alias("node"), (F.col("distance") + F.col("w")).alias("distance"))
        now = now.unionByName(more).groupBy("node").agg(F.min("distance").alias("distance"))
    return now


def dijkstra(edges: list[tuple], source) -> tuple[dict, dict]:
    """Distances and predecessors from source in a small weighted graph [(from, to, weight)]."""
    out: dict = {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    distance, before, heap = {source: 0.0}, {}, [(0.0, str(source), source)]
    while heap:
        d, _, a = heapq.heappop(heap)
        if d > distance[a]:
            continue
        for b, w in out.get(a, ()):
            if d + w < distance.get(b, float("inf")):
                distance[b], before[b] = d + w, a
                heapq.heappush(heap, (d + w, str(b), b))
    return distance, before


def path_to(before: dict, node) -> list:
    out = [node]
    while out[-1] in before:
        out.append(before[out[-1]])
    return out[::-1]


def connectivity(edges: list[tuple]) -> float:
    """Mean shortest distance over the ordered pairs of nodes that a path joins; infinite if a pair has none."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)}, key=str)
    total, n = 0.0, 0
    for a in nodes:
        d, _ = dijkstra(edges, a)
        for b in nodes:
            if a != b:
                if b not in d:
                    return float("inf")
                total, n = total + d[b], n + 1
    return total / n if n else 0.0


def prune(edges: list[tuple], share: float, brute: bool = False) -> list[tuple]:
    """Removes share of the edges above a spanning number, never the last path between two nodes.

    By default the weakest first (weights are probabilities: small is weak); brute: at every step the edge whose removal
    lengthens the mean shortest path least.  A state graph has at most 1000 nodes, so this runs on the driver."""
    import math

    nodes = {x for a, b, _ in edges for x in (a, b)}
    many = int(share * max(0, len(edges) - (len(nodes) - 1)))
    reach = lambda es, a: set(dijkstra([(x, y, 1.0) for x, y, _ in es], a)[0])
    length = lambda es: [(a, b, -math.log(max(p, 1e-300))) for a, b, p in es]
    now, fixed = sorted(edges, key=lambda e: (e[2], str(e))), set()
    while many:
        if brute:
            tried = [(connectivity(length([x for x in now if x != e])), str(e), e) for e in now if e not in fixed]
            if not tried or min(tried)[0] == float("inf"):
                break
            now = [x for x in now if x != min(tried)[2]]
        else:
            e = next((x for x in now if x not in fixed), None)
            if e is None:
                break
            rest = [x for x in now if x != e]
            if e[1] in reach(rest, e[0]):
                now = rest
            else:
                fixed.add(e)
                continue
        many -= 1
    return now


#: Edges of a graph that tasks get at most: those of 2000 states.
EDGES = 4_000_000


def _weights(rows: list[tuple], number: dict) -> np.ndarray:
    """Lengths -ln p by numbers of nodes, infinite where there is no edge."""
    w = np.full((len(number), len(number)), np.inf)
    for a, b, p in rows:
        w[number[a], number[b]] = min(w[number[a], number[b]], -math.log(max(p, 1e-300)))
    return w


def lengths_from(w: np.ndarray, source: int) -> np.ndarray:
    """Shortest distances from a node in a dense graph."""
    d, open_ = np.full(len(w), np.inf), np.ones(len(w), dtype=bool)
    d[source] = 0.0
    while True:
        at = int(np.where(open_, d, np.inf).argmin())
        if not open_[at] or not np.isfinite(d[at]):
            return d
        open_[at] = False
        np.minimum(d, d[at] + w[at], out=d)


def _listed(edges: DataFrame) -> list[tuple]:
    """The edges (from_state, to_state, p) in order; their number is checked."""
    if edges.count() > EDGES:
        raise ValueError(f"a state graph has at most {EDGES} edges")
    return [tuple(r) for r in edges.select("from_state", "to_state", "p").orderBy("from_state", "to_state").collect()]


def _over_tasks(spark, items: list[int], work, kinds: str) -> list:
    """work(item) -> row, of all items, dealt out over tasks."""
    for_python(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [k.split()[0] for k in kinds.split(", ")]
        for pdf in batches:
            yield pd.DataFrame([work(int(i)) for i in pdf["item"]], columns=names)

    parts = max(1, min(len(items), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(i,) for i in items], "item long").repartition(parts).mapInPandas(run, kinds).collect()


def pair_distances(edges: DataFrame) -> DataFrame:
    """a, b, distance of all ordered pairs of different nodes (infinite without a path); sources are dealt over tasks."""
    spark, rows = edges.sparkSession, _listed(edges)
    nodes = sorted({x for a, b, _ in rows for x in (a, b)})
    if not nodes:
        return spark.createDataFrame([], "a int, b int, distance double")
    held = spark.sparkContext.broadcast(_weights(rows, {n: i for i, n in enumerate(nodes)}))
    for_python(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["item"]:
                d = lengths_from(held.value, int(i))
                other = [j for j in range(len(nodes)) if j != i]
                yield pd.DataFrame({"a": nodes[int(i)], "b": [nodes[j] for j in other], "distance": d[other]})

    sources = spark.range(len(nodes)).withColumnRenamed("id", "item").repartition(max(1, min(len(nodes), 4 * spark.sparkContext.defaultParallelism)))
    return sources.mapInPandas(run, "a int, b int, distance double")


def prune_weakest(edges: DataFrame, share: float, batch: int = 1000) -> list[tuple]:
    """prune() by weakness, with the search for other paths in tasks: an edge that is replaced by edges outside its batch
    goes whatever happens to the batch; only the others are tried one by one."""
    spark, rows = edges.sparkSession, _listed(edges)
    nodes = {x for a, b, _ in rows for x in (a, b)}
    many = int(share * max(0, len(rows) - (len(nodes) - 1)))
    order = sorted(rows, key=lambda e: (e[2], str(e)))
    fixed: list[tuple] = []
    at = 0
    while many and at < len(order):
        some, rest = order[at : at + batch], fixed + order[at + batch :]
        held = spark.sparkContext.broadcast((some, rest))
        safe = {r["item"] for r in _over_tasks(spark, list(range(len(some))), lambda i: (i, _reaches(held.value[1], *held.value[0][i][:2])), "item long, ok boolean") if r["ok"]}
        for k, e in enumerate(some):
            if not many:
                fixed += some[k:]
                break
            if k in safe or _reaches(fixed + some[k + 1 :] + order[at + batch :], *e[:2]):
                many -= 1
            else:
                fixed.append(e)
        at += batch
    return fixed + order[at:]


def _reaches(edges: list[tuple], source, target) -> bool:
    out: dict = {}
    for a, b, _ in edges:
        out.setdefault(a, []).append(b)
    seen, todo = {source}, [source]
    while todo:
        for b in out.get(todo.pop(), ()):
            if b == target:
                return True
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return False


def prune_least(edges: DataFrame, share: float) -> list[tuple]:
    """prune(brute=True) with the trials in tasks: at every step the edge goes whose removal lengthens the mean shortest
    path least (of equal ones the first by name).

    A trial starts from all distances as they are: only sources whose shortest path to the edge's end may use the edge
    are searched again.  Edges that no shortest path needs lengthen nothing, now and later, so they go without a trial."""
    spark, now = edges.sparkSession, _listed(edges)
    nodes = sorted({x for a, b, _ in now for x in (a, b)})
    number = {n: i for i, n in enumerate(nodes)}
    many = int(share * max(0, len(now) - (len(nodes) - 1)))
    if not many:
        return now
    w = _weights(now, number)
    d = np.stack([np.array(r["d"]) for r in sorted(_over_tasks(spark, list(range(len(nodes))), lambda i: (i, lengths_from(w, i).tolist()), "item long, d array<double>"), key=lambda r: r["item"])])
    np.fill_diagonal(w, np.inf)
    if not np.isfinite(d).all():
        return now
    by_name = lambda e: str(e)
    idle = sorted((e for e in now if e[0] == e[1] or d[number[e[0]], number[e[1]]] < w[number[e[0]], number[e[1]]] - 1e-12), key=by_name)[:many]
    gone = set(idle)
    now, many = [e for e in now if e not in gone], many - len(idle)
    for e in idle:
        w[number[e[0]], number[e[1]]] = np.inf
    while many and now:
        tried = sorted(now, key=by_name)
        held = spark.sparkContext.broadcast((w, d))

        def trial(i: int, tried=tried, held=held) -> tuple[int, float]:
            w, d = held.value
            a, b = number[tried[i][0]], number[tried[i][1]]
            sources = np.flatnonzero(d[:, a] + w[a, b] <= d[:, b] + 1e-12)
            w = w.copy()
            w[a, b] = np.inf
            return i, float(sum((lengths_from(w, int(s)) - d[s]).sum() for s in sources))

        more, i = min((round(r["more"], 9), r["item"]) for r in _over_tasks(spark, list(range(len(tried))), trial, "item long, more double"))
        if more == float("inf"):
            break
        a, b = number[tried[i][0]], number[tried[i][1]]
        sources = np.flatnonzero(d[:, a] + w[a, b] <= d[:, b] + 1e-12)
        w[a, b] = np.inf
        for s in sources:
            d[s] = lengths_from(w, int(s))
        now, many = [e for e in now if e != tried[i]], many - 1
    return now


def dot_lines(edges: DataFrame, p: str, least: float, colour: Column | None = None) -> DataFrame:
    """line: one Graphviz edge a row, for edges of at least that probability."""
    label = F.format_number(F.col(p), 2)
    tail = F.lit("") if colour is None else F.concat(F.lit(', color="'), colour, F.lit('"'))
    return edges.where(F.col(p) >= least).select(F.concat(F.lit("State"), F.col("from_state").cast("string"), F.lit(" -> State"), F.col("to_state").cast("string"), F.lit(' [label="'), label, F.lit('"'), tail, F.lit("];")).alias("line"))
