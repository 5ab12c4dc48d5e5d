"""Tables that hold trained state: context models, model bags, training sets, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.operators.infinite import Bag, State
from strandlab.operators.markov import Model


def save_context(nodes: DataFrame, fit: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/pst_node")
    fit.write.mode("overwrite").parquet(f"{path}/pst_fit")


def load_context(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/pst_node"), spark.read.parquet(f"{path}/pst_fit")


def save_bag(spark, models: dict[int, Model], best: int | None, path: str) -> None:
    """Several models and which one is best (null if not chosen yet), as one table a kind, keyed by model."""
    kinds: dict[str, DataFrame] = {}
    for k, m in models.items():
        for name, rows in m.tables(spark).items():
            rows = rows.select(F.lit(k).alias("model"), "*")
            kinds[name] = rows if name not in kinds else kinds[name].unionByName(rows)
    for name, rows in kinds.items():
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(best,)], "best_model int").write.mode("overwrite").parquet(f"{path}/bag")


def load_model(spark, path: str, model: int | None = None) -> Model:
    """A model of the bag, by default the best one."""
    import numpy as np

    k = model if model is not None else spark.read.parquet(f"{path}/bag").first()["best_model"]
    if k is None:
        raise ValueError("no best model was chosen")
    read = lambda n: spark.read.parquet(f"{path}/{n}").where(F.col("model") == k).toPandas()  # noqa: E731  states squared rows
    p = read("fhmm_param").iloc[0]
    m = Model(np.zeros((int(p.k), int(p.k))), np.zeros((int(p.k), int(p.letters))), np.zeros(int(p.letters)), float(p.tau))
    for r in read("fhmm_transition").itertuples():
        m.transition[r.from_state, r.to_state] = r.t
    for r in read("fhmm_emission").itertuples():
        m.emission[r.state, r.code] = r.p
    for r in read("fhmm_background").itertuples():
        m.background[r.code] = r.p
    return m


def save_training(seqs: DataFrame, path: str) -> None:
    """seq_id, codes, labels (one array a model) and whatever weights the table has."""
    seqs.write.mode("overwrite").parquet(f"{path}/sequences")


def checkpoint(bag: Bag, path: str) -> None:
    """All that is needed to go on: labels and weights, and each model's sampler state; the state is written last, so an
    iteration without one is no checkpoint."""
    at = f"{path}/iter={bag.iteration:08d}"
    bag.labels.write.mode("overwrite").parquet(f"{at}/labels")
    rows = [(m, [float(x) for x in s.beta], float(s.alpha), float(s.gamma)) if s else (m, None, None, None) for m, s in enumerate(bag.states)]
    state = bag.labels.sparkSession.createDataFrame(rows, "model int, beta array<double>, alpha double, gamma double")
    run = {"iteration": bag.iteration, "seed": bag.seed, "letters": bag.letters, "competitive": bag.competitive, "inner": bag.inner}
    state.select("*", *(F.lit(v).alias(k) for k, v in run.items())).coalesce(1).write.mode("overwrite").parquet(f"{at}/state")


def resume(spark, path: str, iteration: int | None = None) -> Bag:
    """The run as it was at that checkpoint, by default the last one."""
    import numpy as np

    if iteration is None:
        iteration = spark.read.schema("iteration int").parquet(f"{path}/iter=*/state").agg(F.max("iteration")).first()[0]
    at = f"{path}/iter={iteration:08d}"
    rows = spark.read.parquet(f"{at}/state").orderBy("model").collect()  # one row a model
    states = [State(np.array(r["beta"]), r["alpha"], r["gamma"], iteration) if r["beta"] is not None else None for r in rows]
    one = rows[0]
    return Bag(spark.read.parquet(f"{at}/labels"), states, one["seed"], one["letters"], iteration, one["competitive"], one["inner"])


def packed(seqs: DataFrame, size: int) -> DataFrame:
    """chunk, seq_id, start, len: places in a concatenated store of so many sequences a chunk, by id."""
    from pyspark.sql import Window

    w = Window.partitionBy("chunk").orderBy("seq_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = seqs.select(F.floor(F.col("seq_id") / size).alias("chunk"), "seq_id", F.length("seq").cast("long").alias("len"))
    return rows.withColumn("start", F.coalesce(F.sum("len").over(w), F.lit(0)))
