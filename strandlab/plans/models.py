"""Queries on hidden Markov models, and alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlab.functions import sequences as S
from strandlab.operators import alignment as A
from strandlab.operators import families as Q
from strandlab.operators import infinite as N
from strandlab.operators import markov as H
from strandlab.operators import simulate as G
from strandlab.operators.orders import ranked
from strandlab.plans.context import deep_z_scored, scored, scores_sql
from strandlab.plans.counting import EMISSION, event_emissions, event_transitions, labelled_events
from strandlab.plans.registry import query
from strandlab.plans.sequences import dna
from strandlab.session import folder, table, written
from strandlab.sources import models

#: One letter for each event type, in the order of their codes.
EVENT_LETTERS = "cepsv"


def event_codes(spark, d: str) -> DataFrame:
    """seq_id, codes: a user's event types in order of time (a user's events are a bounded list)."""
    e = labelled_events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.col("state") - 2).alias("c")))).alias("e"))
    return e.select(F.col("user_id").alias("seq_id"), F.col("e.c").alias("codes"))


@query("hmm_forward")
def hmm_forward(spark, d):
    """Bit scores and P-values of all documents, as DNA, under a calibrated model."""
    return H.score_table(dna(spark, d), H.calibrated(H.toy_model()), alphabet=S.DNA)


@query("hmm_search")
def hmm_search(spark, d):
    """Model search: only sequences that pass the context model's filter (z >= 3.0, at full depth) are scored;
    E = P x database size."""
    passed = written(deep_z_scored(spark, d).where("z >= 3.0").select("seq_id"), "passed")
    rows = dna(spark, d).join(passed.distinct(), "seq_id", "left_semi")
    size = table(spark, d, "documents").agg(F.count("*").alias("db_size"))
    hits = H.score_table(rows, H.calibrated(H.toy_model()), alphabet=S.DNA).join(F.broadcast(size))
    return hits.select("seq_id", "score", "score_bias", "p", "p_bias", (F.col("p") * F.col("db_size")).alias("e"), (F.col("p_bias") * F.col("db_size")).alias("e_bias"))


@query("hmm_backward")
def hmm_backward(spark, d):
    """Forward and backward totals and the decoded path of the users' events."""
    return H.label_table(event_codes(spark, d), events_model(spark, d, 0))


@query("hmm_posterior_path")
def hmm_posterior_path(spark, d):
    """Users' event sequences decoded under the model of the events' own counts."""
    return H.label_table(event_codes(spark, d), events_model(spark, d, 0)).select("seq_id", "path")


def events_model(spark, d: str, draws: int) -> H.Model:
    """A finite model of the labelled events: states are event types, letters are event types too."""
    t = np.zeros((7, 7))
    for r in event_transitions(spark, d).collect():  # states squared
        t[r["from_state"], r["to_state"]] = r["n"]
    n = t[2:, 2:].sum(axis=0)
    return H.from_counts(t[2:, 2:], np.diag(n), n / n.sum(), draws=draws)


@query("hmm_from_counts")
def hmm_from_counts(spark, d):
    """The events' model as the mean of 1000 posterior draws."""
    return events_model(spark, d, 1000).tables(spark)["fhmm_transition"]


@query("hmm_score_models")
def hmm_score_models(spark, d):
    """Every user's events under two models."""
    m = events_model(spark, d, 0)
    return H.score_models(event_codes(spark, d), {"events": m, "bias": H.bias_of(m)})


@query("hmm_calibrate")
def hmm_calibrate(spark, d):
    """Size, entropy and exponential tail of the events' model."""
    return H.calibrated(events_model(spark, d, 0)).tables(spark)["fhmm_param"]


@query("hmm_emission_table", f"WITH {EMISSION} SELECT state, symbol, round(n, 9) AS n, round(bg, 9) AS bg, round(p, 9) AS p FROM em")
def hmm_emission_table(spark, d):
    return event_emissions(spark, d).select("state", "symbol", *(F.round(c, 9).alias(c) for c in ("n", "bg", "p")))


@query("hmm_score_modes")
def hmm_score_modes(spark, d):
    """Every score of the users' events under their own model: forward, backward and null totals, log-odds against the
    null and the bias model, and their P-values."""
    return H.score_modes(event_codes(spark, d), H.calibrated(events_model(spark, d, 0)))


@query("score_ranks", f"WITH {scores_sql(1)}, r AS (SELECT seq_id, round(score, 4) + 0.0 AS score FROM sc) SELECT seq_id, score, row_number() OVER (ORDER BY score DESC, seq_id) AS place, round(row_number() OVER (ORDER BY score DESC, seq_id) / (SELECT count(*) FROM sc), 9) AS share FROM r")
def score_ranks(spark, d):
    """Scores of a table by rank, the highest first, and each rank's share of the table."""
    rows = scored(spark, d, 1).select("seq_id", (F.round("score", 4) + 0.0).alias("score"))
    every = rows.agg(F.count("*").alias("every"))  # one row
    return ranked(rows, [F.desc("score"), "seq_id"]).join(F.broadcast(every)).select("seq_id", "score", "place", F.round(F.col("place") / F.col("every"), 9).alias("share"))


@query("hmm_eval_table")
def hmm_eval_table(spark, d):
    """Scores, P- and E-values of 10,000 random sequences of each of three lengths, by rank."""
    m = H.calibrated(events_model(spark, d, 0))
    out = None
    for length in (100, 400, 1600):
        rows = G.random_sequences(spark, 10_000, length, EVENT_LETTERS, list(m.background), seed=length).select("seq_id", S.encode("seq", EVENT_LETTERS).alias("codes"))
        ordered = H.score_table(rows, m).select(F.row_number().over(Window.orderBy(F.desc("score"), "seq_id")).alias("place"), F.col("score").alias(f"score_{length}"), F.col("p").alias(f"p_{length}"), (F.col("p") * 10_000).alias(f"e_{length}"))
        out = ordered if out is None else out.join(ordered, "place")
    return out


@query("hmm_emit")
def hmm_emit(spark, d):
    """Sequences emitted by the events' model."""
    return G.emitted(spark, events_model(spark, d, 0), 100, 50, EVENT_LETTERS, seed=2)


@query("ihmm_initial_labels")
def ihmm_initial_labels(spark, d):
    return N.initial_labels(event_codes(spark, d), 10, 3)


@query("ihmm_train")
def ihmm_train(spark, d):
    """Labels of the users' event sequences after five iterations of beam sampling."""
    labels, _, _ = N.train(event_codes(spark, d), 5, 5, states=10)
    return labels.select("seq_id", "labels")


@query("ihmm_to_finite")
def ihmm_to_finite(spark, d):
    """The finite model that beam sampling arrives at."""
    _, _, model = N.train(event_codes(spark, d), 5, 3, states=10)
    return model.tables(spark)["fhmm_emission"]


@query("ihmm_resume")
def ihmm_resume(spark, d):
    """The same as ihmm_train: three iterations, a checkpoint, and two more from there."""
    path = folder(spark, "checkpoint")
    models.checkpoint(N.start(event_codes(spark, d), 5, states=10).run(3), path)
    labels, _, _ = N.relabelled(*(lambda b: (b.labels, b.states))(models.resume(spark, path).run(2)))
    return labels.select("seq_id", "labels")


def competing(spark, d: str) -> N.Bag:
    return N.start(event_codes(spark, d), 5, states=8, models=2, competitive=True, inner=2).run(4)


@query("ihmm_competitive")
def ihmm_competitive(spark, d):
    """Two models that compete for the users' event sequences: labels and weights after four iterations."""
    return competing(spark, d).labels.select("model", "seq_id", "labels", "weight")


@query("ihmm_bag")
def ihmm_bag(spark, d):
    """The finite models of the same bag, stored, and the best one of them by BIC, read back."""
    bag, path = competing(spark, d), folder(spark, "bag")
    models.save_bag(spark, dict(enumerate(bag.finite())), N.best(bag), path)
    return models.load_model(spark, path).tables(spark)["fhmm_emission"]


@query("multiple_alignment")
def multiple_alignment(spark, d):
    """Families of the benchmark's passages, as DNA, aligned."""
    rows = table(spark, d, "benchmark").select("item_id", F.translate(S.letters_of("text"), S.LETTERS, "ACGTACGTACGTACGTACGTACGTAC").alias("seq"))
    many = max(20, -(-rows.count() // 50))  # families of at most about 50
    return A.align_groups(rows.select((F.col("item_id") % many).alias("grp"), F.col("item_id").alias("seq_id"), "seq"))


@query("family_alignment")
def family_alignment(spark, d):
    """All of the benchmark's passages, as DNA, aligned as one family over tasks."""
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("seq_id"), F.translate(S.letters_of("text"), S.LETTERS, "ACGTACGTACGTACGTACGTACGTAC").alias("seq"))
    return Q.align_family(rows, S.DNA)


@query("ihmm_labels_by_emission")
def ihmm_labels_by_emission(spark, d):
    return N.emission_labels(event_codes(spark, d), 8, 5, 0.5, 3)


@query("ihmm_labels_by_guess")
def ihmm_labels_by_guess(spark, d):
    """First labels drawn from a guessed model along each sequence."""
    return N.guessed_labels(event_codes(spark, d), 10, 5, 1.0, 3).select("seq_id", "labels")


@query("ihmm_labels_by_model")
def ihmm_labels_by_model(spark, d):
    return N.model_labels(event_codes(spark, d), 6, 5, 0.5, 3)


@query("hmm_gumbel_of_lengths")
def hmm_gumbel_of_lengths(spark, d):
    """Gumbel parameters for random sequences as long as the users' (one row a length comes to the driver)."""
    rows = table(spark, d, "events").groupBy("user_id").count().groupBy(F.col("count").alias("len")).count().orderBy("len").collect()
    mu, lam = H.gumbel_of_lengths(H.toy_model(), np.array([r["len"] for r in rows]), np.array([r["count"] for r in rows]), 20_000)
    return spark.createDataFrame([(float(mu), float(lam))], "mu double, lambda double")


for _kind in ("concat", "embedded", "two_state"):

    @query(f"sim_example_{_kind}")
    def sim_example(spark, d, kind=_kind):
        return G.emitted(spark, G.example_model(kind), 100, 200, S.DNA, seed=4)


@query("sql_functions", "WITH s AS (SELECT user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) AS seq FROM events GROUP BY user_id) SELECT user_id, CAST(i - 1 AS INTEGER) AS pos, substring(seq, i, 4) AS kmer FROM (SELECT user_id, seq, unnest(range(1, length(seq) - 2)) AS i FROM s)")
def sql_functions(spark, d):
    """The registered table function, called from SQL."""
    from strandlab.functions.registered import register
    from strandlab.plans.motifs import user_strings

    register(spark, H.toy_model())
    user_strings(spark, d).createOrReplaceTempView("strandlab_users")
    return spark.sql("SELECT seq_id AS user_id, k.pos, k.kmer FROM strandlab_users, LATERAL kmers(seq, 4) k")


@query("sql_scores")
def sql_scores(spark, d):
    """The registered model functions, called from SQL."""
    from strandlab.functions.registered import register

    register(spark, events_model(spark, d, 0))
    event_codes(spark, d).createOrReplaceTempView("strandlab_codes")
    return spark.sql("SELECT seq_id, forward_score(codes) AS score, posterior_path(codes) AS path FROM strandlab_codes")
