"""Queries that evaluate models: ROC curves, score matrices, merged score files, simulated benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.functions import sequences as S
from strandlab.operators import information as I
from strandlab.operators import simulate as G
from strandlab.plans.registry import query
from strandlab.plans.statistics import _MODELS, model_scores
from strandlab.session import table

_AUC = "SELECT {by} CAST(sum(p * (below + q / 2.0)) / (sum(p) * sum(q)) AS DOUBLE) AS auc FROM (SELECT *, coalesce(sum(q) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ({n}) z) y {group}"


def symbol_share(spark, d: str) -> DataFrame:
    """doc_id, quality, score: the share of letters and blanks in the text."""
    q = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = F.length(F.regexp_replace("text", r"[#*$%&|!]", "")) / F.length("text")
    return table(spark, d, "documents").where("text <> ''").select("doc_id", F.round(share, 4).alias("score")).join(q, "doc_id")


@query("roc_auc", "WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id), s AS (SELECT quality, round(length(regexp_replace(text, '[#*$%&|!]', '', 'g')) / length(text), 4) AS score FROM documents JOIN q ON q.doc_id = documents.doc_id WHERE text <> '') SELECT round(auc, 8) AS auc FROM (" + _AUC.format(by="", part="", group="", n="SELECT score, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality <> 1) AS q FROM s GROUP BY score") + ")")
def roc_auc(spark, d):
    """How well the share of plain characters tells good documents from poor ones."""
    return I.rank_auc(symbol_share(spark, d), "score", F.col("quality") == 1).select(F.round("auc", 8).alias("auc"))


@query("roc_auc_by_model", f"WITH {_MODELS}, s AS (SELECT model, lang = model AS hit, round(score / length(seq), 5) AS score FROM ms JOIN lg ON lg.doc_id = ms.seq_id JOIN seqs ON seqs.seq_id = ms.seq_id) SELECT model, round(auc, 6) AS auc FROM (" + _AUC.format(by="model,", part="PARTITION BY model", group="GROUP BY model", n="SELECT model, score, count(*) FILTER (WHERE hit) AS p, count(*) FILTER (WHERE NOT hit) AS q FROM s GROUP BY model, score") + ")")
def roc_auc_by_model(spark, d):
    """How well each language's letter model finds the documents of its language."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), "lang", F.length(S.letters_of("text")).alias("len"))
    s = model_scores(spark, d).join(docs, "seq_id").select("model", (F.col("lang") == F.col("model")).alias("hit"), F.round(F.col("score") / F.col("len"), 5).alias("score"))
    return I.rank_auc(s, "score", F.col("hit"), ["model"]).select("model", F.round("auc", 6).alias("auc"))


@query("score_matrix_pivot", f"WITH {_MODELS}, s AS (SELECT model, lang, score FROM ms JOIN lg ON lg.doc_id = ms.seq_id) SELECT model, " + ", ".join(f"round(avg(score) FILTER (WHERE lang = '{x}'), 3) AS {x}" for x in ("de", "en", "es", "fr")) + " FROM s GROUP BY model")
def score_matrix_pivot(spark, d):
    """Mean score of every model on every language's documents."""
    lang = table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), "lang")
    wide = model_scores(spark, d).join(lang, "seq_id").groupBy("model").pivot("lang", ["de", "en", "es", "fr"]).avg("score")
    return wide.select("model", *(F.round(c, 3).alias(c) for c in ("de", "en", "es", "fr")))


@query("merge_scores_inner", f"WITH {_MODELS} SELECT a.seq_id, round(coalesce(a.score, 0), 3) AS en, round(coalesce(b.score, 0), 3) AS fr FROM ms a JOIN ms b ON a.seq_id = b.seq_id WHERE a.model = 'en' AND b.model = 'fr'")
def merge_scores_inner(spark, d):
    """Two models' score files merged by name; missing scores are 0."""
    wide = model_scores(spark, d).groupBy("seq_id").pivot("model", ["en", "fr"]).agg(F.first("score"))
    return wide.where("en IS NOT NULL AND fr IS NOT NULL").select("seq_id", F.round(F.coalesce("en", F.lit(0.0)), 3).alias("en"), F.round(F.coalesce("fr", F.lit(0.0)), 3).alias("fr"))


@query("scores_melt", f"WITH {_MODELS}, w AS (SELECT seq_id, max(score) FILTER (WHERE model = 'de') AS de, max(score) FILTER (WHERE model = 'es') AS es FROM ms GROUP BY seq_id) SELECT seq_id, 'de' AS file, round(de, 3) AS score FROM w UNION ALL SELECT seq_id, 'es', round(es, 3) FROM w")
def scores_melt(spark, d):
    wide = model_scores(spark, d).groupBy("seq_id").pivot("model", ["de", "es"]).agg(F.first("score"))
    return wide.unpivot("seq_id", ["de", "es"], "file", "score").select("seq_id", "file", F.round("score", 3).alias("score"))


@query("hit_csv_rows", f"WITH {_MODELS} SELECT seq_id || ',' || printf('%.2f', round(score, 2)) AS line FROM ms WHERE model = 'en'")
def hit_csv_rows(spark, d):
    """Hits as comma-separated lines."""
    rows = model_scores(spark, d).where("model = 'en'")
    return rows.select(F.concat(F.col("seq_id").cast("string"), F.lit(","), F.format_string("%.2f", F.round("score", 2))).alias("line"))


@query("sim_challenge")
def sim_challenge(spark, d):
    """The planted-motif challenge with two mismatches in half of the sequence."""
    return G.challenge(spark, 2, 0.5)


@query("sim_challenge_gapped")
def sim_challenge_gapped(spark, d):
    return G.challenge(spark, 0, 0.5, gap=10)


@query("sim_benchmark")
def sim_benchmark(spark, d):
    return G.benchmark(spark, 1, 20, 100)


@query("sim_composition")
def sim_composition(spark, d):
    return G.composition(spark, 0.8, 50)


@query("sim_null_sequences")
def sim_null_sequences(spark, d):
    """Sequences of the protein null model."""
    return G.random_sequences(spark, 1000, 100, S.PROTEIN, list(I.AMINO.values()), seed=42)


@query("sim_uniform")
def sim_uniform(spark, d):
    """Uniform numbers and integers below 100."""
    return G.uniform_draws(spark, 10_000, 8, 100)


@query("sim_draws")
def sim_draws(spark, d):
    """Gamma, beta, binomial and normal draws."""
    kinds = {"gamma": {"shape": 6.0, "scale": 0.5}, "beta": {"a": 2.0, "b": 3.0}, "binomial": {"n": 10, "p": 0.3}, "normal": {"loc": 1.0, "scale": 2.0}}
    out = None
    for i, (kind, parameters) in enumerate(kinds.items()):
        rows = G.draws(spark, kind, 2000, i, **parameters).select(F.lit(kind).alias("kind"), "id", "x")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("sim_auc")
def sim_auc(spark, d):
    """ROC AUC of a toy model that finds ACGT, on sequences with and without planted copies."""
    from strandlab.operators import markov as H

    rows = G.random_sequences(spark, 200, 60, S.DNA, seed=5)
    pos = G.planted(rows, "ACGTACGTACGT", 0, 1.0, 5).select("seq_id", "seq", F.lit(1).alias("y"))
    neg = G.random_sequences(spark, 200, 60, S.DNA, seed=6, first=1000).select("seq_id", "seq", F.lit(0).alias("y"))
    both = pos.unionByName(neg).select("seq_id", "y", S.encode("seq", S.DNA).alias("codes"))
    scored = H.score_table(both, H.calibrated(H.toy_model())).join(both.select("seq_id", "y"), "seq_id")
    return I.rank_auc(scored, "score", F.col("y") == 1)
