"""Queries on information, agreement, tests and the competition of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlab.functions import mathematics as M
from strandlab.functions import sequences as S
from strandlab.operators import information as I
from strandlab.plans.counting import EMISSION, EV, TRANSITIONS, event_emissions, event_transitions, labelled_events
from strandlab.plans.registry import query
from strandlab.plans.sequences import SEQS
from strandlab.session import spread, table

_BITS = "CASE WHEN {p} <= 0 THEN 0.0 ELSE {p} * log2({p} / {q}) END"


@query("null_model", "WITH v(code, p) AS (VALUES " + ", ".join(f"({i}, CAST({v} AS DOUBLE))" for i, v in enumerate(I.AMINO.values())) + ") SELECT CAST(code AS INTEGER) AS code, round(p / sum(p) OVER (), 9) AS p FROM v")
def null_model(spark, d):
    return I.null_model(spark, 20).select("code", F.round("p", 9).alias("p"))


@query("bias_model", "SELECT * FROM (VALUES (0, 0, round(400.0::DOUBLE / 401, 9)), (0, 1, round(1.0::DOUBLE / 401, 9)), (1, 1, round(20.0::DOUBLE / 21, 9)), (1, 0, round(1.0::DOUBLE / 21, 9))) v(from_state, to_state, p)")
def bias_model(spark, d):
    from strandlab.operators.markov import bias_transitions

    return bias_transitions(spark, 20).select("from_state", "to_state", F.round("p", 9).alias("p"))


@query("relative_entropy_by_state", f"WITH {EMISSION} SELECT state, round(sum({_BITS.format(p='p', q='bg')}), 6) AS bits FROM em GROUP BY state")
def relative_entropy_by_state(spark, d):
    return I.relative_entropy(event_emissions(spark, d), "state").select("state", F.round("bits", 6).alias("bits"))


_KL = f"{EMISSION}, kl AS (SELECT a.state AS a, b.state AS b, sum({_BITS.format(p='a.p', q='b.p')} + {_BITS.format(p='b.p', q='a.p')}) / 2 AS kl FROM em a JOIN em b ON a.symbol = b.symbol AND a.state < b.state GROUP BY ALL)"


@query("symmetric_kl_pairs", f"WITH {_KL} SELECT a, b, round(kl, 6) AS kl FROM kl")
def symmetric_kl_pairs(spark, d):
    return I.symmetric_divergence(event_emissions(spark, d), "state", "symbol").select("a", "b", F.round("kl", 6).alias("kl"))


@query("merge_near_states", f"WITH {_KL}, m AS (SELECT b AS state, min(a) AS label FROM kl WHERE kl < 0.01 GROUP BY b) SELECT event_id, CAST(coalesce(label, ev.state) AS INTEGER) AS label FROM ev LEFT JOIN m ON m.state = ev.state")
def merge_near_states(spark, d):
    """States whose emissions differ by less than 0.01 bits take the smallest such state's label."""
    near = I.symmetric_divergence(event_emissions(spark, d), "state", "symbol").where("kl < 0.01").groupBy(F.col("b").alias("state")).agg(F.min("a").alias("label"))
    return labelled_events(spark, d).join(F.broadcast(near), "state", "left").select("event_id", F.coalesce("label", "state").alias("label"))


@query("emission_log_odds", f"WITH {EMISSION} SELECT state, symbol, round(ln(p / bg), 6) + 0.0 AS lod FROM em")
def emission_log_odds(spark, d):
    return event_emissions(spark, d).select("state", "symbol", (F.round(F.log(F.col("p") / F.col("bg")), 6) + 0.0).alias("lod"))


@query("hmm_setup", f"WITH {EMISSION}, r AS (SELECT state, sum({_BITS.format(p='p', q='bg')}) AS bits FROM em GROUP BY state) SELECT CAST(count(*) AS BIGINT) AS k, round(avg(bits), 6) AS h, round(ln(2) + 1.44 / (count(*) * avg(bits)), 3) AS lambda FROM r")
def hmm_setup(spark, d):
    """H, the mean relative entropy of the states, and the E-value slope that follows from it."""
    r = I.relative_entropy(event_emissions(spark, d), "state").agg(F.count("*").alias("k"), F.avg("bits").alias("h"))
    return r.select("k", F.round("h", 6).alias("h"), F.round(F.log(F.lit(2.0)) + 1.44 / (F.col("k") * F.col("h")), 3).alias("lambda"))


@query("composition_background", f"WITH {EMISSION}, o AS (SELECT state, count(*) AS occ FROM ev GROUP BY state) SELECT symbol, round(sum(occ * p) / sum(occ), 6) AS p FROM em JOIN o ON o.state = em.state GROUP BY symbol")
def composition_background(spark, d):
    """Mean emission, weighted by the states' occupancy."""
    occ = labelled_events(spark, d).groupBy("state").agg(F.count("*").alias("occ"))
    return event_emissions(spark, d).join(occ, "state").groupBy("symbol").agg(F.round(F.sum(F.col("occ") * F.col("p")) / F.sum("occ"), 6).alias("p"))


@query("dirichlet_mean", f"WITH {EV}, n AS (SELECT state, symbol, count(*) AS n FROM ev GROUP BY ALL), s AS (SELECT DISTINCT state FROM ev), y AS (SELECT DISTINCT symbol FROM ev) SELECT s.state, y.symbol, round((coalesce(n, 0) + 0.3) / (sum(coalesce(n, 0)) OVER (PARTITION BY s.state) + 0.3 * count(*) OVER (PARTITION BY s.state)), 6) AS p FROM s CROSS JOIN y LEFT JOIN n ON n.state = s.state AND n.symbol = y.symbol")
def dirichlet_mean(spark, d):
    """Posterior mean of each state's emissions under a symmetric prior of 0.3: what averaging draws converges to."""
    n = labelled_events(spark, d).groupBy("state", "symbol").agg(F.count("*").alias("n"))
    grid = n.select("state").distinct().join(F.broadcast(n.select("symbol").distinct()))  # states x symbols, both fixed
    full = grid.join(F.broadcast(n), ["state", "symbol"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("state")
    return full.select("state", "symbol", F.round((F.col("n") + 0.3) / (F.sum("n").over(w) + 0.3 * F.count("*").over(w)), 6).alias("p"))


@query("log_probabilities", f"WITH {TRANSITIONS}, p AS (SELECT *, n / sum(n) OVER (PARTITION BY from_state) AS p FROM tr) SELECT from_state, round(ln(sum(exp(ln(p)))) , 6) + 0.0 AS total, round(max(ln(p)), 6) AS top, round(1 / (1 + exp(-max(ln(p)))), 6) AS logistic FROM p GROUP BY from_state")
def log_probabilities(spark, d):
    """Each row of the transition matrix in logarithms: its total, its largest entry and that entry's logistic."""
    p = event_transitions(spark, d).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from_state"))).withColumn("lp", M.to_log("p"))
    g = p.groupBy("from_state").agg(F.sum(F.exp("lp")).alias("s"), F.max("lp").alias("top"))
    return g.select("from_state", (F.round(F.log("s"), 6) + 0.0).alias("total"), F.round("top", 6).alias("top"), F.round(M.logistic("top"), 6).alias("logistic"))


@query("log_sum_pairs", "SELECT event_id, round(greatest(a, b) + ln(1 + exp(-abs(a - b))), 6) AS s FROM (SELECT event_id, value / 7 AS a, value / 11 - 3 AS b FROM events)")
def log_sum_pairs(spark, d):
    return table(spark, d, "events").select("event_id", F.round(M.log_sum(F.col("value") / 7, F.col("value") / 11 - 3), 6).alias("s"))


@query("gumbel_quantile", "SELECT event_id, round(5 - ln(-ln((event_id % 999 + 0.5) / 1000)) / 0.7, 6) AS x FROM events")
def gumbel_quantile(spark, d):
    return table(spark, d, "events").select("event_id", F.round(M.gumbel_quantile((F.col("event_id") % 999 + 0.5) / 1000, 5.0, 0.7), 6).alias("x"))


@query("exp_survival", "SELECT event_id, round(CASE WHEN value < 20 THEN 1.0 ELSE exp(-0.05 * (value - 20)) END, 8) AS p FROM events")
def exp_survival(spark, d):
    return table(spark, d, "events").select("event_id", F.round(M.exponential_survival("value", 20.0, 0.05), 8).alias("p"))


@query("approximately_equal", "SELECT event_id, abs(value - floor(value)) <= 0.001 * greatest(abs(value), abs(floor(value))) AS close FROM events")
def approximately_equal(spark, d):
    return table(spark, d, "events").select("event_id", M.close(F.col("value"), F.floor("value").cast("double"), 0.001).alias("close"))


@query("colour_ramp", """WITH t AS (SELECT event_id, greatest(0.0, least(1.0, value / 60)) AS t FROM events), r AS (SELECT event_id, CASE WHEN t > 0 THEN ln(2 * t) ELSE -1.0 END AS r FROM t),
h AS (SELECT event_id, CAST(floor(greatest(0.0, r) * 255 + 0.5) AS BIGINT) AS red, CAST(floor(least(1.0, greatest(0.0, -r)) * 255 + 0.5) AS BIGINT) AS blue FROM r)
SELECT event_id, '#' || lpad(lower(to_hex(red)), 2, '0') || '00' || lpad(lower(to_hex(blue)), 2, '0') AS colour FROM h""")
def colour_ramp(spark, d):
    return table(spark, d, "events").select("event_id", M.colour("value", 0.0, 60.0).alias("colour"))


@query("mean_variance", "SELECT user_id, round(avg(value), 6) AS mean, round(var_samp(value), 5) AS variance FROM events GROUP BY user_id")
def mean_variance(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_samp("value"), 5).alias("variance"))


@query("adjusted_rand_index", "WITH c AS (SELECT label AS i, CAST(embedding[1] > 0 AS INTEGER) * 2 + CAST(embedding[2] > 0 AS INTEGER) AS j, count(*) AS n FROM embeddings GROUP BY ALL), s AS (SELECT sum(n * (n - 1.0)) AS s, sum(n) AS every FROM c), a AS (SELECT sum(m * (m - 1.0)) AS sa FROM (SELECT sum(n) AS m FROM c GROUP BY i)), b AS (SELECT sum(m * (m - 1.0)) AS sb FROM (SELECT sum(n) AS m FROM c GROUP BY j)) SELECT round(CAST((s - sa * sb / (every * (every - 1))) / ((sa + sb) / 2 - sa * sb / (every * (every - 1))) AS DOUBLE), 8) AS ari FROM s, a, b")
def adjusted_rand_index(spark, d):
    """Agreement of the vectors' labels with the quadrant of their first two dimensions."""
    e = table(spark, d, "embeddings")
    side = lambda k: (F.get("embedding", F.lit(k)) > 0).cast("int")
    cells = e.groupBy(F.col("label").alias("i"), (side(0) * 2 + side(1)).alias("j")).agg(F.count("*").alias("n"))
    return I.adjusted_rand(cells, "i", "j", "n").select(F.round("ari", 8).alias("ari"))


@query("label_contingency", f"WITH {EV}, l AS (SELECT event_id, 0 AS m, state AS x FROM ev UNION ALL SELECT event_id, 1, symbol FROM ev UNION ALL SELECT event_id, 2, CAST(user_id % 4 AS INTEGER) FROM ev) SELECT a.m AS a, b.m AS b, a.x AS x, b.x AS y, CAST(count(*) AS BIGINT) AS n FROM l a JOIN l b ON a.event_id = b.event_id AND a.m <= b.m GROUP BY ALL")
def label_contingency(spark, d):
    """Contingency tables of all pairs of three labelings: each row makes its own pairs, nothing is joined."""
    ev = labelled_events(spark, d)
    labels = ["state", "symbol", "third"]
    ev = ev.withColumn("third", (F.col("user_id") % 4).cast("int"))
    pairs = [F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.col(x).alias("x"), F.col(y).alias("y")) for i, x in enumerate(labels) for j, y in enumerate(labels) if i <= j]
    return ev.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.a", "p.b", "p.x", "p.y").agg(F.count("*").alias("n"))


@query("pairwise_ari", f"""WITH {EV}, l AS (SELECT event_id, 0 AS m, state AS x FROM ev UNION ALL SELECT event_id, 1, symbol FROM ev UNION ALL SELECT event_id, 2, CAST(user_id % 4 AS INTEGER) FROM ev),
c AS (SELECT a.m AS a, b.m AS b, a.x AS i, b.x AS j, count(*) AS n FROM l a JOIN l b ON a.event_id = b.event_id AND a.m <= b.m GROUP BY ALL),
s AS (SELECT a, b, sum(n * (n - 1.0)) AS s, sum(n) AS every FROM c GROUP BY a, b), x AS (SELECT a, b, sum(m * (m - 1.0)) AS sa FROM (SELECT a, b, i, sum(n) AS m FROM c GROUP BY a, b, i) GROUP BY a, b), y AS (SELECT a, b, sum(m * (m - 1.0)) AS sb FROM (SELECT a, b, j, sum(n) AS m FROM c GROUP BY a, b, j) GROUP BY a, b)
SELECT s.a, s.b, round(CAST((s - sa * sb / (every * (every - 1))) / ((sa + sb) / 2 - sa * sb / (every * (every - 1))) AS DOUBLE), 8) + 0.0 AS ari FROM s JOIN x ON x.a = s.a AND x.b = s.b JOIN y ON y.a = s.a AND y.b = s.b""")
def pairwise_ari(spark, d):
    """Agreement of all pairs of three labelings, each with itself too."""
    return I.adjusted_rand(label_contingency(spark, d), "x", "y", "n", ["a", "b"]).select("a", "b", (F.round("ari", 8) + 0.0).alias("ari"))


_G = """WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id), s AS (SELECT d.doc_id, q, lower(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents d JOIN l ON l.doc_id = d.doc_id),
k AS (SELECT DISTINCT doc_id, q, substring(seq, i, 2) AS kmer FROM (SELECT doc_id, q, seq, unnest(range(1, length(seq))) AS i FROM s)),
t AS (SELECT count(*) FILTER (WHERE q = 1) AS na, count(*) FILTER (WHERE q = 0) AS nb FROM s), c AS (SELECT kmer, count(*) FILTER (WHERE q = 1) AS a, count(*) FILTER (WHERE q = 0) AS b FROM k GROUP BY kmer)"""
_X = "CASE WHEN {0} > 0 THEN CAST({0} AS DOUBLE) * ln({0}) ELSE 0.0 END"
_GX = " + ".join(_X.format(c) for c in ("a", "(na - a)", "b", "(nb - b)", "(na + nb)")) + " - " + " - ".join(_X.format(c) for c in ("na", "nb", "(a + b)", "(na + nb - a - b)"))


def kmer_presence(spark, d: str) -> DataFrame:
    """kmer, a, b (documents of quality 1 and 0 with it), na, nb."""
    q = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    s = spread(table(spark, d, "documents").select("doc_id", "text")).join(q, "doc_id").select("doc_id", "q", S.letters_of("text").alias("seq"))
    k = s.select("q", F.explode(F.array_distinct(S.kmers("seq", 2))).alias("kmer"))
    c = k.groupBy("kmer").agg(F.count_if(F.col("q") == 1).alias("a"), F.count_if(F.col("q") == 0).alias("b"))
    return c.join(F.broadcast(s.agg(F.count_if(F.col("q") == 1).alias("na"), F.count_if(F.col("q") == 0).alias("nb"))))


@query("g_test_kmers", f"{_G} SELECT kmer, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round({_GX}, 5) + 0.0 AS g FROM c, t")
def g_test_kmers(spark, d):
    """2-mers by how unequally they occur in documents of good and of poor quality."""
    return kmer_presence(spark, d).select("kmer", "a", "b", (F.round(M.g_statistic("a", "na", "b", "nb"), 5) + 0.0).alias("g"))


@query("g_test_p_values")
def g_test_p_values(spark, d):
    """P-values of the same test, by the incomplete gamma function."""
    M.register(spark)
    rows = kmer_presence(spark, d).select("kmer", F.greatest(F.lit(0.0), M.g_statistic("a", "na", "b", "nb")).alias("g"))
    return rows.select("kmer", "g", F.expr("upper_gamma(0.5D, g)").alias("p"))


@query("data_log_likelihood")
def data_log_likelihood(spark, d):
    """Dirichlet-multinomial log likelihood of each state's emissions."""
    M.register(spark)
    n = labelled_events(spark, d).groupBy("state", "symbol").agg(F.count("*").alias("n"))
    rows = n.select("state", "n", F.expr("log_gamma(n + 0.3D) - log_gamma(0.3D)").alias("t"))
    g = rows.groupBy("state").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    return g.select("state", F.expr("t + log_gamma(3.0D) - log_gamma(n + 3.0D)").alias("log_likelihood"))


# every document under an order-0 letter model of each language
_MODELS = f"""{SEQS}, r AS (SELECT seq_id, residue, count(*) AS n FROM (SELECT seq_id, unnest(string_split(seq, '')) AS residue FROM seqs WHERE seq <> '') GROUP BY ALL),
lg AS (SELECT doc_id, lang FROM documents), m AS (SELECT lang AS model, residue, (sum(n) + 1.0) AS n FROM r JOIN lg ON lg.doc_id = r.seq_id GROUP BY ALL), mt AS (SELECT model, sum(n) AS total FROM m GROUP BY model),
g AS (SELECT mt.model, a.residue, ln(coalesce(CAST(m.n AS DOUBLE), 1.0) / CAST(mt.total AS DOUBLE)) AS lp FROM mt CROSS JOIN (SELECT DISTINCT residue FROM r) a LEFT JOIN m ON m.model = mt.model AND m.residue = a.residue),
ms AS (SELECT r.seq_id, g.model, sum(r.n * g.lp) AS score FROM r JOIN g ON g.residue = r.residue GROUP BY ALL)"""


def model_scores(spark, d: str) -> DataFrame:
    """seq_id, model, score: log likelihood of every document under every language's letters.

    Every sequence meets every model through its letter counts: a join with a table of languages x letters rows."""
    docs = spread(table(spark, d, "documents").select("doc_id", "lang", "text")).select(F.col("doc_id").alias("seq_id"), "lang", S.letters_of("text").alias("seq"))
    r = docs.select("seq_id", "lang", F.explode(S.chars("seq")).alias("residue")).groupBy("seq_id", "lang", "residue").agg(F.count("*").alias("n"))
    m = r.groupBy(F.col("lang").alias("model"), "residue").agg((F.sum("n") + 1.0).alias("n"))
    total = m.groupBy("model").agg(F.sum("n").alias("total"))
    grid = total.join(F.broadcast(m.select("residue").distinct())).join(F.broadcast(m), ["model", "residue"], "left")
    lp = grid.select("model", "residue", F.log(F.coalesce("n", F.lit(1.0)) / F.col("total")).alias("lp"))
    return r.join(F.broadcast(lp), "residue").groupBy("seq_id", "model").agg(F.sum(F.col("n") * F.col("lp")).alias("score"))


@query("model_scores", f"WITH {_MODELS} SELECT seq_id, model, round(score, 3) AS score FROM ms")
def model_scores_query(spark, d):
    return model_scores(spark, d).select("seq_id", "model", F.round("score", 3).alias("score"))


@query("competitive_weights", f"""WITH {_MODELS}, lp AS (SELECT *, (score - (ln(sum(exp(score - top)) OVER w) + top)) / (2 / log10(5)) AS lp FROM (SELECT *, max(score) OVER (PARTITION BY seq_id) AS top FROM ms) WINDOW w AS (PARTITION BY seq_id)), e AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY seq_id)) AS e FROM lp)
SELECT seq_id, model, round(1 + 4 * e / sum(e) OVER (PARTITION BY seq_id), 5) AS weight FROM e""")
def competitive_weights(spark, d):
    """How much each model learns from each sequence, in outer iteration 3."""
    return I.competitive_weights(model_scores(spark, d), "seq_id", "score", 4, I.temperature(3)).select("seq_id", "model", F.round("weight", 5).alias("weight"))


@query("best_model_argmin", f"WITH {_MODELS}, t AS (SELECT model, sum(-score) AS cost FROM ms GROUP BY model) SELECT arg_min(model, cost) AS model, round(min(cost), 1) AS cost FROM t")
def best_model_argmin(spark, d):
    t = model_scores(spark, d).groupBy("model").agg(F.sum(-F.col("score")).alias("cost"))
    return t.agg(F.min_by("model", "cost").alias("model"), F.round(F.min("cost"), 1).alias("cost"))


@query("model_summary", f"WITH {_MODELS} SELECT model, round(avg(score), 3) AS mean, round(stddev_samp(score), 3) AS sd, CAST(count(*) AS BIGINT) AS n FROM ms GROUP BY model")
def model_summary(spark, d):
    return model_scores(spark, d).groupBy("model").agg(F.round(F.avg("score"), 3).alias("mean"), F.round(F.stddev_samp("score"), 3).alias("sd"), F.count("*").alias("n"))


@query("model_bic", f"WITH {_MODELS}, b AS (SELECT model, sum(score) AS ml FROM ms GROUP BY model), p AS (SELECT model, count(*) - 1 AS params FROM g GROUP BY model), n AS (SELECT sum(n) AS residues FROM r) SELECT b.model, CAST(params AS BIGINT) AS params, round(-2 * ml + params * ln(CAST(residues AS DOUBLE)), 1) AS bic FROM b JOIN p ON p.model = b.model, n")
def model_bic(spark, d):
    """-2 log likelihood + parameters x ln(residues) of each model; the smallest is best."""
    docs = table(spark, d, "documents").select("lang", S.letters_of("text").alias("seq"))
    letters = docs.select(F.explode(F.array_distinct(S.chars("seq"))).alias("c")).agg((F.count_distinct("c") - 1).alias("params"))
    residues = docs.agg(F.sum(F.length("seq")).cast("double").alias("residues"))
    ml = model_scores(spark, d).groupBy("model").agg(F.sum("score").alias("ml"))
    return ml.join(F.broadcast(letters)).join(F.broadcast(residues)).select("model", "params", F.round(-2 * F.col("ml") + F.col("params") * F.log("residues"), 1).alias("bic"))


@query("tile_normalise", f"WITH {EV}, p AS (SELECT event_id, user_id, value_, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM (SELECT ev.*, symbol / 10.0 AS value_ FROM ev)) SELECT event_id, round(CASE WHEN s > 1 THEN value_ / s ELSE value_ END, 6) AS x FROM (SELECT *, sum(value_) OVER (PARTITION BY user_id, pos // 8) AS s FROM p)")
def tile_normalise(spark, d):
    """Values of each tile of eight positions scaled down to sum to 1 at most."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = labelled_events(spark, d).select("event_id", "user_id", (F.col("symbol") / 10.0).alias("x"), (F.row_number().over(w) - 1).alias("pos"))
    s = F.sum("x").over(Window.partitionBy("user_id", F.expr("pos div 8")))
    return p.select("event_id", F.round(F.when(s > 1, F.col("x") / s).otherwise(F.col("x")), 6).alias("x"))
