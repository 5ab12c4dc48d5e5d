"""Queries on context models: growth, scores, calibration, hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.functions import sequences as S
from strandlab.functions.mathematics import exponential_survival
from strandlab.operators import context as P
from strandlab.operators import counting as C
from strandlab.operators import suffixtree as T
from strandlab.plans.counting import km_sql
from strandlab.plans.registry import query
from strandlab.plans.sequences import SEQS, seqs
from strandlab.session import spread, table, written

_COUNTS = f"{SEQS}, " + ", ".join(km_sql(k, f"w{k}") for k in (1, 2, 3)) + ", kc AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k} AS k, kmer, count(*) AS n FROM w{k} GROUP BY kmer" for k in (1, 2, 3)) + "), tot AS (SELECT k, sum(n) AS total FROM kc GROUP BY k), bg AS (SELECT kmer AS residue, n / (SELECT total FROM tot WHERE k = 1) AS bg FROM kc WHERE k = 1), pr AS (SELECT kc.k, kmer, n, (n + 1) / (total + 26) AS p, 1.0 / (total + 26) AS p0 FROM kc JOIN tot ON tot.k = kc.k)"


def _level(k: int) -> str:
    """Level k of the tree from level k - 1."""
    up = f"n{k - 1}"
    return f"""f{k} AS (SELECT w.kmer AS child, u.residue, coalesce(x.n, 0) AS n, coalesce(x.p, z.p0) * ln(coalesce(x.p, z.p0) / (u.p * w.p)) AS err
FROM pr w JOIN {up} u ON u.context = substring(w.kmer, 2, {k}) LEFT JOIN pr x ON x.k = {k + 1} AND x.kmer = w.kmer || u.residue, (SELECT max(p0) AS p0 FROM pr WHERE k = {k + 1}) z WHERE w.k = {k} AND w.p > 1e-5),
g{k} AS (SELECT child, sum(n) AS total FROM f{k} GROUP BY child HAVING sum(n) > 0 AND sum(err) > 1e-5),
n{k} AS (SELECT f.child AS context, f.residue, 0.99 * f.n / g.total + 0.01 * bg.bg AS p FROM f{k} f JOIN g{k} g ON g.child = f.child JOIN bg ON bg.residue = f.residue)"""


NODES = f"{_COUNTS}, n0 AS (SELECT '' AS context, residue, bg AS p FROM bg), {_level(1)}, {_level(2)}, nodes AS MATERIALIZED (SELECT context, n.residue, p, ln(p / bg) AS lod FROM (SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2) n JOIN bg ON bg.residue = n.residue)"


def scores_sql(depth: int) -> str:
    pad = "^" * depth  # so that the first letters have shorter contexts
    joins = " ".join(f"LEFT JOIN nodes c{k} ON c{k}.context = substring(word, {depth - k + 1}, {k}) AND c{k}.residue = substring(word, {depth + 1}, 1)" for k in range(depth, -1, -1))
    return f"""{NODES}, sw AS (SELECT seq_id, substring(s, i, {depth + 1}) AS word, count(*) AS n FROM (SELECT seq_id, '{pad}' || seq AS s, unnest(range(1, length(seq) + 1)) AS i FROM seqs) GROUP BY ALL),
ws AS (SELECT word, coalesce({', '.join(f'c{k}.lod' for k in range(depth, -1, -1))}) AS lod FROM (SELECT DISTINCT word FROM sw) {joins}),
sc AS MATERIALIZED (SELECT seqs.seq_id, CAST(length(seq) AS INTEGER) AS len, coalesce(score, 0.0) AS score FROM seqs LEFT JOIN (SELECT seq_id, sum(n * lod) AS score FROM sw JOIN ws ON ws.word = sw.word GROUP BY seq_id) t ON t.seq_id = seqs.seq_id)"""


def tree(rows: DataFrame, depth: int = 2) -> T.Tree:
    return T.grow(rows, depth=depth)


def scored(spark, d: str, depth: int = 2) -> DataFrame:
    rows = seqs(spark, d)
    return T.score(rows, tree(rows, depth))


@query("pst_nodes", f"WITH {NODES} SELECT context, residue, round(p, 6) AS p, round(lod, 5) AS lod FROM nodes")
def pst_nodes(spark, d):
    return T.node_table(spark, tree(seqs(spark, d))).select("context", "residue", F.round("p", 6).alias("p"), F.round("lod", 5).alias("lod"))


@query("pst_background", f"WITH {_COUNTS} SELECT residue, round(bg, 8) AS bg FROM bg")
def pst_background(spark, d):
    return P.background(C.all_kmer_counts(seqs(spark, d), 1)).select("residue", F.round("bg", 8).alias("bg"))


for _depth in (0, 1, 2):

    @query(f"pst_score_order{_depth}", f"WITH {scores_sql(_depth)} SELECT seq_id, len, round(score, 4) + 0.0 AS score FROM sc")
    def pst_score(spark, d, depth=_depth):
        return scored(spark, d, depth).select("seq_id", "len", (F.round("score", 4) + 0.0).alias("score"))


_FIT = "SELECT band, CASE WHEN regr_sxx(score, len) > 0 THEN regr_intercept(score, len) ELSE 0.0 END AS a, CASE WHEN regr_sxx(score, len) > 0 THEN regr_slope(score, len) ELSE 0.0 END AS b, sqrt(greatest(coalesce(regr_syy(score, len), 0) - CASE WHEN regr_sxx(score, len) > 0 THEN regr_slope(score, len) * regr_sxy(score, len) ELSE 0.0 END, 0.0) / greatest(count(*) - 1, 1)) AS v, CAST(count(*) AS BIGINT) AS n FROM {} GROUP BY band"


def calibration_sql(rounds: int, threshold: float) -> str:
    parts = [f"{scores_sql(2)}, sb AS (SELECT *, CAST(least(floor(len / 512), 15) AS INTEGER) AS band FROM sc), fit0 AS ({_FIT.format('sb')})"]
    for r in range(rounds):
        parts.append(f"k{r} AS (SELECT sb.* FROM sb JOIN fit{r} f ON f.band = sb.band WHERE CASE WHEN f.v > 0 THEN abs((score - (a + b * len)) / v) < {threshold} ELSE true END)")
        parts.append(f"fit{r + 1} AS ({_FIT.format(f'k{r}')})")
    return ", ".join(parts)


ROUNDS, OUTLIER = 2, 3.5
_CAL = calibration_sql(ROUNDS, OUTLIER)
_Z = f"{_CAL}, z AS (SELECT seq_id, len, score, sb.band, CASE WHEN v > 0 THEN (score - (a + b * len)) / v ELSE 0.0 END AS z FROM sb JOIN fit{ROUNDS} f ON f.band = sb.band)"


def banded(spark, d: str) -> DataFrame:
    return written(scored(spark, d).withColumn("band", P.band()), "scores")  # fitted several times


def z_scored(spark, d: str) -> DataFrame:
    rows = banded(spark, d)
    return P.z_scores(rows, P.calibrate(rows, OUTLIER, ROUNDS))


@query("length_fit", f"WITH {_CAL} SELECT band, round(a, 3) AS a, round(b, 6) AS b, n FROM fit0")
def length_fit(spark, d):
    return P.fit_line(banded(spark, d), ["band"]).select("band", F.round("a", 3).alias("a"), F.round("b", 6).alias("b"), "n")


@query("residual_sd", f"WITH {_CAL} SELECT band, round(v, 4) AS v FROM fit0")
def residual_sd(spark, d):
    return P.fit_line(banded(spark, d), ["band"]).select("band", F.round("v", 4).alias("v"))


@query("pst_calibration", f"WITH {_CAL} SELECT band, round(a, 3) AS a, round(b, 6) AS b, round(v, 4) AS v, n FROM fit{ROUNDS}")
def pst_calibration(spark, d):
    """The line of each length band after dropping outliers and fitting again, twice."""
    return P.calibrate(banded(spark, d), OUTLIER, ROUNDS).select("band", F.round("a", 3).alias("a"), F.round("b", 6).alias("b"), F.round("v", 4).alias("v"), "n")


@query("pst_zscore", f"WITH {_Z} SELECT seq_id, len, round(z, 4) + 0.0 AS z FROM z")
def pst_zscore(spark, d):
    return z_scored(spark, d).select("seq_id", "len", (F.round("z", 4) + 0.0).alias("z"))


@query("pst_hits", f"WITH {_Z} SELECT seq_id, len, round(z, 4) AS z FROM z WHERE z >= 3.0")
def pst_hits(spark, d):
    return z_scored(spark, d).where("z >= 3.0").select("seq_id", "len", F.round("z", 4).alias("z"))


@query("pst_top20", f"WITH {_Z} SELECT seq_id, len, round(z, 4) AS z FROM z ORDER BY round(z, 4) DESC, seq_id LIMIT 20")
def pst_top20(spark, d):
    """The documents that stand out most from what their length lets expect."""
    return z_scored(spark, d).select("seq_id", "len", F.round("z", 4).alias("z")).orderBy(F.desc("z"), "seq_id").limit(20)


def deep_z_scored(spark, d: str) -> DataFrame:
    """seq_id, len, score, band, z at the reference's depth (contexts of up to 11 letters), bins and thresholds."""
    rows = written(seqs(spark, d), "letters")  # read once a level
    scores = written(T.binned(written(T.score(rows, T.grow(rows)), "scores")), "binned")
    return P.z_scores(scores, T.calibrate(scores))


@query("pst_deep_nodes")
def pst_deep_nodes(spark, d):
    """All contexts that the growth rule accepts, of up to 11 letters."""
    return T.node_table(spark, T.grow(written(seqs(spark, d), "letters")))


@query("pst_deep_zscore")
def pst_deep_zscore(spark, d):
    """Scores and z-scores of all documents under the full-depth model; lines refitted until no outlier is left."""
    return deep_z_scored(spark, d).select("seq_id", "len", "score", "z")


@query("pst_deep_hits")
def pst_deep_hits(spark, d):
    """The documents that pass the search's filter, z >= 3.0, under the full-depth model."""
    return deep_z_scored(spark, d).where("z >= 3.0").select("seq_id", "len", "z")


#: Training part of the searches: half of the Spanish documents; the database: all others.
_TRAIN = "coalesce(lang = 'es' AND doc_id % 2 = 0, false)"
_PARTS = SEQS.replace("FROM documents", f"FROM documents WHERE NOT {_TRAIN}") + ", t" + SEQS.replace("FROM documents", f"FROM documents WHERE {_TRAIN}")
_FOREIGN = _Z.replace(NODES, NODES.replace("FROM seqs)", "FROM tseqs)").replace(SEQS, _PARTS).replace("> 1e-5", "> (SELECT greatest(1e-5, max(2.0 / total)) FROM tot)"))


def parts(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Training sequences and database."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    own = F.coalesce((F.col("lang") == "es") & (F.col("doc_id") % 2 == 0), F.lit(False))
    rows = lambda which: spread(docs.where(which)).select(F.col("doc_id").alias("seq_id"), S.letters_of("text").alias("seq"))
    return rows(own), rows(~own)


@query("search_filter", f"WITH {_FOREIGN} SELECT seq_id, len, round(z, 4) AS z, round(exp(-0.9 * (z - 1.5)) * (SELECT count(*) FROM sc), 5) AS e FROM z WHERE z >= 3.0")
def search_filter(spark, d):
    """The database's documents that fit a context model of other documents better than their length lets expect, with
    E-values for the database's size; the lines are the database's own."""
    train, database = parts(spark, d)
    scores = written(T.score(database, T.grow(train, depth=2)).withColumn("band", P.band()), "scores")
    z = P.z_scores(scores, P.calibrate(scores, OUTLIER, ROUNDS)).where("z >= 3.0")
    size = scores.count()
    return z.select("seq_id", "len", F.round("z", 4).alias("z"), F.round(exponential_survival("z", 1.5, 0.9) * size, 5).alias("e"))


@query("search_scores", f"WITH {_FOREIGN} SELECT seq_id, len, round(score, 4) + 0.0 AS score, round(z, 4) + 0.0 AS z FROM z")
def search_scores(spark, d):
    """Scores and z-scores of the whole database under the context model of the training documents."""
    train, database = parts(spark, d)
    scores = written(T.score(database, T.grow(train, depth=2)).withColumn("band", P.band()), "scores")
    z = P.z_scores(scores, P.calibrate(scores, OUTLIER, ROUNDS))
    return z.select("seq_id", "len", (F.round("score", 4) + 0.0).alias("score"), (F.round("z", 4) + 0.0).alias("z"))


@query("length_range_join", f"WITH {SEQS}, fit(lo, hi, name) AS (VALUES (0, 499, 'short'), (500, 1999, 'medium'), (2000, 7999, 'long'), (8000, 8000, 'longest')) SELECT seq_id, CAST(length(seq) AS INTEGER) AS len, name FROM seqs JOIN fit ON least(length(seq), 8000) BETWEEN lo AND hi")
def length_range_join(spark, d):
    """The fit of each sequence by its length: a range join against a fixed small table."""
    fit = spark.createDataFrame([(0, 499, "short"), (500, 1999, "medium"), (2000, 7999, "long"), (8000, 8000, "longest")], "lo int, hi int, name string")
    rows = seqs(spark, d).select("seq_id", F.length("seq").alias("len"))
    return rows.join(F.broadcast(fit), F.least("len", F.lit(8000)).between(F.col("lo"), F.col("hi"))).select("seq_id", "len", "name")


@query("length_bins", f"""WITH RECURSIVE {SEQS}, h AS MATERIALIZED (SELECT length(seq) AS len, count(*) AS n, row_number() OVER (ORDER BY length(seq)) AS r FROM seqs GROUP BY 1),
s AS (SELECT r, 0 AS bin, len AS a, len AS b, n FROM h WHERE r = 1 UNION ALL SELECT h.r, CASE WHEN s.n > 50 AND s.b - s.a >= 2 THEN bin + 1 ELSE bin END, CASE WHEN s.n > 50 AND s.b - s.a >= 2 THEN h.len ELSE s.a END, h.len, CASE WHEN s.n > 50 AND s.b - s.a >= 2 THEN h.n ELSE s.n + h.n END FROM s JOIN h ON h.r = s.r + 1),
g AS (SELECT bin, min(a) AS a, max(b) AS b, max(n) AS n FROM s GROUP BY bin), l AS (SELECT CASE WHEN arg_max(n, bin) <= 50 AND max(bin) > 0 THEN max(bin) - 1 ELSE max(bin) END AS most FROM g)
SELECT CAST(least(bin, most) AS INTEGER) AS bin, min(a) AS len_min, max(b) AS len_max, CAST(sum(n) AS BIGINT) AS n FROM g, l GROUP BY 1""")
def length_bins(spark, d):
    """Greedy bins along the sorted lengths."""
    return P.greedy_bins(seqs(spark, d).select(F.length("seq").cast("long").alias("len")), min_items=50)


@query("db_scan", f"WITH {SEQS} SELECT seq_id, CAST(length(seq) AS INTEGER) AS len, (SELECT count(*) FROM seqs) AS db_size FROM seqs WHERE length(seq) >= 1000")
def db_scan(spark, d):
    """Records that pass a cheap filter, with the size of the database scanned."""
    rows = seqs(spark, d)
    size = table(spark, d, "documents").agg(F.count("*").alias("db_size"))  # one row
    return rows.select("seq_id", F.length("seq").alias("len")).where("len >= 1000").join(F.broadcast(size))


@query("evalue", f"WITH {_Z} SELECT seq_id, round(p, 8) AS p, round(p * (SELECT count(*) FROM sc), 5) AS e FROM (SELECT seq_id, CASE WHEN z < 1.5 THEN 1.0 ELSE exp(-0.9 * (z - 1.5)) END AS p FROM z)")
def evalue(spark, d):
    """Exponential-tail P-values of the z-scores, and E-values for the database's size."""
    rows = z_scored(spark, d).select("seq_id", exponential_survival("z", 1.5, 0.9).alias("p"))
    size = table(spark, d, "documents").agg(F.count("*").alias("db_size"))
    return rows.join(F.broadcast(size)).select("seq_id", F.round("p", 8).alias("p"), F.round(F.col("p") * F.col("db_size"), 5).alias("e"))
