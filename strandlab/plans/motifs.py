"""Queries on motifs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlab.functions import mathematics as A
from strandlab.functions import sequences as S
from strandlab.operators import counting as C
from strandlab.operators import motifs as M
from strandlab.operators import paths as W
from strandlab.operators import suffixes as X
from strandlab.operators import suffixtree as T
from strandlab.operators.orders import ranked
from strandlab.plans.counting import EV, km_sql, labelled_events
from strandlab.plans.registry import query
from strandlab.plans.sequences import SEQS, seqs
from strandlab.session import for_python, table, written

WIDTH = 8
TOP = f"{SEQS}, {km_sql(5)}, tp AS MATERIALIZED (SELECT kmer AS motif, count(*) AS n FROM km GROUP BY kmer ORDER BY n DESC, kmer LIMIT 12), ht AS MATERIALIZED (SELECT kmer AS motif, seq_id, CAST(i - 1 AS INTEGER) AS pos FROM km WHERE kmer IN (SELECT motif FROM tp))"
MATRIX = f"{TOP}, mx AS (SELECT motif, place, substring(seq, pos + 1 + place, 1) AS residue, count(*) AS n FROM (SELECT motif, seq_id, pos, CAST(unnest(range(0, {WIDTH})) AS INTEGER) AS place FROM ht) h JOIN seqs ON seqs.seq_id = h.seq_id WHERE pos + place < length(seq) GROUP BY ALL)"
FREQ = f"{MATRIX}, bg AS (SELECT residue, count(*) / sum(count(*)) OVER () AS bg FROM (SELECT unnest(string_split(seq, '')) AS residue FROM seqs WHERE seq <> '') GROUP BY residue), pl AS (SELECT motif, place, sum(n) AS total FROM mx GROUP BY ALL), fr AS MATERIALIZED (SELECT pl.motif, pl.place, bg.residue, coalesce(mx.n, 0) AS n, (coalesce(mx.n, 0) + 0.1 * bg) / (total + 0.1) AS p, bg, total FROM pl CROSS JOIN bg LEFT JOIN mx ON mx.motif = pl.motif AND mx.place = pl.place AND mx.residue = bg.residue)"
_BITS = "CASE WHEN {p} <= 0 THEN 0.0 ELSE {p} * log2({p} / {q}) END"


def top_motifs(spark, d: str) -> DataFrame:
    """The twelve most frequent 5-mers."""
    n = T.word_counts(seqs(spark, d), 5).select(T.spelled(F.lit(5), S.LETTERS).alias("motif"), "n")
    return n.orderBy(F.desc("n"), "motif").limit(12)


def motif_hits(spark, d: str, width: int = 0, top: DataFrame | None = None) -> DataFrame:
    return M.hits(seqs(spark, d), written(top_motifs(spark, d), "motifs") if top is None else top, width)  # twelve rows


def matrix(spark, d: str, top: DataFrame | None = None) -> DataFrame:
    return M.window_matrix(motif_hits(spark, d, WIDTH, top))


def residues(spark, rows: DataFrame) -> DataFrame:
    """residue, n of sequences of letters: at most 26 rows."""
    codes, n = T.short_words(rows, 1, S.LETTERS)[1]
    return spark.createDataFrame([(S.LETTERS[c], int(k)) for c, k in zip(codes, n, strict=True)], "residue string, n long")


def freq(spark, d: str, top: DataFrame | None = None) -> DataFrame:
    n = residues(spark, seqs(spark, d))
    bg = n.join(F.broadcast(n.agg(F.sum("n").alias("every")))).select("residue", (F.col("n") / F.col("every")).alias("bg"))
    return M.frequencies(matrix(spark, d, top), bg)


@query("common_substrings_kgram", f"WITH {SEQS}, {km_sql(6)} SELECT kmer, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT seq_id) AS BIGINT) AS n_seq FROM km GROUP BY kmer HAVING count(DISTINCT seq_id) >= 100")
def common_substrings_kgram(spark, d):
    n = T.word_counts(seqs(spark, d), 6, by_sequence=True).where("n_seq >= 100")
    return n.select(T.spelled(F.lit(6), S.LETTERS).alias("kmer"), "n", "n_seq")


@query("motif_discovery", f"WITH {EV}, s AS (SELECT user_id, state, lead(state, 1) OVER w AS s1, lead(state, 2) OVER w AS s2, lead(state, 3) OVER w AS s3 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT [state, s1, s2, s3] AS path, count(*) AS n, count(DISTINCT user_id) AS n_seq FROM s WHERE s3 IS NOT NULL GROUP BY ALL) SELECT path, CAST(n AS BIGINT) AS n, CAST(n_seq AS BIGINT) AS n_seq FROM g WHERE n >= sqrt((SELECT count(DISTINCT user_id) FROM ev)) AND n_seq * n_seq / n >= 8")
def motif_discovery(spark, d):
    """Label paths of four states that come often and in many sequences."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = labelled_events(spark, d)
    path = ev.select("user_id", F.array("state", *(F.lead("state", k).over(w) for k in (1, 2, 3))).alias("path"), F.lead("state", 3).over(w).alias("last")).where("last IS NOT NULL")
    g = path.groupBy("path", "user_id").agg(F.count("*").alias("n")).groupBy("path").agg(F.sum("n").alias("n"), F.count("*").alias("n_seq"))
    users = ev.agg(F.sqrt(F.count_distinct("user_id")).alias("least"))
    return g.join(F.broadcast(users)).where("n >= least AND n_seq * n_seq / n >= 8").select("path", "n", "n_seq")


@query("motif_hits", f"WITH {TOP} SELECT motif, seq_id, pos FROM ht")
def motif_hits_query(spark, d):
    return motif_hits(spark, d).select("motif", "seq_id", "pos")


@query("motif_hits_sorted", f"WITH {TOP} SELECT motif, seq_id, pos, row_number() OVER (PARTITION BY motif ORDER BY seq_id, pos) AS place FROM ht")
def motif_hits_sorted(spark, d):
    """Each motif's hits in order of sequence and place."""
    return ranked(motif_hits(spark, d).select("motif", "seq_id", "pos"), ["seq_id", "pos"], ["motif"])


@query("motif_discovery_whole", f"""WITH {EV}, s AS (SELECT user_id, state, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ev), w AS (SELECT user_id, list(state ORDER BY i) AS x FROM s GROUP BY user_id),
e AS (SELECT count(*) AS every, (SELECT count(*) FROM w) AS users FROM s), f AS (SELECT state, count(*) / (SELECT every FROM e) AS p FROM s GROUP BY state), g AS (SELECT k, x[i:i + k - 1] AS path, count(*) AS n, count(DISTINCT user_id) AS n_seq FROM (SELECT user_id, x, k, unnest(range(1, len(x) - k + 2)) AS i FROM w, range(8, 16) AS r(k)) GROUP BY ALL HAVING count(*) >= (SELECT sqrt(users) FROM e)),
l AS (SELECT path, any_value(k) AS k, any_value(n) AS n, any_value(n_seq) AS n_seq, sum(ln(f.p)) AS lp FROM (SELECT *, unnest(path) AS state FROM g) u JOIN f ON f.state = u.state GROUP BY path)
SELECT path, CAST(k AS INTEGER) AS length, CAST(n AS BIGINT) AS n, CAST(n_seq AS BIGINT) AS n_seq, round(n * (ln(n / (SELECT every FROM e)) - lp), 3) AS ll FROM l WHERE n_seq * n_seq / n >= 8 AND n * (ln(n / (SELECT every FROM e)) - lp) > 5""")
def motif_discovery_whole(spark, d):
    """Label paths of 8 to 15 states that come at least sqrt(sequences) times, in enough sequences for it, with a
    log-likelihood ratio above 5 against independent labels."""
    found = W.discovered(user_states(spark, d).withColumnRenamed("user_id", "seq_id"))
    return found.select("path", "length", "n", "n_seq", F.round("ll", 3).alias("ll"))


_PATHS = f"""{EV}, s AS (SELECT user_id, state, symbol, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ev), w AS MATERIALIZED (SELECT user_id, list(state ORDER BY i) AS x, list(symbol ORDER BY i) AS y FROM s GROUP BY user_id),
e AS (SELECT count(*) AS every, (SELECT count(*) FROM w) AS users FROM s), f AS (SELECT state, count(*) / (SELECT every FROM e) AS p FROM s GROUP BY state), o AS MATERIALIZED (SELECT k, x[i:i + k - 1] AS path, user_id, i, y[i:i + k - 1] AS z FROM (SELECT user_id, x, y, k, unnest(range(1, len(x) - k + 2)) AS i FROM w, range(3, 16) AS r(k))),
g AS (SELECT k, path, count(*) AS n, count(DISTINCT user_id) AS n_seq FROM o GROUP BY ALL HAVING count(*) >= (SELECT sqrt(users) FROM e)),
l AS (SELECT path, any_value(k) AS k, any_value(n) AS n, any_value(n_seq) AS n_seq, sum(ln(f.p)) AS lp FROM (SELECT *, unnest(path) AS state FROM g) u JOIN f ON f.state = u.state GROUP BY path),
found AS MATERIALIZED (SELECT path, CAST(k AS INTEGER) AS length, CAST(n AS BIGINT) AS n, CAST(n_seq AS BIGINT) AS n_seq, round(n * (ln(n / (SELECT every FROM e)) - lp), 3) AS ll FROM l WHERE n_seq * n_seq / n >= 8 AND n * (ln(n / (SELECT every FROM e)) - lp) > 5)"""


def event_paths(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """seq_id, x, y (a user's states and symbols), and the paths of 3 to 15 states discovered in them."""
    e = labelled_events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "state", "symbol"))).alias("e"))
    rows = written(e.select(F.col("user_id").alias("seq_id"), F.col("e.state").alias("x"), F.col("e.symbol").alias("y")), "users")
    return rows, written(W.discovered(rows, 3), "found")


@query("motif_paths", f"WITH {_PATHS} SELECT path, length, n, n_seq, ll FROM found")
def motif_paths(spark, d):
    """Label paths of 3 to 15 states under the same conditions."""
    return event_paths(spark, d)[1].select("path", "length", "n", "n_seq", F.round("ll", 3).alias("ll"))


@query("motif_path_hits", f"WITH {_PATHS} SELECT o.path, user_id, CAST(i - 1 AS INTEGER) AS pos FROM o JOIN found ON found.path = o.path")
def motif_path_hits(spark, d):
    """Every occurrence of every discovered path, whatever its length, in one pass."""
    rows, found = event_paths(spark, d)
    return W.path_hits(rows, found).select("path", F.col("seq_id").alias("user_id"), "pos")


@query("motif_path_matrix", f"WITH {_PATHS} SELECT path, CAST(place - 1 AS INTEGER) AS place, symbol, CAST(count(*) AS BIGINT) AS n FROM (SELECT o.path, unnest(range(1, k + 1)) AS place, unnest(z) AS symbol FROM o JOIN found ON found.path = o.path) GROUP BY ALL")
def motif_path_matrix(spark, d):
    """The symbols at each place of the discovered paths' occurrences."""
    rows, found = event_paths(spark, d)
    return W.path_matrix(rows, W.path_hits(rows, found), "y")


@query("motif_path_merge")
def motif_path_merge(spark, d):
    """The discovered paths' matrices merged while at most 100 of 10,000 random motifs align better, with each merged
    motif's hits: the union of its members', shifted to its first column."""
    rows, found = event_paths(spark, d)
    hits = written(W.path_hits(rows, found), "hits")
    _, shifts = W.merge_over_tasks(spark, W.matrices(W.path_matrix(rows, hits, "y"), 10))
    numbered = list(enumerate(sorted(shifts)))  # a name is as long as its members' names together, so hits carry its number
    members = spark.createDataFrame([([int(x) for x in m.split(".")], i, at) for i, k in numbered for m, at in sorted(shifts[k].items())], "path array<int>, id int, shift int")
    names = spark.createDataFrame(numbered, "id int, merged string")
    found = hits.join(F.broadcast(members), "path").select("id", F.col("seq_id").alias("user_id"), (F.col("pos") - F.col("shift")).alias("pos")).distinct()  # a row a motif
    return found.join(F.broadcast(names), "id").select("merged", "user_id", "pos")


def user_states(spark, d: str) -> DataFrame:
    """user_id, x: a user's labels in order of time."""
    e = labelled_events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "state"))).alias("e"))
    return e.select("user_id", F.col("e.state").alias("x"))


@query("motif_presence", f"WITH {TOP} SELECT motif, CAST(count(DISTINCT seq_id) AS BIGINT) AS n_seq, CAST(count(*) AS BIGINT) AS n FROM ht GROUP BY motif")
def motif_presence(spark, d):
    each = motif_hits(spark, d).groupBy("motif", "seq_id").agg(F.count("*").alias("n"))
    return each.groupBy("motif").agg(F.count("*").alias("n_seq"), F.sum("n").alias("n"))


@query("hit_overlap", f"WITH {TOP} SELECT motif, seq_id, pos, coalesce(pos - lag(pos) OVER (PARTITION BY motif, seq_id ORDER BY pos) < 5, false) AS overlaps FROM ht")
def hit_overlap(spark, d):
    return M.non_overlapping(motif_hits(spark, d), 5).select("motif", "seq_id", "pos", "overlaps")


@query("hit_overlap_self_join", "WITH e AS (SELECT event_id, user_id, CAST(epoch(ts) AS BIGINT) AS s FROM events) SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND b.s > a.s AND b.s < a.s + 600")
def hit_overlap_self_join(spark, d):
    """Events of a user less than ten minutes apart.

    The interval join runs on time bins of its own width, so that a user with many events is many keys."""
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_timestamp("ts").alias("s"))
    a = e.select("user_id", F.col("event_id").alias("a"), F.col("s").alias("sa"), F.explode(F.array(F.expr("s div 600"), F.expr("s div 600 + 1"))).alias("bin"))
    b = e.select("user_id", F.col("event_id").alias("b"), F.col("s").alias("sb"), F.expr("s div 600").alias("bin"))
    return a.join(b, ["user_id", "bin"]).where("sb > sa AND sb < sa + 600").select("a", "b")


@query("hit_sets", f"WITH {TOP}, a AS (SELECT seq_id, pos FROM ht WHERE motif = (SELECT min(motif) FROM tp)), b AS (SELECT seq_id, pos FROM ht WHERE motif = (SELECT max(motif) FROM tp)) SELECT CAST((SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS BIGINT) AS both, CAST((SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS BIGINT) AS only_a, CAST((SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS BIGINT) AS only_b")
def hit_sets(spark, d):
    """Places that two motifs share and that only one has."""
    found = written(motif_hits(spark, d).select("motif", "seq_id", "pos"), "hits")
    ends = found.agg(F.min("motif").alias("low"), F.max("motif").alias("high"))
    f = found.join(F.broadcast(ends))
    a, b = f.where("motif = low").select("seq_id", "pos"), f.where("motif = high").select("seq_id", "pos")
    n = lambda x, c: x.agg(F.count("*").alias(c))  # noqa: E731  one row each
    return n(a.intersect(b), "both").join(n(a.subtract(b), "only_a")).join(n(b.subtract(a), "only_b"))


@query("occurrence_union", f"WITH {TOP} SELECT seq_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT seq_id, count(*) AS n FROM ht WHERE motif = (SELECT min(motif) FROM tp) GROUP BY seq_id UNION ALL SELECT seq_id, count(*) FROM ht WHERE motif = (SELECT max(motif) FROM tp) GROUP BY seq_id) GROUP BY seq_id")
def occurrence_union(spark, d):
    """Occurrences of two motifs, added element by element."""
    found = motif_hits(spark, d)
    ends = top_motifs(spark, d).agg(F.min("motif").alias("low"), F.max("motif").alias("high"))
    return found.join(F.broadcast(ends)).where("motif = low OR motif = high").groupBy("seq_id").agg(F.count("*").alias("n"))


@query("hit_agreement")
def hit_agreement(spark, d):
    """How far the hits of each pair of motifs stand together."""
    found = written(motif_hits(spark, d).select("motif", "seq_id", "pos"), "hits")
    names = found.select("motif").distinct()  # twelve
    pairs = names.select(F.col("motif").alias("a")).join(names.select(F.col("motif").alias("b")), F.col("a") < F.col("b"))
    return M.agreement_table(found, pairs, 2)


@query("motif_count_matrix", f"WITH {MATRIX} SELECT motif, place, residue, CAST(n AS BIGINT) AS n FROM mx")
def motif_count_matrix(spark, d):
    return matrix(spark, d)


@query("motif_frequencies", f"WITH {FREQ} SELECT motif, place, residue, round(p, 6) AS p FROM fr")
def motif_frequencies(spark, d):
    return freq(spark, d).select("motif", "place", "residue", F.round("p", 6).alias("p"))


@query("information_content", f"WITH {FREQ}, c AS (SELECT motif, place, sum({_BITS.format(p='p', q='bg')}) AS b FROM fr GROUP BY ALL) SELECT motif, round(avg(b), 6) AS ic FROM c GROUP BY motif")
def information_content(spark, d):
    return M.information(freq(spark, d)).select("motif", F.round("ic", 6).alias("ic"))


@query("logo_heights", f"WITH {FREQ}, c AS (SELECT motif, place, {math.log2(26)!r} - (-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0.0 END) + 25 / (2.0 * {math.log(2)!r} * any_value(total))) AS stack FROM fr GROUP BY ALL) SELECT fr.motif, fr.place, residue, round(p * stack, 6) + 0.0 AS height, stack < 0.25 AS grey FROM fr JOIN c ON c.motif = fr.motif AND c.place = fr.place")
def logo_heights(spark, d):
    """Letter heights of the motifs' logos; weak columns are grey."""
    f = freq(spark, d)
    h = M.logo_heights(f, 26)
    stack = F.sum("height").over(Window.partitionBy("motif", "place"))
    return h.select("motif", "place", "residue", (F.round("height", 6) + 0.0).alias("height"), (stack < 0.25).alias("grey"))


@query("motif_distance", f"WITH {FREQ}, x AS (SELECT a.motif AS a, b.motif AS b, a.place - b.place AS off, sum({_BITS.format(p='a.p', q='b.p')}) AS kl, count(DISTINCT a.place) AS overlap FROM fr a JOIN fr b ON a.residue = b.residue AND a.motif < b.motif GROUP BY 1, 2, 3) SELECT a, b, round(min(kl / overlap), 5) AS distance FROM x WHERE overlap > {WIDTH // 2} GROUP BY a, b")
def motif_distance(spark, d):
    return M.distances(written(freq(spark, d), "freq"), WIDTH).select("a", "b", F.round("distance", 5).alias("distance"))


_COST = "2 * (1 / (1 + exp(-kl)) - 0.5)"


@query("motif_alignment", f"WITH {FREQ}, c AS (SELECT a.motif AS a, b.motif AS b, a.place AS pa, b.place AS pb, sum(greatest(a.p, 1e-9) * log2(greatest(a.p, 1e-9) / greatest(b.p, 1e-9)) + greatest(b.p, 1e-9) * log2(greatest(b.p, 1e-9) / greatest(a.p, 1e-9))) / 2 AS kl FROM fr a JOIN fr b ON a.residue = b.residue AND a.motif < b.motif GROUP BY ALL), o AS (SELECT a, b, pa - pb AS off, round(avg({_COST}), 9) AS cost, count(*) AS overlap FROM c GROUP BY ALL) SELECT a, b, round(min(cost), 6) AS cost FROM o WHERE overlap >= 6 GROUP BY a, b")
def motif_alignment(spark, d):
    """The cost of the best ungapped alignment of each pair of motifs."""
    return M.best_alignments(written(freq(spark, d), "freq"), WIDTH).select("a", "b", F.round("cost", 6).alias("cost"))


@query("alignment_motif")
def alignment_motif(spark, d):
    """The motif of each aligned family of the benchmark's passages: letters of its columns with background pseudocounts,
    and its log-likelihood ratio."""
    from strandlab.plans.models import multiple_alignment

    return M.motif_of_alignment(multiple_alignment(spark, d), S.DNA)


@query("motif_merged_hits")
def motif_merged_hits(spark, d):
    """The hits of merged motifs: the union of their members' hits, shifted by their places in the merged motif."""
    members = written(M.merged_members(matrix(spark, d), S.LETTERS), "members")  # as many rows as motifs
    rows = motif_hits(spark, d).join(F.broadcast(members), "motif")
    return rows.select("merged", "seq_id", (F.col("pos") - F.col("shift")).alias("pos")).distinct()


@query("motif_likelihood", f"WITH {FREQ}, t AS (SELECT count(*) AS every FROM km), l AS (SELECT motif, sum(n * ln(p / bg)) AS ll FROM fr WHERE n > 0 GROUP BY motif) SELECT l.motif, round(ll + tp.n * ln(CAST(tp.n AS DOUBLE) / every), 2) AS ll, row_number() OVER (ORDER BY round(ll + tp.n * ln(CAST(tp.n AS DOUBLE) / every), 2) DESC, l.motif) AS place FROM l JOIN tp ON tp.motif = l.motif, t")
def motif_likelihood(spark, d):
    """Motifs ranked by the log-likelihood ratio of their occurrences."""
    top = written(top_motifs(spark, d), "motifs")
    rows = freq(spark, d, top).where("n > 0").groupBy("motif").agg(F.sum(F.col("n") * F.log(F.col("p") / F.col("bg"))).alias("ll"))
    every = seqs(spark, d).agg(F.sum(F.greatest(F.length("seq") - 4, F.lit(0))).alias("every"))
    j = rows.join(top, "motif").join(F.broadcast(every))
    ll = F.round(F.col("ll") + F.col("n") * F.log(F.col("n") / F.col("every")), 2)
    return j.select("motif", ll.alias("ll")).select("motif", "ll", F.row_number().over(Window.orderBy(F.desc("ll"), "motif")).cast("long").alias("place"))


@query("motif_overlap_allowed", f"WITH {EV}, n AS (SELECT user_id, CAST(count(*) AS INTEGER) AS la, CAST(count(DISTINCT symbol) AS INTEGER) AS lb FROM ev GROUP BY user_id) SELECT user_id, CASE WHEN greatest(la, lb) >= 128 THEN least(la, lb) ELSE greatest(6, least(la, lb) - 2) END AS overlap FROM n")
def motif_overlap_allowed(spark, d):
    n = labelled_events(spark, d).groupBy("user_id").agg(F.count("*").cast("int").alias("la"), F.count_distinct("symbol").cast("int").alias("lb"))
    return n.select("user_id", A.allowed_overlap("la", "lb").alias("overlap"))


@query("motif_relative_entropy", f"WITH {FREQ}, c AS (SELECT residue, sum({_BITS.format(p='p', q='bg')}) AS b FROM fr WHERE place < 3 GROUP BY residue) SELECT residue, round(b, 6) + 0.0 AS b FROM c")
def motif_relative_entropy(spark, d):
    """Each letter's part in the motifs' first three columns' relative entropy."""
    f = freq(spark, d).where("place < 3").groupBy("residue").agg(F.sum(A.bits("p", "bg")).alias("b"))
    return f.select("residue", (F.round("b", 6) + 0.0).alias("b"))


@query("meme_lines", f"WITH {FREQ}, l AS (SELECT motif, place, string_agg(printf('%.4f', p), ' ' ORDER BY residue) AS line, any_value(total) AS total FROM fr GROUP BY ALL) SELECT motif, 'letter-probability matrix: alength= 26 w= ' || count(*) || ' nsites= ' || CAST(max(total) AS BIGINT) AS header, string_agg(line, chr(10) ORDER BY place) AS lines FROM l GROUP BY motif")
def meme_lines(spark, d):
    """Motifs as probability matrices in the MEME text format."""
    f = freq(spark, d)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("residue", "p"))), lambda x: F.format_string("%.4f", x["p"])), " ")
    rows = f.groupBy("motif", "place").agg(line.alias("line"), F.first("total").alias("total"))
    m = rows.groupBy("motif").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("l"), F.max("total").alias("total"))
    header = F.concat(F.lit("letter-probability matrix: alength= 26 w= "), F.size("l").cast("string"), F.lit(" nsites= "), F.col("total").cast("string"))
    return m.select("motif", header.alias("header"), F.array_join(F.col("l.line"), "\n").alias("lines"))


@query("suffix_interval", f"WITH {SEQS}, {km_sql(3)}, n AS (SELECT kmer, CAST(count(*) AS BIGINT) AS n FROM km GROUP BY kmer) SELECT kmer, coalesce(CAST(sum(n) OVER (ORDER BY kmer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS low, CAST(sum(n) OVER (ORDER BY kmer ROWS UNBOUNDED PRECEDING) AS BIGINT) AS high FROM n")
def suffix_interval(spark, d):
    """The interval of the sorted suffixes that begins with each 3-mer: running sums over at most 26 ** 3 rows."""
    n = C.kmer_counts(seqs(spark, d), 3)
    w = Window.orderBy("kmer")
    run = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return n.select("kmer", (run - F.col("n")).alias("low"), run.alias("high"))


@query("suffix_lcp", f"WITH {EV}, p AS (SELECT event_id, user_id, string_agg(CAST(state AS VARCHAR), '') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS suffix FROM ev), s AS (SELECT *, lag(suffix) OVER (PARTITION BY substring(suffix, 1, 1) ORDER BY suffix, event_id) AS before FROM p) SELECT event_id, suffix, CAST(CASE WHEN before IS NULL THEN 0 " + " ".join(f"WHEN length(before) >= {k} AND length(suffix) >= {k} AND substring(before, 1, {k}) = substring(suffix, 1, {k}) THEN {k}" for k in range(6, 0, -1)) + " ELSE 0 END AS INTEGER) AS lcp FROM s")
def suffix_lcp(spark, d):
    """Suffixes of the label sequences, up to six labels, with the common prefix with the suffix before in order; the
    sort is split by first label."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(0, 5)
    p = labelled_events(spark, d).select("event_id", F.array_join(F.transform(F.collect_list("state").over(w), lambda s: s.cast("string")), "").alias("suffix"))
    before = F.lag("suffix").over(Window.partitionBy(F.substring("suffix", 1, 1)).orderBy("suffix", "event_id"))
    lcp = F.lit(0)
    for k in range(1, 7):
        same = (F.length("before") >= k) & (F.length("suffix") >= k) & (F.substring("before", 1, k) == F.substring("suffix", 1, k))
        lcp = F.when(same, k).otherwise(lcp)
    return p.withColumn("before", before).select("event_id", "suffix", F.coalesce(lcp, F.lit(0)).alias("lcp"))


@query("suffix_lcp_whole")
def suffix_lcp_whole(spark, d):
    """All whole suffixes of the label sequences in order, with the common prefix with the suffix before."""
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    return M.suffix_order(labelled_events(spark, d).select("user_id", pos.alias("pos"), "event_id", "state"))


_HEX = "string_agg(printf('%04X', state), '' ORDER BY i)"
_SUFFIX = f"{EV}, st AS (SELECT user_id, state, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ev), tx AS MATERIALIZED (SELECT user_id, {_HEX} AS t, count(*) AS n FROM st GROUP BY user_id), sx AS MATERIALIZED (SELECT user_id, i, substring(t, 4 * i + 1) AS s FROM (SELECT user_id, t, unnest(range(0, n)) AS i FROM tx))"
_PATTERNS = "pt AS MATERIALIZED (SELECT DISTINCT substring(t, 1, 4 * (1 + user_id % 15)) AS p FROM tx)"


def event_suffixes(spark, d: str) -> DataFrame:
    """seq_id, pos, state of the users' events."""
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long") - 1
    return labelled_events(spark, d).select(F.col("user_id").alias("seq_id"), pos.alias("pos"), "state")


def probed(spark, d: str) -> tuple[X.Index, DataFrame]:
    """The stored index of the users' label sequences, and the intervals of each user's first 1 to 15 labels."""
    index = X.save_and_load(X.build(event_suffixes(spark, d)), spark)
    begin = user_states(spark, d).select(F.expr("slice(x, 1, CAST(1 + user_id % 15 AS INT))").alias("pattern"))
    return index, X.probe(index, begin)


@query("suffix_probe", f"WITH {_SUFFIX}, {_PATTERNS} SELECT p AS pattern, CAST(count(*) FILTER (substring(s, 1, length(p)) < p) AS BIGINT) AS low, CAST(count(*) FILTER (substring(s, 1, length(p)) <= p) AS BIGINT) AS high FROM pt, sx GROUP BY p")
def suffix_probe(spark, d):
    """Intervals of label patterns of 1 to 15 states in the stored order of all whole suffixes."""
    _, found = probed(spark, d)
    return found.select(X.keyed("pattern").alias("pattern"), "low", "high")


@query("suffix_probe_places", f"WITH {_SUFFIX}, {_PATTERNS} SELECT p AS pattern, user_id, CAST(i AS BIGINT) AS pos FROM pt JOIN sx ON substring(s, 1, length(p)) = p WHERE length(p) >= 12")
def suffix_probe_places(spark, d):
    """Where the patterns of three labels or more occur: the rows of their intervals."""
    index, found = probed(spark, d)
    places = X.occurrences(index, found.where(F.size("pattern") >= 3))
    return places.select(X.keyed("pattern").alias("pattern"), F.col("seq_id").alias("user_id"), "pos")


@query("common_windows", f"""WITH {_SUFFIX}, o AS (SELECT user_id, i, s, row_number() OVER (ORDER BY s, user_id, i) - 1 AS place FROM sx), k AS (SELECT place, user_id, w, substring(s, 1, 4 * w) AS x FROM o, range(2, 41) r(w) WHERE length(s) >= 4 * w),
f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY x, user_id ORDER BY place) = 1 THEN 1 ELSE 0 END AS fresh FROM k), g AS (SELECT place, w, x, sum(fresh) OVER (PARTITION BY x ORDER BY place ROWS UNBOUNDED PRECEDING) AS n FROM f),
b AS (SELECT place, arg_max(x, w) AS x, max(w) AS w FROM g WHERE n >= 12 GROUP BY place) SELECT x AS word, CAST(w AS BIGINT) AS length, CAST(count(*) AS BIGINT) AS n, CAST(min(place) AS BIGINT) AS place FROM b GROUP BY x, w""")
def common_windows(spark, d):
    """What the shortest windows of the sorted suffixes with twelve users have in common, from two labels on."""
    found = X.common_prefixes(event_suffixes(spark, d), 12, 2)
    return found.select(X.keyed("word").alias("word"), "length", "n", "place")


@query("common_rounds")
def common_rounds(spark, d):
    """Common substrings of the users' event sequences, the longest taken and blanked out first, until none is left."""
    return M.rounds_of_common(user_strings(spark, d), 2, 12)


def user_strings(spark, d: str) -> DataFrame:
    """seq_id, seq: a user's events as letters, in order of time (a user's events are a bounded list)."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.substring("event_type", 1, 1).alias("c")))).alias("e"))
    return e.select(F.col("user_id").alias("seq_id"), F.array_join(F.col("e.c"), "").alias("seq"))


@query("scoring_segments")
def scoring_segments(spark, d):
    """Dense segments of the users' values along time."""
    import numpy as np
    import pandas as pd

    for_python(spark)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(["ts", "event_id"])["value"].to_numpy()
        return pd.DataFrame([(pdf["user_id"].iloc[0], *s) for s in M.segments(np.asarray(x), 3, 1.5)], columns=["user_id", "start", "end", "low", "high"])

    return table(spark, d, "events").select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandas(lambda pdf: run(pdf), "user_id long, start int, end int, low double, high double")


@query("motif_refine")
def motif_refine(spark, d):
    """The most frequent motif's matrix after ten rounds of expectation maximisation over all windows of the documents."""
    import numpy as np

    rows = written(seqs(spark, d), "letters")
    motifs = written(top_motifs(spark, d), "motifs")
    top = motifs.orderBy(F.desc("n"), "motif").first()["motif"]
    start = np.zeros((WIDTH, 26))
    for r in matrix(spark, d, motifs).where(F.col("motif") == top).collect():  # width x letters rows
        start[r["place"], S.LETTERS.index(r["residue"])] = r["n"]
    n = np.full(26, 1e-9)
    for r in residues(spark, rows).collect():  # letters
        n[S.LETTERS.index(r["residue"])] = r["n"]
    p, _, _ = M.refine_over_tasks(rows, S.LETTERS, start, n / n.sum(), rounds=10)
    return spark.createDataFrame([(top, i, S.LETTERS[j], float(v)) for (i, j), v in np.ndenumerate(p)], "motif string, place int, residue string, p double")


@query("motif_merge")
def motif_merge(spark, d):
    """The whole list of motifs, merged where their alignment is significant (twelve motifs, so one group)."""
    counts = matrix(spark, d).withColumn("grp", F.lit("all"))
    return M.merge_table(counts, S.LETTERS, "grp", shuffles=M.SHUFFLES)
