"""Queries on counts: k-mers, residues, transitions, emissions, distributions along sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlab.functions import sequences as S
from strandlab.operators import counting as C
from strandlab.operators.spectrum import word_spectrum
from strandlab.plans.registry import query
from strandlab.plans.sequences import DNA_SQL, SEQS, dna, seqs
from strandlab.session import spread, table

#: events as labelled sequences: state 2 .. 6 by event type, symbol 0 .. 9 by value.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
_CASE = " ".join(f"WHEN '{e}' THEN {i + 2}" for i, e in enumerate(EVENT_TYPES))
EV = f"ev AS (SELECT user_id, event_id, ts, CAST(CASE event_type {_CASE} END AS INTEGER) AS state, CAST(least(floor(value / 10), 9) AS INTEGER) AS symbol FROM events)"


def km_sql(k: int, name: str = "km") -> str:
    return f"{name} AS (SELECT seq_id, substring(seq, i, {k}) AS kmer, i FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM seqs))"


def labelled_events(spark, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    state = F.when(F.lit(False), 0)
    for i, e in enumerate(EVENT_TYPES):
        state = state.when(F.col("event_type") == e, i + 2)
    return rows.select("user_id", "event_id", "ts", state.alias("state"), F.least(F.floor(F.col("value") / 10), F.lit(9)).cast("int").alias("symbol"))


for _k in (1, 2, 3, 4):

    @query(f"kmer_counts_k{_k}", f"WITH {SEQS}, {km_sql(_k)} SELECT kmer, CAST(count(*) AS BIGINT) AS n FROM km GROUP BY kmer")
    def kmer_counts(spark, d, k=_k):
        return C.kmer_counts(seqs(spark, d), k)


@query("kmer_counts_all", f"WITH {SEQS}, " + ", ".join(km_sql(k, f"k{k}") for k in (1, 2, 3)) + " SELECT CAST(length(kmer) AS INTEGER) AS k, kmer, CAST(count(*) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT kmer FROM k{k}" for k in (1, 2, 3)) + ") GROUP BY kmer")
def kmer_counts_all(spark, d):
    return C.all_kmer_counts(seqs(spark, d), 3)


_BENCH = "seqs AS (SELECT item_id AS seq_id, lower(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM benchmark)"
_ALL = "w AS (SELECT CAST(k AS INTEGER) AS k, substring(seq, i, k) AS kmer, count(*) AS n FROM (SELECT k, seq, unnest(range(1, length(seq) - k + 2)) AS i FROM seqs, range(1, 13) r(k)) GROUP BY ALL)"

#: The same from stretches of 500 places, for a substring of a long text is slow.
_CUT = "ch AS (SELECT substring(seq, c * 500 + 1, 511) AS s FROM (SELECT seq, unnest(range(0, length(seq) // 500 + 1)) AS c FROM seqs)), p AS (SELECT s, unnest(range(1, least(500, length(s)) + 1)) AS i FROM ch), w AS (SELECT k, substring(s, i, k) AS kmer, count(*) AS n FROM p, range(1, 13) r(k) WHERE i + k - 1 <= length(s) GROUP BY ALL)"


@query("kmer_counts_12", f"WITH {_BENCH}, {_ALL} SELECT k, kmer, CAST(n AS BIGINT) AS n FROM w")
def kmer_counts_12(spark, d):
    """All words of 1 to 12 letters of the benchmark's passages, counted as packed integers in one pass."""
    rows = table(spark, d, "benchmark").select(S.letters_of("text").alias("seq"))
    word = F.translate(F.lpad(F.conv(F.col("code").cast("string"), 10, 32), F.col("k"), "0"), C.DIGITS[:26].upper(), S.LETTERS)
    return C.packed_counts(rows, 12).select("k", word.alias("kmer"), "n")


@query("kmer_spectrum", f"WITH {SEQS}, {_CUT} SELECT CAST(k AS INTEGER) AS k, CAST(count(*) AS BIGINT) AS words, CAST(sum(n) AS BIGINT) AS total, CAST(max(n) AS BIGINT) AS most, CAST(count(*) FILTER (n = 1) AS BIGINT) AS once, CAST(sum(n * n) AS BIGINT) AS squares FROM w GROUP BY k")
def kmer_spectrum(spark, d):
    """Of the documents' words of each length 1 to 12: how many there are, their places, and how often they repeat."""
    return word_spectrum(seqs(spark, d), 12)


@query("kmer_totals", f"WITH {SEQS}, t AS (SELECT CAST(k AS INTEGER) AS k, CAST(sum(greatest(length(seq) - k + 1, 0)) AS BIGINT) AS total FROM seqs, range(1, 13) AS r(k) GROUP BY k) SELECT k, total, 2.0 / total AS least FROM t")
def kmer_totals(spark, d):
    return C.kmer_totals(seqs(spark, d), 12)


@query("kmer_total_check", f"WITH {SEQS}, {km_sql(2)}, a AS (SELECT CAST(count(*) AS BIGINT) AS counted FROM km), b AS (SELECT CAST(sum(greatest(length(seq) - 1, 0)) AS BIGINT) AS expected FROM seqs) SELECT counted, expected, counted = expected AS equal FROM a, b")
def kmer_total_check(spark, d):
    rows = seqs(spark, d)
    a = C.kmer_counts(rows, 2).agg(F.sum("n").alias("counted"))
    b = C.kmer_totals(rows, 2).where("k = 2").select(F.col("total").alias("expected"))
    return a.join(b).withColumn("equal", F.col("counted") == F.col("expected"))  # one row each


@query("kmer_top", f"WITH {SEQS}, {km_sql(4)} SELECT kmer, CAST(count(*) AS BIGINT) AS n FROM km GROUP BY kmer ORDER BY n DESC, kmer LIMIT 250")
def kmer_top(spark, d):
    """The 250 most frequent 4-mers, ties by name."""
    return C.kmer_counts(seqs(spark, d), 4).orderBy(F.desc("n"), "kmer").limit(250)


@query("residue_counts", f"WITH {SEQS} SELECT residue, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(seq, '')) AS residue FROM seqs WHERE seq <> '') GROUP BY residue")
def residue_counts(spark, d):
    return C.residue_counts(seqs(spark, d))


@query("dust_score", f"WITH {SEQS}, {km_sql(3)}, n AS (SELECT seq_id, kmer, count(*) AS n FROM km GROUP BY ALL) SELECT n.seq_id, round(sum(n * (n - 1)) / 2.0 / (any_value(length(seq)) - 3), 6) AS dust FROM n JOIN seqs ON seqs.seq_id = n.seq_id WHERE length(seq) > 3 GROUP BY n.seq_id")
def dust_score(spark, d):
    return C.dust(seqs(spark, d)).select("seq_id", F.round("dust", 6).alias("dust"))


TRANSITIONS = f"""{EV}, w AS (SELECT state, lag(state) OVER o AS p, lead(state) OVER o AS q FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
tr AS (SELECT from_state, to_state, CAST(count(*) AS BIGINT) AS n FROM (SELECT coalesce(p, 0) AS from_state, state AS to_state FROM w UNION ALL SELECT state, 1 FROM w WHERE q IS NULL) GROUP BY ALL)"""


def event_transitions(spark, d: str) -> DataFrame:
    return C.transitions(labelled_events(spark, d), ["user_id"], ["ts", "event_id"])


@query("transition_counts", f"WITH {TRANSITIONS} SELECT * FROM tr")
def transition_counts(spark, d):
    return event_transitions(spark, d)


@query("transition_counts_weighted", f"WITH {EV}, w AS (SELECT state, lag(state) OVER o AS p, lead(state) OVER o AS q, 1 + user_id % 3 AS wt FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT from_state, to_state, CAST(sum(wt) AS BIGINT) AS n FROM (SELECT coalesce(p, 0) AS from_state, state AS to_state, wt FROM w UNION ALL SELECT state, 1, wt FROM w WHERE q IS NULL) GROUP BY ALL")
def transition_counts_weighted(spark, d):
    """Counts in which each sequence has a weight of its own."""
    return C.transitions(labelled_events(spark, d), ["user_id"], ["ts", "event_id"], weight=1 + F.col("user_id") % 3)


@query("transition_counts_roles", "WITH w AS (SELECT role, lag(role) OVER o AS p, lead(role) OVER o AS q FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)) SELECT from_role, to_role, CAST(count(*) AS BIGINT) AS n FROM (SELECT coalesce(p, 'START') AS from_role, role AS to_role FROM w UNION ALL SELECT role, 'END' FROM w WHERE q IS NULL) GROUP BY ALL")
def transition_counts_roles(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select(F.coalesce(F.lag("role").over(w), F.lit("START")).alias("from_role"), F.col("role").alias("to_role"), F.lead("role").over(w).isNull().alias("last"))
    each = rows.select("from_role", "to_role").unionByName(rows.where("last").select(F.col("to_role").alias("from_role"), F.lit("END").alias("to_role")))
    return each.groupBy("from_role", "to_role").agg(F.count("*").alias("n"))


@query("adjacent_pairs", f"WITH {EV} SELECT event_id, user_id, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, state FROM ev")
def adjacent_pairs(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return labelled_events(spark, d).select("event_id", "user_id", F.lag("state").over(w).alias("before"), "state")


@query("emission_counts", f"WITH {EV} SELECT state, symbol, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY ALL")
def emission_counts(spark, d):
    return C.emissions(labelled_events(spark, d))


EMISSION = f"""{EV}, bg AS (SELECT symbol, count(*) / sum(count(*)) OVER () AS p FROM ev GROUP BY symbol), st AS (SELECT state, count(*) AS total FROM ev GROUP BY state),
cn AS (SELECT state, symbol, count(*) AS n FROM ev GROUP BY ALL),
em AS (SELECT st.state, bg.symbol, coalesce(cn.n, 0) + 0.01 * bg.p AS n, bg.p AS bg, (coalesce(cn.n, 0) + 0.01 * bg.p) / (st.total + 0.01) AS p FROM st CROSS JOIN bg LEFT JOIN cn ON cn.state = st.state AND cn.symbol = bg.symbol)"""


def event_emissions(spark, d: str) -> DataFrame:
    """state, symbol, n (with 0.01 x background added), bg, p: a table of states x symbols."""
    ev = labelled_events(spark, d)
    n = C.emissions(ev)
    total = n.agg(F.sum("n").alias("every"))
    bg = n.groupBy("symbol").agg(F.sum("n").alias("k")).join(F.broadcast(total)).select("symbol", (F.col("k") / F.col("every")).alias("bg"))
    st = n.groupBy("state").agg(F.sum("n").alias("total"))
    # states x symbols: both sides are alphabets of fixed size
    grid = st.join(F.broadcast(bg)).join(F.broadcast(n), ["state", "symbol"], "left")
    mass = F.coalesce("n", F.lit(0)) + 0.01 * F.col("bg")
    return grid.select("state", "symbol", mass.alias("n"), "bg", (mass / (F.col("total") + 0.01)).alias("p"))


@query("pseudocount_emission", f"WITH {EMISSION} SELECT state, symbol, round(n, 6) AS n, round(bg, 6) AS bg, round(p, 6) AS p FROM em")
def pseudocount_emission(spark, d):
    return event_emissions(spark, d).select("state", "symbol", *(F.round(c, 6).alias(c) for c in ("n", "bg", "p")))


@query("transition_prob", f"WITH {TRANSITIONS} SELECT from_state, to_state, round(n / sum(n) OVER (PARTITION BY from_state), 6) AS p FROM tr")
def transition_prob(spark, d):
    total = F.sum("n").over(Window.partitionBy("from_state"))
    return event_transitions(spark, d).select("from_state", "to_state", F.round(F.col("n") / total, 6).alias("p"))


@query("transition_cumulative", f"WITH {TRANSITIONS}, p AS (SELECT *, n / sum(n) OVER (PARTITION BY from_state) AS p FROM tr) SELECT from_state, to_state, round(sum(p) OVER (PARTITION BY from_state ORDER BY to_state ROWS UNBOUNDED PRECEDING), 6) AS cum FROM p")
def transition_cumulative(spark, d):
    """Running sums of each row's probabilities, for sampling."""
    all_, run = Window.partitionBy("from_state"), Window.partitionBy("from_state").orderBy("to_state").rowsBetween(Window.unboundedPreceding, 0)
    p = event_transitions(spark, d).withColumn("p", F.col("n") / F.sum("n").over(all_))
    return p.select("from_state", "to_state", F.round(F.sum("p").over(run), 6).alias("cum"))


@query("transition_sorted", f"WITH {TRANSITIONS}, p AS (SELECT *, n / sum(n) OVER (PARTITION BY from_state) AS p FROM tr) SELECT from_state, to_state, round(p, 6) AS p, row_number() OVER (ORDER BY round(p, 9) DESC, to_state, from_state) AS place FROM p")
def transition_sorted(spark, d):
    """Transitions by falling probability, as slice sampling cuts them: at most states x states rows."""
    p = event_transitions(spark, d).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from_state")))
    w = Window.orderBy(F.desc(F.round("p", 9)), "to_state", "from_state")
    return p.select("from_state", "to_state", F.round("p", 6).alias("p"), F.row_number().over(w).cast("long").alias("place"))


@query("transition_sorted_by_target", f"WITH {TRANSITIONS} SELECT from_state, to_state, n, row_number() OVER (ORDER BY to_state, from_state) AS place FROM tr")
def transition_sorted_by_target(spark, d):
    """Transitions by their end, then their start: at most states x states rows."""
    return event_transitions(spark, d).withColumn("place", F.row_number().over(Window.orderBy("to_state", "from_state")).cast("long"))


@query("transition_cut", f"WITH {TRANSITIONS}, p AS (SELECT *, n / sum(n) OVER (PARTITION BY from_state) AS p FROM tr) SELECT CAST(to_state AS INTEGER) AS to_state, CAST(count(*) AS BIGINT) AS kept FROM p WHERE p > 0.2 GROUP BY to_state")
def transition_cut(spark, d):
    """Transitions above a slice of 0.2, by their end."""
    p = event_transitions(spark, d).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from_state")))
    return p.where("p > 0.2").groupBy("to_state").agg(F.count("*").alias("kept"))


@query("state_removal", f"WITH {TRANSITIONS} SELECT * FROM tr WHERE from_state <> 3 AND to_state <> 3")
def state_removal(spark, d):
    return event_transitions(spark, d).where("from_state <> 3 AND to_state <> 3")


@query("relabel_used_states", f"WITH {EV}, u AS (SELECT DISTINCT state FROM ev WHERE symbol < 3), r AS (SELECT state, 1 + dense_rank() OVER (ORDER BY state) AS label FROM u) SELECT event_id, CAST(label AS BIGINT) AS label FROM ev JOIN r ON r.state = ev.state WHERE symbol < 3")
def relabel_used_states(spark, d):
    """States that no position uses go; the others are numbered densely from 2."""
    ev = labelled_events(spark, d).where("symbol < 3")
    used = ev.select("state").distinct().select("state", (1 + F.dense_rank().over(Window.orderBy("state"))).cast("long").alias("label"))
    return ev.join(F.broadcast(used), "state").select("event_id", "label")


@query("positional_histogram", f"WITH {EV}, p AS (SELECT state, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS len FROM ev) SELECT state, CAST(floor(100.0 * pos / len + 0.5) AS BIGINT) AS place, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY ALL")
def positional_histogram(spark, d):
    """Where in the sequences each state stands, in hundredths of the length."""
    w = Window.partitionBy("user_id")
    p = labelled_events(spark, d).select("state", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).alias("pos"), F.count("*").over(w).alias("len"))
    return p.groupBy("state", F.floor(100.0 * F.col("pos") / F.col("len") + 0.5).alias("place")).agg(F.count("*").alias("n"))


@query("states_per_sequence", f"WITH {EV} SELECT user_id, " + ", ".join(f"CAST(count(*) FILTER (WHERE state = {s}) AS BIGINT) AS s{s}" for s in range(2, 7)) + " FROM ev GROUP BY user_id")
def states_per_sequence(spark, d):
    wide = labelled_events(spark, d).groupBy("user_id").pivot("state", list(range(2, 7))).count()
    return wide.select("user_id", *(F.coalesce(F.col(str(s)), F.lit(0)).alias(f"s{s}") for s in range(2, 7)))


@query("state_background_kmers", f"""WITH {SEQS}, {km_sql(3)}, l AS (SELECT doc_id, lang FROM documents), s AS (SELECT lang, kmer, CAST(count(*) AS BIGINT) AS n FROM km JOIN l ON l.doc_id = km.seq_id GROUP BY ALL),
b AS (SELECT kmer, CAST(count(*) AS BIGINT) AS n FROM km JOIN l ON l.doc_id = km.seq_id WHERE lang = 'en' GROUP BY kmer) SELECT s.lang, s.kmer, s.n, coalesce(b.n, 0) AS background FROM s LEFT JOIN b ON b.kmer = s.kmer""")
def state_background_kmers(spark, d):
    """Each language's 3-mers beside their count in the background language."""
    docs = spread(table(spark, d, "documents").select("lang", "text")).select("lang", F.explode(S.kmers(S.letters_of("text"), 3)).alias("kmer"))
    n = docs.groupBy("lang", "kmer").agg(F.count("*").alias("n"))
    b = n.where("lang = 'en'").select("kmer", F.col("n").alias("background"))
    return n.join(b, "kmer", "left").select("lang", "kmer", "n", F.coalesce("background", F.lit(0)).alias("background"))


@query("kmer_probe", f"WITH {SEQS}, {km_sql(2)}, n AS (SELECT kmer, CAST(count(*) AS BIGINT) AS n FROM km GROUP BY kmer), a AS (SELECT chr(CAST(97 + i AS INTEGER)) AS c FROM range(26) AS r(i)) SELECT a.c || b.c AS kmer, coalesce(n, 0) AS n FROM a CROSS JOIN a AS b LEFT JOIN n ON n.kmer = a.c || b.c")
def kmer_probe(spark, d):
    """The counts of all 676 possible 2-mers; absent ones are 0."""
    letter = F.explode(F.split(F.lit(S.LETTERS), ""))
    grid = spark.range(1).select(letter.alias("a")).select("a", letter.alias("b")).select(F.concat("a", "b").alias("kmer"))
    return grid.join(C.kmer_counts(seqs(spark, d), 2), "kmer", "left").select("kmer", F.coalesce("n", F.lit(0)).alias("n"))


@query("kmer_sampled", f"WITH {SEQS}, {km_sql(4)}, n AS (SELECT kmer, CAST(count(*) AS BIGINT) AS n FROM km GROUP BY kmer) SELECT kmer, n, round(ln(n) - ln(CAST(sum(n) OVER () AS DOUBLE)), 6) AS lp FROM n")
def kmer_sampled(spark, d):
    """Counts of 4-mers with the logarithm of their share."""
    n = C.kmer_counts(seqs(spark, d), 4)
    every = n.agg(F.sum("n").cast("double").alias("every"))
    return n.join(F.broadcast(every)).select("kmer", "n", F.round(F.log("n") - F.log("every"), 6).alias("lp"))


@query("dna_codon_counts", f"WITH {SEQS}, {DNA_SQL}, k AS (SELECT substring(seq, i, 3) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 1)) AS i FROM dna)) SELECT kmer, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY kmer")
def dna_codon_counts(spark, d):
    return C.kmer_counts(dna(spark, d), 3)
