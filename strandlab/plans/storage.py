"""Queries that write and read files and tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandlab.functions import sequences as S
from strandlab.operators import counting as C
from strandlab.operators import familysearch as X
from strandlab.operators import markov as H
from strandlab.operators import suffixtree as T
from strandlab.plans import context as P
from strandlab.plans.counting import EV, labelled_events
from strandlab.plans.models import event_codes, hmm_eval_table
from strandlab.plans.motifs import MATRIX
from strandlab.plans.motifs import matrix as motif_matrix
from strandlab.plans.registry import query
from strandlab.plans.sequences import SEQS, seqs
from strandlab.session import folder, table
from strandlab.sources import files, models, packed


@query("fasta_roundtrip", f"WITH {SEQS} SELECT CAST(seq_id AS VARCHAR) AS name, seq FROM seqs")
def fasta_roundtrip(spark, d):
    """Documents' letters written as FASTA and read again."""
    path = folder(spark, "fasta")
    files.write_fasta(seqs(spark, d), path)
    return files.read_fasta(spark, path)


@query("labelled_fasta_roundtrip", f"WITH {EV} SELECT CAST(user_id AS VARCHAR) AS name, string_agg(chr(CAST(97 + symbol AS INTEGER)), '' ORDER BY ts, event_id) AS seq, list(CAST(state * 7 AS INTEGER) ORDER BY ts, event_id) AS labels FROM ev GROUP BY user_id")
def labelled_fasta_roundtrip(spark, d):
    """Events as residues with labels below them, written in blocks and read again."""
    e = labelled_events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "symbol", "state"))).alias("e"))
    rows = e.select(F.col("user_id").cast("string").alias("name"), F.array_join(F.transform("e.symbol", lambda x: F.chr(x + 97)), "").alias("seq"), F.transform("e.state", lambda x: (x * 7).cast("int")).alias("labels"))
    path = folder(spark, "labelled")
    files.write_labelled(rows, path)
    return files.read_labelled(spark, path)


@query("in_memory_source", "SELECT r_regionkey AS seq_id, replace(r_name, ' ', '') AS seq FROM region")
def in_memory_source(spark, d):
    """Sequences that the caller holds in memory, as rows."""
    held = [(r["r_regionkey"], r["r_name"].replace(" ", "")) for r in table(spark, d, "region").collect()]  # five regions
    return spark.createDataFrame(held, table(spark, d, "region").select(F.col("r_regionkey").alias("seq_id"), F.col("r_name").alias("seq")).schema)


@query("fastq_roundtrip", f"WITH {SEQS} SELECT CAST(seq_id AS VARCHAR) AS name, seq, CASE WHEN seq_id % 2 = 0 THEN '@' ELSE 'I' END || repeat('I', length(seq) - 1) AS qual FROM seqs WHERE seq <> ''")
def fastq_roundtrip(spark, d):
    """Documents' letters with qualities, some of which begin like a header, written as FASTQ and read again."""
    path = folder(spark, "fastq")
    first = F.when(F.col("seq_id") % 2 == 0, "@").otherwise("I")
    rows = seqs(spark, d).where("seq <> ''").withColumn("qual", F.concat(first, F.expr("repeat('I', length(seq) - 1)")))
    files.write_fastq(rows, path)
    return files.read_fastq(spark, path)


@query("at_header_roundtrip", f"WITH {SEQS} SELECT CAST(seq_id AS VARCHAR) AS name, seq FROM seqs")
def at_header_roundtrip(spark, d):
    """The older form of FASTA, whose records begin with an at sign."""
    path = folder(spark, "fasta")
    files.write_fasta(seqs(spark, d), path, header="@")
    return files.read_fasta(spark, path, header="@")


@query("pack_store", f"WITH {SEQS}, p AS (SELECT seq_id // 100 AS chunk, seq_id, CAST(length(seq) AS BIGINT) AS len FROM seqs) SELECT CAST(chunk AS BIGINT) AS chunk, seq_id, len, coalesce(CAST(sum(len) OVER (PARTITION BY chunk ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM p")
def pack_store(spark, d):
    return models.packed(seqs(spark, d), 100)


def packed_store(spark, d: str) -> packed.Store:
    """The documents' letters as a packed store in chunks of 64 kB."""
    path = folder(spark, "packed")
    packed.write_packed(seqs(spark, d), path)
    return packed.read_packed(spark, path)


@query("packed_chunks", f"WITH {SEQS}, t AS (SELECT string_agg(seq, '' ORDER BY seq_id) AS t FROM seqs) SELECT CAST(c AS BIGINT) AS chunk, CAST(length(x) AS INTEGER) AS size, sha256(x) AS digest FROM (SELECT c, substring(t, c * {packed.CHUNK} + 1, {packed.CHUNK}) AS x FROM t, range(0, CAST((length(t) + {packed.CHUNK} - 1) // {packed.CHUNK} AS BIGINT)) r(c))")
def packed_chunks(spark, d):
    """The chunks of the store, with their bytes' digests."""
    return packed_store(spark, d).chunks.select("chunk", "size", F.sha2("data", 256).alias("digest"))


@query("packed_slices", f"WITH {SEQS}, r AS (SELECT seq_id, seq, CAST(k * 977 % greatest(length(seq), 1) AS BIGINT) AS start, CAST(50 + k * 400 AS BIGINT) AS len FROM seqs, range(0, 3) q(k)) SELECT seq_id, start, len, substring(seq, start + 1, len) AS seq FROM (SELECT DISTINCT * FROM r)")
def packed_slices(spark, d):
    """Three parts of every sequence, read by range from the store; long ones span chunks."""
    store = packed_store(spark, d)
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    wanted = store.offsets.select("seq_id", F.col("len").alias("whole"), k).select("seq_id", (F.col("k") * 977 % F.greatest("whole", F.lit(1))).cast("long").alias("start"), (50 + F.col("k") * 400).cast("long").alias("len"))
    return packed.slices(store, wanted).select("seq_id", "start", "len", F.col("data").cast("string").alias("seq"))


@query("packed_scan", f"WITH {SEQS} SELECT seq_id, seq FROM seqs")
def packed_scan(spark, d):
    """Every sequence put together from the chunks again."""
    return packed.scan(packed_store(spark, d)).select("seq_id", F.col("data").cast("string").alias("seq"))


@query("packed_summary", f"WITH {SEQS} SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(length(seq)) AS BIGINT) AS residues, CAST(max(length(seq)) AS BIGINT) AS longest, CAST((sum(length(seq)) + {packed.CHUNK} - 1) // {packed.CHUNK} AS BIGINT) AS chunks FROM seqs")
def packed_summary(spark, d):
    """Counts of the store from its offsets alone."""
    return packed.summary(packed_store(spark, d))


@query("store_summary", f"WITH {SEQS} SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(length(seq)) AS BIGINT) AS residues, CAST(max(length(seq)) AS INTEGER) AS longest FROM seqs")
def store_summary(spark, d):
    return seqs(spark, d).agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("residues"), F.max(F.length("seq")).alias("longest"))


@query("training_set_roundtrip", f"WITH {EV} SELECT user_id AS seq_id, list(CAST(state - 2 AS INTEGER) ORDER BY ts, event_id) AS codes FROM ev GROUP BY user_id")
def training_set_roundtrip(spark, d):
    path = folder(spark, "training")
    models.save_training(event_codes(spark, d), path)
    return spark.read.parquet(f"{path}/sequences")


_GROUPS = f"""{EV}, w AS (SELECT user_id % 3 AS grp, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, state AS t FROM ev), n AS (SELECT grp, f, t, count(*) AS n FROM w WHERE f IS NOT NULL GROUP BY ALL),
st(s) AS (VALUES (2), (3), (4), (5), (6)), gr(grp) AS (VALUES (0), (1), (2)), full_ AS (SELECT gr.grp, a.s AS f, b.s AS t, coalesce(n, 0) + 0.001 AS n FROM gr CROSS JOIN st a CROSS JOIN st b LEFT JOIN n ON n.grp = gr.grp AND n.f = a.s AND n.t = b.s)"""


@query("model_store_roundtrip", f"""WITH {_GROUPS} SELECT CAST(grp AS INTEGER) AS grp, 'main' AS kind, CAST(f - 2 AS INTEGER) AS from_state, CAST(t - 2 AS INTEGER) AS to_state, round(n / sum(n) OVER (PARTITION BY grp, f), 6) AS t FROM full_
UNION ALL SELECT CAST(grp AS INTEGER), 'bias', from_state, to_state, round(t, 6) FROM gr CROSS JOIN (VALUES (0, 0, 400.0::DOUBLE / 401), (0, 1, 1.0::DOUBLE / 401), (1, 0, 1.0::DOUBLE / 6), (1, 1, 5.0::DOUBLE / 6)) v(from_state, to_state, t)""")
def model_store_roundtrip(spark, d):
    """The models of three groups of users and their bias models, stored by group and read back."""
    path = folder(spark, "groups")
    out = None
    for g in range(3):
        n = C.transitions(labelled_events(spark, d).where(F.col("user_id") % 3 == g), ["user_id"], ["ts", "event_id"])
        t = np.zeros((7, 7))
        for r in n.collect():  # states squared
            t[r["from_state"], r["to_state"]] = r["n"]
        every = t[2:, 2:].sum(axis=0)
        m = H.from_counts(t[2:, 2:], np.diag(every), every / max(every.sum(), 1), draws=0)
        for kind, one in (("main", m), ("bias", H.bias_of(m))):
            one.save(spark, f"{path}/group={g}/{kind}")
            back = H.Model.load(spark, f"{path}/group={g}/{kind}").tables(spark)["fhmm_transition"]
            rows = back.select(F.lit(g).alias("grp"), F.lit(kind).alias("kind"), "from_state", "to_state", F.round("t", 6).alias("t"))
            out = rows if out is None else out.unionByName(rows)
    return out


@query("bag_store_roundtrip", f"WITH {_GROUPS} SELECT CAST(f - 2 AS INTEGER) AS from_state, CAST(t - 2 AS INTEGER) AS to_state, round(n / sum(n) OVER (PARTITION BY f), 6) AS t FROM full_ WHERE grp = 1")
def bag_store_roundtrip(spark, d):
    """The same models as one bag; the one marked best read back."""
    path, bag = folder(spark, "bag"), {}
    for g in range(3):
        n = C.transitions(labelled_events(spark, d).where(F.col("user_id") % 3 == g), ["user_id"], ["ts", "event_id"])
        t = np.zeros((7, 7))
        for r in n.collect():  # states squared
            t[r["from_state"], r["to_state"]] = r["n"]
        bag[g] = H.from_counts(t[2:, 2:], np.eye(5), np.full(5, 0.2), draws=0)
    models.save_bag(spark, bag, 1, path)
    return models.load_model(spark, path).tables(spark)["fhmm_transition"].select("from_state", "to_state", F.round("t", 6).alias("t"))


@query("hit_csv_store", f"WITH {P._Z}, h AS (SELECT seq_id, z, exp(-0.9 * (z - 1.5)) AS p, exp(-0.8 * (z - 1.5)) AS q, (SELECT count(*) FROM documents) AS n FROM z WHERE z >= 3.0) SELECT CAST(seq_id AS VARCHAR) AS \"Name\", round(z, 3) AS score, round(z / 2, 3) AS score_bias, round(p, 6) AS p_score, round(q, 6) AS p_score_bias, round(p * n, 3) AS e, round(q * n, 3) AS e_bias FROM h")
def hit_csv_store(spark, d):
    """Hits of the context-model search written as CSV of seven columns, the name cut at its first blank, and read again."""
    path = folder(spark, "hits")
    many = table(spark, d, "documents").agg(F.count("*").alias("n"))
    hits = P.z_scored(spark, d).where("z >= 3.0").join(F.broadcast(many))
    p, q = (F.exp(-rate * (F.col("z") - 1.5)) for rate in (0.9, 0.8))
    rows = hits.select(F.concat(F.col("seq_id").cast("string"), F.lit(" a document")).alias("name"), F.round("z", 3).alias("score"), F.round(F.col("z") / 2, 3).alias("score_bias"), F.round(p, 6).alias("p_score"), F.round(q, 6).alias("p_score_bias"), F.round(p * F.col("n"), 3).alias("e"), F.round(q * F.col("n"), 3).alias("e_bias"))
    files.write_hits(rows, path)
    return spark.read.csv(path, header=True, schema="Name string, score double, score_bias double, p_score double, p_score_bias double, e double, e_bias double")


@query("calibration_csv")
def calibration_csv(spark, d):
    """The table of scores, P- and E-values of simulated sequences, by rank, written as CSV and read again."""
    path = folder(spark, "calibration")
    kinds = (("score", "Score"), ("p", "Pvalue"), ("e", "Evalue"))
    rows = hmm_eval_table(spark, d).select(*(F.col(f"{a}_{n}").alias(f"{b}_L{n}") for n in (100, 400, 1600) for a, b in kinds))
    files.write_table(rows, path)
    return spark.read.csv(path, header=True, schema=rows.schema)


@query("motif_store_roundtrip", f"WITH {MATRIX} SELECT motif, place, residue, CAST(n AS BIGINT) AS n FROM mx")
def motif_store_roundtrip(spark, d):
    """Motifs' count matrices stored and read back."""
    path = folder(spark, "motifs")
    motif_matrix(spark, d).write.parquet(path)
    return spark.read.parquet(path)


@query("context_store_roundtrip", f"WITH {P.NODES} SELECT context, residue, round(p, 6) AS p, round(lod, 5) AS lod FROM nodes WHERE length(context) <= 1")
def context_store_roundtrip(spark, d):
    """A context model and its fits stored; the nodes as they are read back."""
    path = folder(spark, "pst")
    rows = seqs(spark, d)
    tree = P.tree(rows, 1)
    models.save_context(T.node_table(spark, tree), P.P.fit_line(T.score(rows, tree).withColumn("band", P.P.band()), ["band"]), path)
    return models.load_context(spark, path)[0].select("context", "residue", F.round("p", 6).alias("p"), F.round("lod", 5).alias("lod"))


@query("model_search")
def model_search(spark, d):
    """The whole search: a context model and a hidden Markov model of the training documents, the database filtered at
    full depth (z >= 3.0) and scored, and the hits with their P- and E-values written as CSV and read back."""
    train, database = P.parts(spark, d)
    path = folder(spark, "hits")
    files.write_hits(X.hits(X.trained(train), database), path)
    kinds = "Name string, score double, score_bias double, p_score double, p_score_bias double, e double, e_bias double"
    return spark.read.schema(kinds).csv(path, header=True)


@query("matrix_transpose", f"WITH {EV} SELECT 's' || symbol AS \"column\", " + ", ".join(f'CAST(count(*) FILTER (WHERE state = {s}) AS BIGINT) AS "{s}"' for s in range(2, 7)) + " FROM ev GROUP BY symbol")
def matrix_transpose(spark, d):
    """The states x symbols count matrix, turned round."""
    wide = labelled_events(spark, d).groupBy("state").pivot("symbol", list(range(10))).count()
    wide = wide.select("state", *(F.coalesce(F.col(str(i)), F.lit(0)).alias(f"s{i}") for i in range(10)))
    return files.transposed(wide, "state", list(range(2, 7)))


@query("matrix_rows", f"WITH {EV}, m AS (SELECT state, symbol, count(*) AS n FROM ev GROUP BY ALL) SELECT CAST(state AS BIGINT) AS row, 's' || symbol AS \"column\", CAST(n AS BIGINT) AS value FROM m UNION ALL SELECT 99, 's' || x, 0 FROM range(10) AS r(x)")
def matrix_rows(spark, d):
    """The count matrix in long form, with a row of zeros added."""
    m = labelled_events(spark, d).groupBy(F.col("state").cast("long").alias("row"), F.concat(F.lit("s"), F.col("symbol").cast("string")).alias("column")).agg(F.count("*").alias("value"))
    return m.unionByName(spark.range(10).select(F.lit(99).cast("long").alias("row"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("column"), F.lit(0).cast("long").alias("value")))


@query("fasta_lines", f"WITH {SEQS} SELECT '>' || seq_id || chr(10) || seq AS line FROM seqs")
def fasta_lines(spark, d):
    return seqs(spark, d).select(files.fasta_line("seq_id", "seq").alias("line"))


@query("kmer_rows", "WITH b AS (SELECT item_id AS seq_id, lower(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM benchmark) SELECT seq_id, CAST(i - 1 AS INTEGER) AS pos, substring(seq, i, 3) AS kmer FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - 1)) AS i FROM b)")
def kmer_rows(spark, d):
    """All 3-mers of the benchmark's passages with their places, as rows."""
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("seq_id"), S.letters_of("text").alias("seq"))
    return rows.select("seq_id", F.posexplode(S.kmers("seq", 3)).alias("pos", "kmer"))
