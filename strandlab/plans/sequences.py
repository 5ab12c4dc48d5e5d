"""Queries on sequences: encoding, alphabets, gaps, complements, sets and orders of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.functions import sequences as S
from strandlab.operators.orders import ranked
from strandlab.plans.registry import query
from strandlab.session import spread, table

#: documents as sequences of lower-case ASCII letters, for the oracles.
SEQS = "seqs AS (SELECT doc_id AS seq_id, lower(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents)"
#: documents as DNA: letters mapped onto four bases.
BASES = "abcdefghijklmnopqrstuvwxyz"
TO_DNA = "ACGTACGTACGTACGTACGTACGTAC"
DNA_SQL = f"dna AS (SELECT seq_id, translate(seq, '{BASES}', '{TO_DNA}') AS seq FROM seqs)"


def seqs(spark, d: str) -> DataFrame:
    """seq_id, seq of every document."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("seq_id"), S.letters_of("text").alias("seq"))


def dna(spark, d: str) -> DataFrame:
    return seqs(spark, d).select("seq_id", F.translate("seq", BASES, TO_DNA).alias("seq"))


@query("seq_encode", f"WITH {SEQS} SELECT seq_id, list_transform(string_split(seq, ''), lambda c: CAST(instr('{S.LETTERS}', c) - 1 AS INTEGER)) AS codes, CAST(length(seq) AS INTEGER) AS len FROM seqs WHERE seq <> ''")
def seq_encode(spark, d):
    return seqs(spark, d).where("seq <> ''").select("seq_id", S.encode("seq", S.LETTERS).alias("codes"), F.length("seq").alias("len"))


@query("seq_decode", f"WITH {SEQS} SELECT seq_id, seq FROM seqs")
def seq_decode(spark, d):
    return seqs(spark, d).select("seq_id", S.encode("seq", S.LETTERS).alias("codes")).select("seq_id", S.decode("codes", S.LETTERS).alias("seq"))


@query("seq_alphabet_detect", f"""WITH {SEQS}, o AS (SELECT DISTINCT upper(c) AS c FROM (SELECT unnest(string_split(seq, '')) AS c FROM seqs WHERE seq <> '')),
n AS (SELECT CAST(count(*) FILTER (WHERE instr('{S.DNA}', c) = 0) AS BIGINT) AS not_dna, CAST(count(*) FILTER (WHERE instr('{S.PROTEIN}', c) = 0) AS BIGINT) AS not_protein FROM o)
SELECT *, CASE WHEN not_dna <= not_protein THEN 'dna' ELSE 'protein' END AS alphabet FROM n""")
def seq_alphabet_detect(spark, d):
    """Fewest observed letters outside the alphabet; DNA wins ties."""
    seen = seqs(spark, d).select(F.explode(F.array_distinct(S.chars(F.upper("seq")))).alias("c")).distinct()
    out = lambda a: F.count_if(F.position(F.col("c"), F.lit(a)) == 0)
    n = seen.agg(out(S.DNA).alias("not_dna"), out(S.PROTEIN).alias("not_protein"))
    return n.withColumn("alphabet", F.when(F.col("not_dna") <= F.col("not_protein"), "dna").otherwise("protein"))


GAPPED = "SELECT doc_id AS seq_id, regexp_replace(text, '[^A-Za-z.~_-]', '', 'g') AS seq FROM documents"


def _gapped(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.regexp_replace("text", "[^A-Za-z.~_-]", "").alias("seq"))


@query("seq_detect_aligned", f"SELECT bool_or(regexp_matches(seq, '[-._~]')) AS aligned, CAST(count(*) FILTER (WHERE regexp_matches(seq, '[-._~]')) AS BIGINT) AS n_gapped FROM ({GAPPED})")
def seq_detect_aligned(spark, d):
    return _gapped(spark, d).agg(F.bool_or(S.aligned("seq")).alias("aligned"), F.count_if(S.aligned("seq")).alias("n_gapped"))


@query("seq_unalign", f"SELECT seq_id, regexp_replace(seq, '[-._~]', '', 'g') AS seq FROM ({GAPPED})")
def seq_unalign(spark, d):
    return _gapped(spark, d).select("seq_id", S.unaligned("seq").alias("seq"))


@query("seq_revcomp", f"WITH {SEQS}, {DNA_SQL} SELECT seq_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM dna")
def seq_revcomp(spark, d):
    return dna(spark, d).select("seq_id", S.complement("seq").alias("seq"))


@query("seq_union_revcomp", f"WITH {SEQS}, {DNA_SQL} SELECT CAST(seq_id AS VARCHAR) AS name, seq FROM dna UNION ALL SELECT seq_id || '_rev', reverse(translate(seq, 'ACGT', 'TGCA')) FROM dna")
def seq_union_revcomp(spark, d):
    """Every sequence and its reverse complement."""
    rows = dna(spark, d)
    name = F.col("seq_id").cast("string")
    return rows.select(name.alias("name"), "seq").unionByName(rows.select(F.concat(name, F.lit("_rev")).alias("name"), S.complement("seq").alias("seq")))


@query("seq_concatenate", "WITH e AS (SELECT user_id, substr(event_type, 1, 1) AS c, ts, event_id FROM events) SELECT user_id, string_agg(c, '' ORDER BY ts, event_id) AS seq FROM e GROUP BY user_id")
def seq_concatenate(spark, d):
    """One sequence per user: its events' symbols in order of time (a user's events are a bounded list)."""
    each = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.substring("event_type", 1, 1).alias("c")))).alias("e"))
    return each.select("user_id", F.array_join(F.col("e.c"), "").alias("seq"))


@query("seq_spacer", f"WITH {SEQS} SELECT seq_id, repeat('#', 5) || seq || repeat('#', 5) AS seq FROM seqs")
def seq_spacer(spark, d):
    return seqs(spark, d).select("seq_id", S.spaced("seq", 5, "#").alias("seq"))


@query("seq_shuffle", "SELECT doc_id AS seq_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS place, source FROM documents")
def seq_shuffle(spark, d):
    """A reproducible random order of each source's sequences."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), "source", F.md5(F.col("doc_id").cast("string")).alias("draw"))
    return ranked(rows, ["draw", "seq_id"], ["source"]).select("seq_id", "place", "source")


@query("seq_resolve_ambiguity")
def seq_resolve_ambiguity(spark, d):
    """Upper-case letters read as DNA with ambiguity codes; every code replaced by one of its bases."""
    keep = F.regexp_replace(F.upper("seq"), "[^ACGTRYSWKMBDHVN]", "")
    rows = seqs(spark, d).select("seq_id", keep.alias("seq"))
    return rows.select("seq_id", S.resolved("seq", "ambiguity", F.col("seq_id")).alias("seq"))


@query("seq_record_cap", "SELECT doc_id AS seq_id FROM documents ORDER BY doc_id LIMIT 100000")
def seq_record_cap(spark, d):
    """The reader's cap: the first 100,000 records in file order (here by id)."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq_id")).orderBy("seq_id").limit(100_000)


@query("seq_distinct", f"WITH {SEQS} SELECT seq, CAST(min(seq_id) AS BIGINT) AS seq_id, CAST(count(*) AS BIGINT) AS copies FROM seqs GROUP BY seq")
def seq_distinct(spark, d):
    return seqs(spark, d).groupBy("seq").agg(F.min("seq_id").alias("seq_id"), F.count("*").alias("copies"))


@query("seq_sort_by_length", f"WITH {SEQS} SELECT seq_id, CAST(length(seq) AS BIGINT) AS len, row_number() OVER (ORDER BY length(seq), seq_id) AS place FROM seqs")
def seq_sort_by_length(spark, d):
    """All sequences in order of length."""
    return ranked(seqs(spark, d).select("seq_id", F.length("seq").cast("long").alias("len")), ["len", "seq_id"])


@query("interval_fetch", f"""WITH {SEQS}, iv AS (SELECT event_id, event_id % (SELECT count(*) FROM documents) AS seq_id, CAST(floor(value) AS BIGINT) AS s FROM events)
SELECT event_id, iv.seq_id, s, substring(seq, CAST(s + 1 AS INTEGER), 12) AS piece FROM iv JOIN seqs ON seqs.seq_id = iv.seq_id""")
def interval_fetch(spark, d):
    """Pieces of sequences by intervals [s, s + 12), from 0: an equi-join on the sequence, then a substring.  The
    intervals ask for all documents in turn."""
    many = table(spark, d, "documents").agg(F.count("*").alias("many"))  # one row
    iv = table(spark, d, "events").join(F.broadcast(many)).select("event_id", (F.col("event_id") % F.col("many")).alias("seq_id"), F.floor("value").cast("long").alias("s"))
    return iv.join(seqs(spark, d), "seq_id").select("event_id", "seq_id", "s", F.substring(F.col("seq"), (F.col("s") + 1).cast("int"), F.lit(12)).alias("piece"))


@query("peaks_top_n", """WITH u AS (SELECT user_id AS chrom, CAST(floor(value) AS BIGINT) AS s, value AS signal, event_id, row_number() OVER (PARTITION BY user_id, floor(value) ORDER BY value DESC, event_id) AS k FROM events)
SELECT chrom, s, signal FROM u WHERE k = 1 ORDER BY signal DESC, chrom, s LIMIT 500""")
def peaks_top_n(spark, d):
    """The best peak of each place, then the 500 best peaks."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("chrom"), F.floor("value").cast("long").alias("s"), F.col("value").alias("signal"))
    return rows.groupBy("chrom", "s").agg(F.max("signal").alias("signal")).orderBy(F.desc("signal"), "chrom", "s").limit(500)
