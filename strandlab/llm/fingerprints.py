"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every word shingle is hashed once; the top bits of the hash name its bin and each bin keeps its smallest hash.  Empty
bins are filled by optimal densification: an empty bin takes the value of a filled bin that a hash of (empty bin, filled
bin) chooses, the same for every document.  The fingerprint packs the lowest four bits of each of the 128 bins, one hex
digit a bin.  Two fingerprints' likeness is the share of equal digits, corrected for digits that agree by chance.

Sorting a document's hashes puts each bin's smallest first in its run, so bins come from one sort and one filter over
the row's own array: nothing is exploded.

The next document is found on small rows alone: doc_id, a hash of the text, length and fingerprint, one row for each
different (doc_id, text), are dealt out by ranges of (doc_id, hash); within a range the next row is a lead(), and a
range's last row is followed by the first of the next range.  So neither an outlying doc_id nor many rows of one doc_id
get into one task.  Texts are shuffled once, by that pair; each then sends as much of its beginning as the document
before it needs.

Defined results: a null text is empty; texts of fewer than five words have one shingle, of all their words; rows with
the same doc_id follow each other by a hash of the text; among equal rows each is followed by an equal one but the last;
a null doc_id comes before all others; of one document, the next is itself; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlab.llm.common import parts_of, staged, table, text_of

SHINGLE = 5
BINS = 128
BIN_BITS = 7
DIGIT_BITS = 4
#: Between words, after lower-casing: ASCII other than letters and digits.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with column out: the fingerprint of column text.  Steps are columns of their own, so that each is computed
    once a row."""
    shift = 64 - BIN_BITS
    digits = (1 << DIGIT_BITS) - 1
    get = ", ".join(f"get(_h, i + {k})" for k in range(SHINGLE))
    return (
        df.withColumn("_w", F.array_remove(F.split(F.lower(F.col(text)), _BETWEEN), ""))
        .withColumn("_h", F.expr("transform(_w, w -> xxhash64(w))"))
        .withColumn("_s", F.expr(f"CASE WHEN size(_h) >= {SHINGLE} THEN sort_array(transform(sequence(0, size(_h) - {SHINGLE}), i -> xxhash64({get}))) ELSE array(xxhash64(array_join(_w, ' '), 'short')) END"))
        .drop("_w", "_h")
        .withColumn("_m", F.expr(f"filter(_s, (v, i) -> i = 0 OR shiftrightunsigned(v, {shift}) <> shiftrightunsigned(get(_s, i - 1), {shift}))"))
        .drop("_s")
        .withColumn("_b", F.expr(f"transform(_m, v -> cast(shiftrightunsigned(v, {shift}) AS int))"))
        .withColumn("_p", F.expr(f"transform(sequence(0, {BINS - 1}), b -> cast(array_position(_b, b) AS int))"))
        .withColumn("_p", F.expr(f"transform(_p, (p, b) -> CASE WHEN p > 0 THEN p ELSE cast(array_min(transform(_b, (c, i) -> (xxhash64(b, c) & -{BINS}L) | i)) & {BINS - 1} AS int) + 1 END)"))
        .withColumn(out, F.expr(f"array_join(transform(_p, p -> lower(hex(get(_m, p - 1) & {digits}))), '')"))
        .drop("_m", "_b", "_p")
    )


def likeness(a: str, b: str):
    """Estimated Jaccard index of the shingle sets behind two fingerprints, 0 to 1."""
    same = F.expr(f"cast(size(filter(sequence(1, {BINS}), i -> substring({a}, i, 1) = substring({b}, i, 1))) AS double)")
    chance = 1.0 / (1 << DIGIT_BITS)
    return F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))


def _neighbours(rows: DataFrame) -> DataFrame:
    """rows (gone, d, h: unique and in this order; n_chars, fingerprint) with what is known of the next row, and key and
    n_chars of the one before; the first follows the last."""
    order = ["gone", "d", "h"]
    ranged = staged(rows.repartitionByRange(parts_of(rows.sparkSession), F.desc("gone"), "d", "h").withColumn("part", F.spark_partition_id()), "ranges")
    along = Window.partitionBy("part").orderBy(F.desc("gone"), "d", "h")
    me = F.struct(*order, "n_chars", "fingerprint")
    inner = ranged.withColumns({"me": me, "_after": F.lead(me).over(along), "_before": F.lag(me).over(along)})
    # one row a range, in order, the last followed by the first
    key = F.struct((~F.col("gone")).alias("g"), "d", "h")
    ends = ranged.groupBy("part").agg(F.min_by(me, key).alias("first"), F.max_by(me, key).alias("last"))
    every, whole = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("first").over(every), F.first("first").over(whole)).alias("_first"), F.coalesce(F.lag("last").over(every), F.last("last").over(whole)).alias("_last"))
    out = inner.join(ends, "part").withColumns({"after": F.coalesce("_after", "_first"), "before": F.coalesce("_before", "_last")})
    return out.select(*order, "n_chars", "n_rows", "fingerprint", F.col("after.fingerprint").alias("next_fingerprint"), *(F.col(f"before.{c}").alias(f"before_{c}") for c in (*order, "n_chars")))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text has its last quarter of code points replaced by the first as many of the next document.
    """
    key = ["gone", "d", "h"]
    docs = docs.select(F.col("doc_id").isNull().alias("gone"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), text_of().alias("text"))
    docs = docs.select("gone", "d", F.xxhash64("text").alias("h"), "text")
    light = with_fingerprint(docs.withColumn("n_chars", F.length("text").cast("long")), "text", "fingerprint").drop("text")
    light = light.groupBy(*key).agg(F.first("n_chars").alias("n_chars"), F.first("fingerprint").alias("fingerprint"), F.count("*").alias("n_rows"))
    known = staged(_neighbours(light), "neighbours")
    texts = docs.dropDuplicates(key).join(known.hint("merge"), key)
    quarter = F.expr("cast(n_chars div 4 AS int)")
    heads = texts.select(*(F.col(f"before_{c}").alias(c) for c in key), F.expr("left(text, cast(before_n_chars div 4 AS int))").alias("head"))
    joined = texts.drop(*(f"before_{c}" for c in (*key, "n_chars"))).join(heads.hint("merge"), key)
    edit = lambda tail: F.concat(F.expr("left(text, cast(n_chars - n_chars div 4 AS int))"), tail)
    # the last of equal rows meets the next document, those before it meet their equal
    again = F.struct(edit(F.left("text", quarter)).alias("edited"), F.col("fingerprint").alias("next_fingerprint"), (F.col("n_rows") - 1).alias("times"))
    last = F.struct(edit(F.col("head")).alias("edited"), "next_fingerprint", F.lit(1).cast("long").alias("times"))
    cases = joined.select(*key, "n_chars", "fingerprint", F.explode(F.when(F.col("n_rows") > 1, F.array(last, again)).otherwise(F.array(last))).alias("c")).select(*key, "n_chars", "fingerprint", "c.*")
    done = with_fingerprint(cases, "edited", "edited_fingerprint").withColumn("edited_sha256", F.sha2(F.col("edited"), 256)).drop("edited")
    done = done.withColumns({"near_edited": likeness("fingerprint", "edited_fingerprint"), "near_next": likeness("fingerprint", "next_fingerprint")})
    one = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    done = done.withColumn("doc_id", F.when(~F.col("gone"), F.col("d")))
    return done.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select(*one)


def fingerprints(spark, sf_dir: str) -> DataFrame:
    """op8: fingerprints of all documents and of their edited texts."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))
