"""Line dedup by pairwise alignment.

Lines are hashed (128 bits, after trimming blanks).  Documents overlap if they share a rare line hash: that of a line, or
of a shortest run of lines, that reaches MIN_WORDS words (a window, taken from each line onward and back).  Shorter lines
by themselves are common, and can't be deleted without a window around them.  Each pair of line sequences is aligned by
patience diff; aligned runs of lines (blocks) with at least MIN_WORDS words are deleted from the later document.  Since a
line is only ever deleted where an earlier document has it, its first copy always survives.

The result is that of aligning every document with every earlier one that shares a window with it, and so of aligning
all pairs, for a block long enough to be deleted consists of windows that both documents have.  It is reached without
all pairs:
* Documents with the same lines are aligned once: the first one stands for all, and the others, if they have MIN_WORDS
  words, go as a whole, for they are one block of it.
* First, each document is aligned with the first holder of each of its windows: a linear number of pairs.
* Then only windows that are still there are left (a passage that moved, or that the first holder has fewer times).
  They go to further holders, by intervals of a hash of the holder, in rounds that each try GROWTH times as many as the
  one before, until no window that is still there has an earlier holder that wasn't tried.  The work of these rounds is
  the number of such documents times their earlier holders.

Only hashes and word counts are shuffled for the search and the alignment; whole texts are shuffled once, to delete.
Holders are counted before the shuffle; an earlier document that many later ones meet is dealt out in SHARE meetings
a copy, so that no task gets all of them.  Joins are sort-merge joins by hint: every side grows with the input, and the
plan is the same at any size.

Documents are ordered by doc_id, then by a hash of the text.  Repeated rows are one document and get the same result;
null texts stay null and empty ones empty; rows without a doc_id are returned unchanged; other columns come along.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlab.llm.common import bounded_batches, discard, staged, table, text_of

MIN_WORDS = 20
#: Further holders of a window that the second round tries, and growth from round to round.
GROWTH = 8
#: Later documents that meet one copy of an earlier one, about.
SHARE = 2000


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of (i, j), sorted by i, whose j increase (patience sorting)."""
    from bisect import bisect_left

    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back[k] = piles[p - 1] if p else -1
        if p == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[p], piles[p] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience_matches(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs (i, j) of aligned equal items, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b), False)]
    while todo:
        a0, a1, b0, b1, stuck = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1 or stuck:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {x: i for i, x in enumerate(b[b0:b1], b0) if nb[x] == 1 and na.get(x) == 1}
        anchors = increasing([(i, at[x]) for i, x in enumerate(a[a0:a1], a0) if x in at])
        if not anchors:  # no line is unique here: take the n-th copies of a line as its own line
            seen: Counter = Counter()
            nth = {}
            for j in range(b0, b1):
                nth[(b[j], seen[b[j]])] = j
                seen[b[j]] += 1
            seen.clear()
            found = []
            for i in range(a0, a1):
                j = nth.get((a[i], seen[a[i]]))
                seen[a[i]] += 1
                if j is not None:
                    found.append((i, j))
            anchors = increasing(found)
            stuck = True
        i0, j0 = a0, b0
        for i, j in anchors:
            todo.append((i0, i, j0, j, stuck))
            out.append((i, j))
            i0, j0 = i + 1, j + 1
        if anchors:
            todo.append((i0, a1, j0, b1, stuck))
    return sorted(out)


def common_blocks(a: list, b: list) -> list[tuple[int, int]]:
    """(start, end) in b of maximal runs that are aligned with a run of a."""
    blocks: list[list[int]] = []
    last = (-2, -2)
    for i, j in patience_matches(a, b):
        if blocks and (i, j) == (last[0] + 1, last[1] + 1):
            blocks[-1][1] = j + 1
        else:
            blocks.append([j, j + 1])
        last = (i, j)
    return [(s, e) for s, e in blocks]


def spans(words: np.ndarray, min_words: int) -> set[tuple[int, int]]:
    """(start, end) of the shortest runs of lines that reach min_words, from each line onward and back; every line of a
    longer run is in one that lies within the run."""
    n, total, at = len(words), np.concatenate([[0], np.cumsum(words)]), np.arange(len(words))
    ends = np.searchsorted(total, total[:-1] + min_words)
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    onward = {(i, e) for i, e in zip(at.tolist(), ends.tolist(), strict=True) if e <= n}
    return onward | {(s, i + 1) for i, s in zip(at.tolist(), starts.tolist(), strict=True) if s >= 0}


LINES = "d long, t long, s1 long, s2 long, total long, k1 array<long>, k2 array<long>, words array<int>, w1 array<long>, w2 array<long>, begin array<int>, end array<int>"


def line_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """d, t (hash of the text), s1, s2 (hash of all lines), total (words), k1, k2 (arrays: the lines' hashes), words
    (array), w1, w2, begin, end (arrays: the windows' hashes and places)."""
    bounded_batches(docs.sparkSession)
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    kinds = [pa.int64()] * 3 + [longs, longs, ints, longs, longs, ints, ints]
    names = [x.split()[0] for x in LINES.split(", ")]

    def row(text: str) -> tuple:
        lines = [x.strip() for x in text.encode("utf-8", "surrogatepass").split(b"\n")]
        digests = b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in lines)
        key = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
        whole = np.frombuffer(hashlib.blake2b(digests, digest_size=16).digest(), dtype=np.int64).tolist()
        words = np.array([len(x.split()) for x in lines], dtype=np.int32)
        places = sorted(spans(words, min_words))
        window = np.frombuffer(b"".join(hashlib.blake2b(digests[16 * i : 16 * e], digest_size=16).digest() for i, e in places), dtype=np.int64).reshape(-1, 2)
        place = np.array(places, dtype=np.int32).reshape(-1, 2)
        return (*whole, int(words.sum()), key[:, 0], key[:, 1], words, window[:, 0], window[:, 1], place[:, 0], place[:, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = list(zip(*(row(t.as_py()) for t in b.column(2)), strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names)

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64(text_of()), text_of())
    return rows.mapInArrow(run, LINES)


def overlapping(lines: DataFrame) -> DataFrame:
    """k1, k2, n (occurrences), od, ot, d, t: every later holder of a window, with the first holder."""
    each = lines.select("d", "t", F.explode(F.arrays_zip(F.col("w1").alias("k1"), F.col("w2").alias("k2"))).alias("k")).select("k.k1", "k.k2", "d", "t")
    who = F.struct("d", "t")
    shared = each.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(who).alias("first"), F.max(who).alias("last")).where(F.col("first") < F.col("last")).drop("last")
    seen = each.join(shared.hint("merge"), ["k1", "k2"]).where((F.col("first.d") < F.col("d")) | ((F.col("first.d") == F.col("d")) & (F.col("first.t") < F.col("t"))))
    return seen.select("k1", "k2", "n", F.col("first.d").alias("od"), F.col("first.t").alias("ot"), "d", "t").distinct()


def align(lines: DataFrame, pairs: DataFrame, min_words: int) -> DataFrame:
    """(d, t, lines): lines to delete; a document may come several times."""
    ints = pa.list_(pa.int32())
    schema = pa.schema([("d", pa.int64()), ("t", pa.int64()), ("lines", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, t, gone = [], [], []
            for row_d, row_t, o1, o2, k1, k2, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                old, new = list(zip(o1, o2, strict=True)), list(zip(k1, k2, strict=True))
                have = set(old)
                if sum(w for x, w in zip(new, words, strict=True) if x in have) < min_words:
                    continue
                cut = [j for s, e in common_blocks(old, new) if sum(words[s:e]) >= min_words for j in range(s, e)]
                if cut:
                    d.append(row_d)
                    t.append(row_t)
                    gone.append(cut)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(gone, ints)], schema=schema)

    copies = pairs.groupBy("od", "ot").agg(F.count("*").alias("n")).select("od", "ot", F.ceil(F.col("n") / SHARE).cast("int").alias("shares"))
    old = lines.select(F.col("d").alias("od"), F.col("t").alias("ot"), F.col("k1").alias("o1"), F.col("k2").alias("o2")).join(copies.hint("merge"), ["od", "ot"])
    old = old.select("od", "ot", "o1", "o2", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    dealt = pairs.join(copies.hint("merge"), ["od", "ot"]).withColumn("share", F.pmod(F.xxhash64("d", "t"), F.col("shares")).cast("int")).drop("shares")
    new = dealt.join(lines.select("d", "t", "k1", "k2", "words").hint("merge"), ["d", "t"])
    rows = new.join(old.hint("merge"), ["od", "ot", "share"]).select("d", "t", "o1", "o2", "k1", "k2", "words")
    return rows.mapInArrow(run, "d long, t long, lines array<int>")


def _together(gone: DataFrame) -> DataFrame:
    return gone.groupBy("d", "t").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("removed"))


def still_there(lines: DataFrame, removed: DataFrame) -> DataFrame:
    """(k1, k2, d, t): windows of which a line is still there."""
    schema = pa.schema([(c, pa.int64()) for c in ("k1", "k2", "d", "t")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for d, t, n, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k1, k2, begin, end, gone = (np.array(x or [], dtype=np.int64) for x in rest)
                stays = np.ones(n + 1, dtype=np.int64)
                stays[0], stays[gone + 1] = 0, 0
                stays = stays.cumsum()
                left = stays[end] > stays[begin]
                found = set(zip(k1[left].tolist(), k2[left].tolist(), strict=True))
                for column, v in zip(out, ([x for x, _ in found], [x for _, x in found], [d] * len(found), [t] * len(found)), strict=True):
                    column.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    rows = lines.select("d", "t", F.size("words").alias("n"), "w1", "w2", "begin", "end").join(removed.hint("merge"), ["d", "t"], "left")
    return rows.select("d", "t", "n", "w1", "w2", "begin", "end", "removed").mapInArrow(run, "k1 long, k2 long, d long, t long")


def further_holders(held: DataFrame, more: DataFrame, low: int, high: int) -> DataFrame:
    """The windows of more (k1, k2, d, t) with the earlier ones among those holders of held (k1, k2, n, d, t) whose place,
    by a hash, times the window's occurrences n is in the interval: about high - low of each window, cut before the join."""
    key = ["k1", "k2"]
    place = F.shiftrightunsigned(F.xxhash64("d", "t"), 1) / float(1 << 63)  # 0 to 1
    holder = held.where((place * F.col("n") >= low) & (place * F.col("n") < high))
    holder = holder.join(more.select(*key).distinct().hint("merge"), key, "left_semi").select(*key, F.col("d").alias("od"), F.col("t").alias("ot"))
    return more.join(holder.hint("merge"), key).where("od < d or (od = d and ot < t)")


def aligned(lines: DataFrame, min_words: int) -> DataFrame:
    """(d, t, removed): the deleted lines of documents with different lines, after all rounds."""
    seen = staged(overlapping(lines), "seen")
    who, key = ["d", "t"], ["k1", "k2"]
    # only documents that share a window take part from here on
    involved = seen.select(*who).unionByName(seen.select(F.col("od").alias("d"), F.col("ot").alias("t"))).distinct()
    lines = staged(lines.join(involved.hint("merge"), who, "left_semi"), "involved")
    removed = staged(_together(align(lines, seen.select("od", "ot", "d", "t").distinct(), min_words)), "removed")
    held = seen.select(*key, "n", *who)
    met = held
    low, high = 0, GROWTH
    while True:
        mine = lines.join(met.select(*who).distinct().hint("merge"), who, "left_semi")
        left = staged(met.join(still_there(mine, removed).hint("merge"), [*key, *who], "left_semi"), "left")
        more = left.where(F.col("n") > low)  # all holders of a window of n or fewer occurrences are tried
        if more.isEmpty():
            discard(seen, left, lines)
            return removed
        tried = further_holders(held, more, low, high)
        extra = align(lines, staged(tried.select("od", "ot", *who).distinct(), "pairs"), min_words)
        last, removed = removed, staged(_together(removed.select(*who, F.col("removed").alias("lines")).unionByName(extra)), "removed")
        discard(last)
        met, low, high = more, high, high * GROWTH


def dedup_rows(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """row (all columns of docs), text (reduced), n_lines, n_removed, removed (numbers of the deleted lines, from 0; null
    if none)."""
    every = staged(line_table(docs, min_words), "lines")
    whole = [c for c in every.columns if c not in ("d", "t", "s1", "s2")]
    heads = every.groupBy("s1", "s2").agg(F.min(F.struct("d", "t")).alias("head"), *(F.first(c).alias(c) for c in whole))  # equal lines: equal columns
    heads = staged(heads.select("s1", "s2", "head.*", *whole), "heads")
    first = heads.where(F.col("total") >= min_words).select("s1", "s2", F.struct("d", "t").alias("head"), F.size("words").alias("size"))
    copies = every.select("d", "t", "s1", "s2").join(first.hint("merge"), ["s1", "s2"]).where((F.col("d") != F.col("head.d")) | (F.col("t") != F.col("head.t")))
    copies = copies.select("d", "t", F.sequence(F.lit(0), F.col("size") - 1).alias("removed")).dropDuplicates(["d", "t"])
    gone = aligned(heads.drop("s1", "s2", "total"), min_words).unionByName(copies)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64(text_of()).alias("t"), F.split("text", "\n", -1).alias("lines"))
    rows = rows.join(gone.hint("merge"), ["d", "t"], "left")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed"), lambda i: F.get("lines", i))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    return rows.select("row", text.alias("text"), count("lines").alias("n_lines"), count("removed").alias("n_removed"), "removed")


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs with text reduced, and n_lines, n_removed, removed; these replace columns of the same names."""
    new = ["text", "n_lines", "n_removed", "removed"]
    return dedup_rows(docs, **options).select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in new), *new)


def line_dedup(spark, sf_dir: str) -> DataFrame:
    """op2: all documents with the common blocks of earlier documents deleted."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_lines", "n_removed", "removed")
