"""A stored suffix index of label sequences: built by prefix doubling, probed with patterns, scanned by windows.

Every suffix of every sequence has a place in the order of all suffixes (ends first, ties by sequence and position).  The
index keeps of each its key, its first WIDTH labels as fixed-width text, and next, the place of the suffix WIDTH labels
on; rows are sorted by (key, next), so an order of whole suffixes is searched with short rows.  Blocks of BLOCK rows are
one row each, parts of blocks are folders, and bounds hold every block's first row, as the inner nodes of a search tree.

No task holds all suffixes: ranks are running sums over ranges (operators/orders.py), and a probe reads the two blocks
that a pattern's interval begins and ends in.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlab.functions import sequences as S
from strandlab.operators.orders import running
from strandlab.session import folder, for_python, written

#: Labels of a key, rows of a block, parts of an index at most.
WIDTH, BLOCK, PARTS = 8, 512, 256
#: Labels of a suffix that are sorted at once; ranks by prefix doubling come behind these.
WIDE = 128
#: Characters of a label in a key, and a character above all of these.
DIGITS, ABOVE = 4, "g"
_ROW = ["key", "next"]


def keyed(labels: Column | str) -> Column:
    """Text of an array of labels (0 .. 65535) whose order is that of the labels."""
    return F.array_join(F.transform(labels, lambda s: F.lpad(F.hex(s.cast("long")), DIGITS, "0")), "")


@dataclass
class Index:
    """places: place, seq_id, pos, key, next, left; blocks: part, block, first, rows; bounds: part, block, key, next."""

    places: DataFrame
    blocks: DataFrame
    bounds: DataFrame
    width: int = WIDTH
    block: int = BLOCK

    def save(self, path: str) -> None:
        self.places.write.parquet(f"{path}/places")
        self.blocks.write.partitionBy("part").parquet(f"{path}/blocks")
        self.bounds.write.parquet(f"{path}/bounds")
        self.places.sparkSession.createDataFrame([(self.width, self.block)], "width int, block int").coalesce(1).write.parquet(f"{path}/shape")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        shape = spark.read.parquet(f"{path}/shape").first()
        kinds = "block long, first long, rows array<struct<key:string,next:long,seq_id:long,pos:long>>, part int"
        return Index(spark.read.parquet(f"{path}/places"), spark.read.schema(kinds).parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/bounds"), shape["width"], shape["block"])


def _refined(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with rank: how many rows are smaller by the columns.

    Joins of suffixes are merged: their files are small for their rows, and the driver would hold these for a broadcast."""
    kinds = rows.groupBy(*by).agg(F.count("*").alias("n"))
    smaller = running(kinds, "n", by, name="new").drop("n")
    return rows.join(smaller.hint("merge"), by).drop("rank").withColumnRenamed("new", "rank")


def _cut(labels: DataFrame, width: int) -> DataFrame:
    """seq_id, pos, left, key (its first width labels, two bytes each) and further columns of labels, of every suffix;
    a sequence is a row's value."""
    more = [c for c in labels.columns if c not in ("seq_id", "pos", "state")]
    text = labels.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "state", *more))).alias("x"))
    each = text.select("seq_id", F.unhex(keyed("x.state")).alias("text"), F.size("x").alias("n"), F.explode("x").alias("x"))
    pos = F.col("x.pos")
    key = F.substring("text", (2 * pos + 1).cast("int"), F.lit(2 * width))
    return each.select("seq_id", pos.alias("pos"), (F.col("n") - pos).alias("left"), key.alias("key"), *(F.col(f"x.{c}") for c in more))


def _levels(rows: DataFrame, width: int, longest: int) -> list[tuple[int, DataFrame]]:
    """(h, seq_id, pos, rank by the first h labels) from h = width on, by prefix doubling, until ranks are those of whole
    suffixes; equal suffixes have equal ranks."""
    total = rows.count()
    now, h, levels = written(_refined(rows.select("seq_id", "pos", "key"), ["key"]).select("seq_id", "pos", "rank"), "rank"), width, []
    while True:
        levels.append((h, now))
        if h >= longest or now.select("rank").distinct().count() == total:
            return levels
        on = now.select("seq_id", (F.col("pos") - h).alias("pos"), F.col("rank").alias("after"))
        both = now.join(on.hint("merge"), ["seq_id", "pos"], "left").withColumn("after", F.coalesce("after", F.lit(-1).cast("long")))
        now, h = written(_refined(both, ["rank", "after"]).select("seq_id", "pos", "rank"), "rank"), 2 * h


@dataclass
class Order:
    """rows: place from 0, seq_id, pos, left, key, further columns of the labels, and the same of the suffix before, as
    b_...; levels: ranks by so many labels, of sequences of more than width labels."""

    rows: DataFrame
    levels: list[tuple[int, DataFrame]]
    width: int


def in_order(labels: DataFrame, width: int = WIDE, ties: tuple[str, ...] = ("seq_id", "pos")) -> Order:
    """All suffixes of labels (seq_id, pos from 0, state) in order.

    Suffixes are sorted once, by their first width labels; where a sequence is longer, by ranks from prefix doubling
    behind these.  A range's first row takes the last row of the range before."""
    rows = written(_cut(labels, width), "suffixes")
    longest = rows.agg(F.coalesce(F.max("left"), F.lit(0))).first()[0]
    levels = _levels(rows, width, longest) if longest > width else []
    if levels:
        rows = rows.join(levels[-1][1].hint("merge"), ["seq_id", "pos"])
    by = ["key", *(["rank"] if levels else []), *ties]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(rows.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()), "ranges")
    names = [c for c in rows.columns if c != "rank"]
    last = F.max(F.struct(*dict.fromkeys([*by, *names]))).alias("last")
    ends = ranged.groupBy("_part").agg(F.count("*").alias("n"), last)  # one row a range
    w = Window.orderBy("_part")
    start = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("_part", start.alias("start"), F.lag("last").over(w).alias("last"))
    w = Window.partitionBy("_part").orderBy(*by)
    inside = ranged.select("_part", *names, F.row_number().over(w).alias("row"), *(F.lag(c).over(w).alias(f"l_{c}") for c in names))
    before = [F.when(F.col("row") == 1, F.col(f"last.{c}")).otherwise(F.col(f"l_{c}")).alias(f"b_{c}") for c in names]
    out = inside.join(F.broadcast(ends), "_part").select((F.col("start") + F.col("row") - 1).cast("long").alias("place"), *names, *before)
    return Order(out, levels, width)


def build(labels: DataFrame, width: int = WIDTH, block: int = BLOCK, parts: int = PARTS, wide: int = WIDE) -> Index:
    """The index of labels (seq_id, pos from 0, state)."""
    placed = in_order(labels, max(width, wide)).rows
    on = F.lead("place", width).over(Window.partitionBy("seq_id").orderBy("pos"))
    key = F.hex(F.substring("key", F.lit(1), F.lit(2 * width)))
    places = placed.select("place", "seq_id", "pos", key.alias("key"), "left").withColumn("next", F.coalesce(on, F.lit(-1).cast("long")))
    places = written(places.select("place", "seq_id", "pos", "key", "next", "left"), "places")
    n_blocks = -(-places.count() // block)
    each = max(1, -(-n_blocks // parts))
    number = F.floor(F.col("place") / block).cast("long")
    row = F.struct("place", "key", "next", "seq_id", "pos")
    rows = places.groupBy(number.alias("block")).agg(F.array_sort(F.collect_list(row)).alias("r"))  # at most `block` rows
    kept = F.transform("r", lambda x: F.struct(x["key"].alias("key"), x["next"].alias("next"), x["seq_id"].alias("seq_id"), x["pos"].alias("pos")))
    blocks = rows.select("block", F.col("r")[0]["place"].alias("first"), kept.alias("rows"), F.floor(F.col("block") / each).cast("int").alias("part"))
    blocks = written(blocks.repartitionByRange(max(1, min(parts, n_blocks)), "part"), "blocks")
    bounds = written(blocks.select("part", "block", F.col("rows")[0]["key"].alias("key"), F.col("rows")[0]["next"].alias("next")), "bounds")
    return Index(places, blocks, bounds, width, block)


def _located(index: Index, markers: DataFrame) -> DataFrame:
    """markers (id, key, next) with at: how many rows of the index are smaller.

    The part comes from the parts' first rows (at most PARTS, one row), the block from the part's bounds in one sorted
    pass, and the place from that block alone."""
    first = index.bounds.groupBy("part").agg(F.min(F.struct(*_ROW)).alias("f")).agg(F.array_sort(F.collect_list("f")).alias("firsts"))
    mine = F.struct(*_ROW)
    smaller = F.size(F.filter("firsts", lambda f: f < F.struct(*_ROW)))
    routed = markers.join(F.broadcast(first)).withColumn("part", F.greatest(smaller - 1, F.lit(0))).drop("firsts")
    tops = index.bounds.select("part", *_ROW, F.lit(None).cast("string").alias("id"), "block")
    both = routed.select("part", *_ROW, "id", F.lit(None).cast("long").alias("block")).unionByName(tops)
    # a marker stands before a bound that equals it; suffixes that end within a key are equal rows, over many blocks
    w = Window.partitionBy("part").orderBy(*_ROW, F.col("id").isNull(), "block").rowsBetween(Window.unboundedPreceding, 0)
    found = written(both.withColumn("block", F.last("block", ignorenulls=True).over(w)).where("id IS NOT NULL"), "found")
    hit = [r["part"] for r in found.select("part").distinct().collect()]  # at most PARTS numbers; only these folders are read
    inside = F.size(F.filter("rows", lambda r: F.struct(r["key"].alias("key"), r["next"].alias("next")) < mine))
    # an inner join, so few markers go to the blocks and the blocks stay; only an empty index has markers without a block
    read = index.blocks.where(F.col("part").isin(hit)).select("block", "first", "rows").join(found, "block")
    none = found.where("block IS NULL").select("id", F.lit(0).cast("long").alias("at"))
    return read.select("id", (F.col("first") + inside).cast("long").alias("at")).unionByName(none)


def probe(index: Index, patterns: DataFrame) -> DataFrame:
    """pattern, low, high: the places low .. high - 1 are those of the suffixes that begin with the pattern (an array of
    labels, of any length from 1); where there is none, low = high is where they would be.

    A pattern is cut into pieces of a key's width, and searched from its last piece on: that is a range of keys; a piece
    before is one key, with next in the interval found so far."""
    spark = patterns.sparkSession
    chars = index.width * DIGITS
    text = keyed("pattern")
    now = patterns.select("pattern", text.alias("id")).distinct().where("id <> ''").select("pattern", "id", (F.ceil(F.length("id") / chars) - 1).cast("int").alias("c"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    now = written(now, "patterns")
    left = now.agg(F.max("c")).first()[0]
    while left is not None and left >= 0:
        some = now.where("c >= 0")
        piece = F.expr(f"substring(id, c * {chars} + 1, {chars})")
        inner, least = F.col("low").isNotNull(), F.lit(-2).cast("long")
        start = some.select(F.concat(F.lit("a"), "id").alias("id"), piece.alias("key"), F.when(inner, F.col("low")).otherwise(least).alias("next"))
        end = some.select(F.concat(F.lit("b"), "id").alias("id"), F.when(inner, piece).otherwise(F.concat(piece, F.lit(ABOVE))).alias("key"), F.when(inner, F.col("high")).otherwise(least).alias("next"))
        at = _located(index, start.unionByName(end)).select(F.substring("id", 2, 1 << 30).alias("id"), F.substring("id", 1, 1).alias("side"), "at")
        at = at.groupBy("id").agg(F.max(F.when(F.col("side") == "a", F.col("at"))).alias("x"), F.max(F.when(F.col("side") == "b", F.col("at"))).alias("y"))
        stepped = now.join(at, "id", "left").select("pattern", "id", (F.col("c") - 1).alias("c"), F.coalesce("x", "low").alias("low"), F.coalesce("y", "high").alias("high"))
        now, left = written(stepped, "patterns"), left - 1
    return now.select("pattern", "low", "high")


def occurrences(index: Index, intervals: DataFrame) -> DataFrame:
    """pattern, seq_id, pos of every place of the intervals."""
    some = intervals.where("high > low")
    size = index.block
    at = some.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / size).cast("long"), F.floor((F.col("high") - 1) / size).cast("long"))))
    read = at.join(index.blocks.select("block", "first", "rows"), "block")
    start = F.greatest(F.col("low") - F.col("first"), F.lit(0))
    end = F.least(F.col("high") - F.col("first"), F.size("rows"))
    rows = F.slice("rows", (start + 1).cast("int"), (end - start).cast("int"))
    return read.select("pattern", F.explode(rows).alias("r")).select("pattern", "r.seq_id", "r.pos")


def _shared(a: str, b: str, width: int) -> Column:
    """Common labels of two keys, by halving."""
    steps = F.array(*(F.lit(1 << i) for i in range(width.bit_length() - 1, -1, -1)))
    begin = lambda k, n: F.substring(k, F.lit(1), 2 * n)
    same = lambda n: (F.length(a) >= 2 * n) & (begin(a, n) == begin(b, n))
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(same(n + s), n + s).otherwise(n))


def with_before(order: Order) -> DataFrame:
    """The rows of an order with lcp: labels in common with the suffix before; key and b_key go."""
    width, names = order.width, [c for c in order.rows.columns if c not in ("key", "b_key")]
    most = F.least("left", "b_left")
    near = F.when(F.col("b_key").isNull(), 0).when(F.col("key") == F.col("b_key"), F.least(most, F.lit(width))).otherwise(_shared("key", "b_key", width))
    if not order.levels:
        return order.rows.select(*names, near.cast("long").alias("lcp"))
    rows = written(order.rows, "neighbours")
    apart = F.col("b_key").isNull() | (F.col("key") != F.col("b_key")) | (most <= width)
    done = rows.where(apart).select(*names, near.cast("long").alias("lcp"))
    out = rows.where(~apart).select(*names, F.lit(width).cast("long").alias("lcp"))
    here, there = (F.col("pos") + F.col("lcp")).alias("at"), (F.col("b_pos") + F.col("lcp")).alias("bat")

    def beside(table: DataFrame, value: str) -> DataFrame:
        """out with the table's value, x and y, where the prefixes known so far end."""
        mine = table.select("seq_id", F.col("pos").alias("at"), F.col(value).alias("x"))
        other = table.select(F.col("seq_id").alias("b_seq_id"), F.col("pos").alias("bat"), F.col(value).alias("y"))
        return out.select(*out.columns, here, there).join(mine.hint("merge"), ["seq_id", "at"], "left").join(other.hint("merge"), ["b_seq_id", "bat"], "left")

    for h, level in reversed(order.levels):
        more = F.when(F.col("x") == F.col("y"), F.least(F.lit(h), most - F.col("lcp"))).otherwise(0)
        out = written(beside(level, "rank").select(*names, (F.col("lcp") + more).alias("lcp")), "lcp")
    rest = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), _shared("x", "y", width)).otherwise(0)
    return done.unionByName(beside(rows, "key").select(*names, (F.col("lcp") + rest).cast("long").alias("lcp")))


def with_prefixes(labels: DataFrame, width: int = WIDE) -> DataFrame:
    """place, seq_id, pos, left, lcp (labels in common with the suffix before) of every suffix."""
    return with_before(in_order(labels, width)).select("place", "seq_id", "pos", "left", "lcp")


class _Recent:
    """The sequences seen last, oldest first, with the place where each was seen last; and the least common prefixes since.

    A sequence counts with its weight; entries: (sequence, place, least common prefix from there to the end, weight)."""

    def __init__(self, most: int, entries: list[tuple[int, int, int, int]]):
        self.most, self.seen, self.low, self.total = most, OrderedDict(), deque(), 0
        for k, (seq, place, least, weight) in enumerate(entries):
            self.seen[seq] = (place, weight)
            self.total += weight
            self._push(entries[k + 1][1] if k + 1 < len(entries) else place + 1, least)

    def _push(self, place: int, value: int) -> None:
        while self.low and self.low[-1][1] >= value:
            self.low.pop()
        self.low.append((place, value))

    def add(self, seq: int, place: int, lcp: int, weight: int = 1) -> int | None:
        """The least common prefix of the shortest window up to here with enough sequences; None if there is none."""
        self._push(place, lcp)
        if self.seen.pop(seq, None) is None:
            self.total += weight
        self.seen[seq] = (place, weight)
        lower, first = next(iter(self.seen.values()))
        while self.total - first >= self.most:
            self.total -= first
            self.seen.popitem(last=False)
            if not self.seen:
                break
            lower, first = next(iter(self.seen.values()))
        while self.low and self.low[0][0] <= lower:
            self.low.popleft()
        if self.total < self.most:
            return None
        return self.low[0][1] if self.low else 1 << 30  # a window of one row

    def entries(self) -> list[tuple[int, int, int, int]]:
        out, low = [], list(self.low)
        for seq, (place, weight) in self.seen.items():
            while low and low[0][0] <= place:
                low.pop(0)
            out.append((seq, place, low[0][1] if low else 1 << 30, weight))
        return out


def _joined(before: list[tuple[int, int, int, int]], after: list[tuple[int, int, int, int]], least: int, most: int) -> list[tuple[int, int, int, int]]:
    """The entries at the end of a range, from those at its begin and its own; least: the range's least common prefix."""
    mine = {e[0] for e in after}
    return ([(seq, place, min(low, least), weight) for seq, place, low, weight in before if seq not in mine] + after)[-most:]


def dealt(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """rows (place, seq_id, lcp, cap) in parts of the order, each whole and sorted in one task; persisted for the passes."""
    total = rows.count()
    each = max(1, -(-total // parts))
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.floor(F.col("place") / each).cast("int")
    return rows.select(part.alias("part"), "place", "seq_id", "lcp", "cap").repartition(n, "part").sortWithinPartitions("part", "place").persist()


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Iterator[tuple[int, int, int, int]]]]:
    """(part, its rows in order) of a task's batches."""
    from itertools import groupby

    def each():
        for b in batches:
            yield from zip(b["part"].tolist(), b["place"].tolist(), b["seq_id"].tolist(), b["lcp"].tolist(), b["cap"].tolist(), strict=True)

    for part, rows in groupby(each(), key=lambda r: r[0]):
        yield part, ((place, seq, lcp, cap) for _, place, seq, lcp, cap in rows)


def windows(rows: DataFrame, least: int, at: int = 0) -> DataFrame:
    """place, shared: for every suffix that can begin a word of `at` labels (its cap), the labels that the shortest run of
    such suffixes up to it in which `least` sequences occur has in common; rows from dealt().

    Two passes without a shuffle: each part's last `least` sequences (what a later part needs of it, at most PARTS * least
    rows in all), and the scan of each part from where those before it end."""
    spark = rows.sparkSession
    for_python(spark)

    def scan(given: Iterator, recent: _Recent, low: int):
        """Yields place and shared; low: the least prefix since the last suffix that counts."""
        for place, seq, lcp, cap in given:
            low = min(low, lcp)
            if cap >= at:
                yield place, recent.add(seq, place, low), low
                low = 1 << 30
        yield None, None, low

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, given in _parts(batches):
            recent, all_, rest = _Recent(least, []), 1 << 30, 1 << 30
            for place, _, low in scan(given, recent, 1 << 30):
                if place is None:
                    rest = low
                else:
                    all_ = min(all_, low)
            e = recent.entries()
            yield pd.DataFrame({"part": [part], "seqs": [[x[0] for x in e]], "places": [[x[1] for x in e]], "lows": [[x[2] for x in e]], "whole": [all_], "rest": [rest]})

    kinds = "part int, seqs array<long>, places array<long>, lows array<long>, whole long, rest long"
    before: dict[int, tuple[list, int]] = {}
    now, open_ = [], 1 << 30
    for r in sorted(rows.mapInPandas(ends, kinds).collect(), key=lambda r: r["part"]):  # at most PARTS rows of `least` entries
        before[r["part"]] = (now, open_)
        mine = [(*e, 1) for e in zip(r["seqs"], r["places"], r["lows"], strict=True)]
        if mine:
            now, open_ = _joined(now, mine, min(open_, r["whole"]), least), r["rest"]
        else:
            open_ = min(open_, r["rest"])
    shipped = spark.sparkContext.broadcast(before)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, given in _parts(batches):
            entries, low = shipped.value[part]
            out = [(place, w) for place, w, _ in scan(given, _Recent(least, entries), low) if w is not None and place is not None]
            yield pd.DataFrame({"place": np.array([x[0] for x in out], dtype=np.int64), "shared": np.array([x[1] for x in out], dtype=np.int64)})

    return rows.mapInPandas(run, "place long, shared long")


def _whole_parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """(part, all its rows) of a task's batches, which have parts one after another."""
    now: list[pd.DataFrame] = []
    for b in batches:
        for part, some in b.groupby("part", sort=False):
            if now and now[0]["part"].iloc[0] != part:
                yield int(now[0]["part"].iloc[0]), pd.concat(now)
                now = []
            now.append(some)
    if now:
        yield int(now[0]["part"].iloc[0]), pd.concat(now)


def _last(part: pd.DataFrame, least: int) -> list[tuple[int, int, int, int]]:
    """The entries at the end of a part, as many as have the weight."""
    seqs, weights, places, lcps = (part[c].tolist() for c in ("seq_id", "w", "place", "lcp"))
    seen, low, total, out = set(), 1 << 30, 0, []
    for i in range(len(seqs) - 1, -1, -1):
        if seqs[i] not in seen:
            seen.add(seqs[i])
            out.append((seqs[i], places[i], low, weights[i]))
            total += weights[i]
            if total >= least:
                break
        low = min(low, lcps[i])
    return out[::-1]


def reach(rows: DataFrame, least: int, parts: int | None = None, size: int = 1 << 16) -> DataFrame:
    """seq_id, pos, reach: for every suffix, the labels of its longest prefix that occurs in sequences of so much weight.

    rows: place, seq_id, pos, left, lcp, w (the sequence's weight).  Windows give it where they end, and the suffixes before
    take what they share with it: from a part to the one before, that is one number.  Passes over the sorted parts, of
    `size` rows at least, shuffle nothing; a part sends its last entries (`least` at most) and two numbers."""
    spark = rows.sparkSession
    for_python(spark)
    total = rows.count()
    n = parts or max(1, min(PARTS, total // size))
    each = max(1, -(-total // n))
    tasks = min(n, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    part = F.floor(F.col("place") / each).cast("int")
    rows = rows.select(part.alias("part"), "place", "seq_id", "pos", "left", "lcp", "w").repartition(tasks, "part").sortWithinPartitions("part", "place").persist()

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, given in _whole_parts(batches):
            e = _last(given, least)
            yield pd.DataFrame({"part": [part], "entries": [[list(x) for x in e]], "whole": [given["lcp"].min()]})

    before: dict[int, list] = {}
    now: list[tuple[int, int, int, int]] = []
    for r in sorted(rows.mapInPandas(ends, "part int, entries array<array<long>>, whole long").collect(), key=lambda r: r["part"]):
        before[r["part"]] = now
        now = _joined(now, [tuple(e) for e in r["entries"]], r["whole"], least)
    shipped = spark.sparkContext.broadcast(before)

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, given in _whole_parts(batches):
            recent = _Recent(least, shipped.value[part])
            values = zip(given["seq_id"].tolist(), given["place"].tolist(), given["lcp"].tolist(), given["w"].tolist(), strict=True)
            shared = np.array([recent.add(*v) or 0 for v in values], dtype=np.int64)
            yield given[["part", "seq_id", "pos", "left", "lcp"]].assign(shared=np.minimum(shared, given["left"].to_numpy()))

    seen = rows.mapInPandas(forward, "part int, seq_id long, pos long, left long, lcp long, shared long").persist()

    def backward(given: pd.DataFrame, after: int) -> list[int]:
        """What every suffix of a part reaches, last first; after: what the last one has in common with what is behind it."""
        out, now = [], after
        for lcp, shared in zip(reversed(given["lcp"].tolist()), reversed(given["shared"].tolist()), strict=True):
            now = max(now, shared)
            out.append(now)
            now = min(now, lcp)
        return out

    def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, given in _whole_parts(batches):
            lcps = given["lcp"]
            yield pd.DataFrame({"part": [part], "own": [min(backward(given, 0)[-1], lcps.iloc[0])], "whole": [lcps.min()]})

    after: dict[int, int] = {}
    behind = 0
    for r in sorted(seen.mapInPandas(firsts, "part int, own long, whole long").collect(), key=lambda r: -r["part"]):
        after[r["part"]] = behind
        behind = max(r["own"], min(r["whole"], behind))
    carried = spark.sparkContext.broadcast(after)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, given in _whole_parts(batches):
            yield given[["seq_id", "pos"]].assign(reach=backward(given, carried.value[part])[::-1])

    out = written(seen.mapInPandas(run, "seq_id long, pos long, reach long"), "reach")
    for table in (seen, rows):
        table.unpersist()
    return out


def common_prefixes(labels: DataFrame, least: int, shortest: int) -> DataFrame:
    """key (labels as text), length, n, place: what the shortest windows with `least` sequences have in common, how many
    of them have it, and the first one's end."""
    rows = written(with_prefixes(labels), "prefixes")
    found = windows(dealt(rows.withColumn("cap", F.col("left"))), least).where(F.col("shared") >= shortest)
    each = found.join(rows.select("place", "seq_id", "pos", "left"), "place").withColumn("length", F.least("shared", "left"))
    text = labels.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "state"))).alias("x"))  # a sequence is a row's value
    cut = each.join(text, "seq_id").select("place", "length", F.slice(F.col("x.state"), (F.col("pos") + 1).cast("int"), F.col("length").cast("int")).alias("word"))
    return cut.groupBy("word").agg(F.first("length").alias("length"), F.count("*").alias("n"), F.min("place").alias("place"))


def letters(seqs: DataFrame) -> DataFrame:
    """seq_id, pos, state: the characters of the sequences as labels; and further columns of seqs."""
    each = F.transform(S.chars("seq"), lambda c: F.ascii(c))
    more = [c for c in seqs.columns if c not in ("seq_id", "seq")]
    return seqs.select("seq_id", F.posexplode(each).alias("pos", "state"), *more).withColumn("pos", F.col("pos").cast("long"))


def uncut(seqs: DataFrame, mark: str = "#") -> DataFrame:
    """seq_id, pos, cap: from each place on, the characters up to the next mark."""
    each = F.expr(f"transform(sequence(1, length(seq)), p -> IF(locate('{mark}', seq, p) = 0, length(seq) + 1, locate('{mark}', seq, p)) - p)")
    rows = seqs.where("seq <> ''").select("seq_id", F.posexplode(each).alias("pos", "cap"))
    return rows.select("seq_id", F.col("pos").cast("long").alias("pos"), F.col("cap").cast("long").alias("cap"))


def longest_common(prefixes: DataFrame, seqs: DataFrame, least: int, shortest: int) -> int:
    """The length of the longest word that `least` sequences share and that holds no mark, shortest - 1 if there is none;
    prefixes: with_prefixes() of the sequences before anything was marked.

    The order of suffixes is made once for all rounds: a word's suffixes are neighbours among those that aren't cut before
    its end.  The passes of the bisection read rows that are dealt once, and shuffle nothing."""
    rows = dealt(prefixes.drop("left").join(uncut(seqs), ["seq_id", "pos"]))
    most = windows(rows, least, shortest).agg(F.max("shared")).first()[0] or 0
    low, high = shortest - 1, min(most, rows.agg(F.max("cap")).first()[0] or 0)
    while low < high:
        k = (low + high + 1) // 2
        if windows(rows, least, k).where(F.col("shared") >= k).isEmpty():
            high = k - 1
        else:
            low = k
    rows.unpersist()
    return low


def save_and_load(index: Index, spark: SparkSession) -> Index:
    """The index as read back from a new folder."""
    path = folder(spark, "index")
    index.save(path)
    return Index.load(spark, path)
