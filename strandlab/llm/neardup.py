"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

Every distinct text (sequence of lower-case words; case, punctuation and spacing don't count) is signed with TREES paths
of MinHash values, one path a prefix trie.  Texts whose paths agree on a prefix share a trie node and are candidates.  The
prefix has the greatest length at which a pair right at the threshold is found with EXPECTED; nearer pairs, with more.  So
it depends on threshold and tries only, no text is drawn to choose it, and equal texts are treated alike in any input.
Shorter prefixes have all candidates of longer ones, so the tries are matched there at once.  The recall can be measured
(measured): a bounded sample of texts (PROBES) meets all texts by exact shingle counts.

The tries are rows sorted by (trie, prefix) over range partitions; a node is a run of equal prefixes, found in one pass.
Each run links its texts to its first one, and the ends of neighbouring ranges are linked, so that a node of any size
gives a linear number of rows and may lie in as many ranges as it needs.  Linked texts (components) are sorted by number
of shingles and place in the first trie, and cut into blocks of bounded size.  A block is compared with itself and with
those blocks of its component that it shares a trie node with and whose numbers of shingles allow the threshold; each
comparison yields one row a text (its number of verified links and its root among them), never the pairs themselves.

Result per document: class_id (smallest doc_id of all documents connected by verified links or equal texts), n_links
(other distinct texts whose Jaccard index with this one's is at least the threshold) and n_copies (documents with its
text), besides text_hash (xxhash64 of the text) and keeper (it is the class's first by doc_id and text_hash).  Texts of
fewer than five words are one shingle of all their words, so only equal ones match; null and empty texts are equal
texts.  Repeated rows each get the same row; a doc_id with several texts has one row for each; rows without a doc_id get
null, zeros and keeper false; no other column is read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlab.llm.common import bounded_batches, discard, parts_of, staged, table, text_of
from strandlab.llm.graph import components

SHINGLE = 5
TREES = 20
DEEPEST = 8
#: Expected share of the pairs at the threshold that share a trie node.
EXPECTED = 0.9999
THRESHOLD = 0.8
#: For measuring only: shares of the sample's true pairs, with so many missed ones added; so many texts and characters of
#: the sample at most, first by a hash of doc_id.
RECALL, LEAST, THREE = 0.999, 0.9995, 3
PROBES, PROBE_CHARS = 1024, 4_000_000
#: Words and texts of a block, about.
BLOCK_WORDS, BLOCK_TEXTS = 150_000, 1000
_CHUNK = 4096
_WORD = re.compile(r"\w+")
_VALUE = 4  # bytes of a MinHash value in a path


def expected_depth(threshold: float, trees: int, deepest: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold meets in some trie with the wanted probability."""
    for depth in range(deepest, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError("more trees are needed for this recall")


def matched_depth(met: dict[int, int], threshold: float, trees: int, deepest: int, recall: float = RECALL) -> int:
    """The longest prefix whose measured recall is enough, or the one of LEAST; met: true pairs of the sample by their
    longest shared prefix.  It says what a measurement proves; the join doesn't ask it."""
    least = expected_depth(threshold, trees, deepest, LEAST)
    total, depth = sum(met.values()), deepest
    while depth > least:
        if sum(n for d, n in met.items() if d >= depth) >= recall * (total + THREE):
            break
        depth -= 1
    return depth


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return _WORD.findall(text.lower())


class _Hashes(dict):
    """word -> 64-bit hash; forgets all when it holds too many words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


_HASHES = _Hashes()


def shingle_hashes(words: list[str], size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all word shingles; of all words together if they are fewer."""
    if len(words) < size:
        return np.array([int.from_bytes(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=8, key=b"short").digest(), "little")], dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h) - size + 1
    s = h[:n].copy()
    for k in range(1, size):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    return s ^ (s >> np.uint64(29))


class Signer:
    """Paths (trees x depth MinHash values) of a text."""

    def __init__(self, trees: int, depth: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        k = trees * depth
        self.trees, self.depth = trees, depth
        self.flip = rng.integers(0, 1 << 63, k, dtype=np.uint64)[:, None]
        self.times = (rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        low = None
        for at in range(0, len(shingles), _CHUNK):
            part = ((shingles[None, at : at + _CHUNK] ^ self.flip) * self.times).min(axis=1)
            low = part if low is None else np.minimum(low, part)
        # the low half of a mixed minimum: the high half of a minimum is nearly the same for all long texts
        low ^= low >> np.uint64(29)
        low *= np.uint64(0xBF58476D1CE4E5B9)
        return (low >> np.uint64(32)).astype("<u4").reshape(self.trees, self.depth)


def text_key(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


class Probes:
    """Sampled texts that meet all others."""

    def __init__(self, keys: list[bytes], shingles: list[np.ndarray], paths: list[np.ndarray], threshold: float):
        self.keys, self.threshold = keys, Fraction(str(threshold)).as_integer_ratio()
        self.size = np.array([len(x) for x in shingles], dtype=np.int64)
        self.paths = np.stack(paths) if paths else None
        every = np.concatenate(shingles) if shingles else np.zeros(0, dtype=np.uint64)
        order = np.argsort(every, kind="stable")
        self.owner = np.repeat(np.arange(len(keys)), self.size)[order]
        self.kinds, self.start = np.unique(every[order], return_index=True)
        self.count = np.diff(np.append(self.start, len(every)))

    def meet(self, key: bytes, own: np.ndarray, path: np.ndarray) -> list[int]:
        """The longest prefix shared with each probe whose Jaccard index with the text is at least the threshold."""
        if not len(self.kinds):
            return []
        at = np.searchsorted(self.kinds, own)
        at[at == len(self.kinds)] = 0
        at = at[self.kinds[at] == own]
        if not len(at):
            return []
        n = self.count[at]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[at], n)
        common = np.bincount(self.owner[place], minlength=len(self.keys))
        over, under = self.threshold
        near = np.flatnonzero(under * common >= over * (self.size + len(own) - common))
        return [int((self.paths[i] == path).cumprod(axis=1).sum(axis=1).max()) for i in near if self.keys[i] != key]


def draw_probes(docs: DataFrame, signer: Signer, threshold: float) -> Probes:
    """At most PROBES texts of at most PROBE_CHARS characters together; what comes to the driver is bounded by these."""
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(PROBES)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), "doc_id").select(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), "text")
    sizes = rows.select("h", "t", F.length("text").alias("n")).where(F.col("n") <= PROBE_CHARS).distinct().orderBy("h", "t").limit(PROBES)
    upto = sizes.withColumn("chars", F.sum("n").over(Window.orderBy("h", "t"))).where(F.col("chars") <= PROBE_CHARS).select("h", "t")
    rows = rows.join(F.broadcast(upto), ["h", "t"]).dropDuplicates(["h", "t"]).select("text")
    schema = pa.schema([("key", pa.binary()), ("own", pa.binary()), ("path", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[bytes]] = [[], [], []]
            for t in b.column(0):
                words = words_of(t.as_py())
                own = np.unique(shingle_hashes(words))
                for column, v in zip(out, (text_key(words), own.tobytes(), signer(own).tobytes()), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in out], schema=schema)

    got = {r["key"]: r for r in rows.mapInArrow(run, "key binary, own binary, path binary").toArrow().to_pylist()}
    one = [got[k] for k in sorted(got)]
    paths = [np.frombuffer(r["path"], dtype="<u4").reshape(signer.trees, signer.depth) for r in one]
    return Probes([r["key"] for r in one], [np.frombuffer(r["own"], dtype=np.uint64) for r in one], paths, threshold)


def sign(docs: DataFrame, signer: Signer) -> DataFrame:
    """doc_id, the text's xxhash64 and the 128-bit key of its words, its numbers of words and distinct shingles, and its
    paths (bytes)."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("n_shingles", pa.int64()), ("path", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for t in b.column(2):
                words = words_of(t.as_py())
                own = np.unique(shingle_hashes(words))
                k1, k2 = np.frombuffer(text_key(words), dtype=np.int64).tolist()
                for column, v in zip(out, (k1, k2, len(words), len(own), signer(own).tobytes()), strict=True):
                    column.append(v)
            kinds = [f.type for f in schema][2:]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], schema=schema)

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64(text_of()), text_of())
    return rows.mapInArrow(run, "doc_id long, text_hash long, k1 long, k2 long, n_words long, n_shingles long, path binary")


def measured(docs: DataFrame, *, threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST) -> dict[int, int]:
    """True pairs of the sampled texts with all distinct texts, by the longest prefix that they share in any trie."""
    bounded_batches(docs.sparkSession)
    signer = Signer(trees, deepest)
    probes = draw_probes(docs, signer, threshold)
    schema = pa.schema([("key", pa.binary()), ("met", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, met = [], []
            for t in b.column(0):
                words = words_of(t.as_py())
                own, key = np.unique(shingle_hashes(words)), text_key(words)
                keys.append(key)
                met.append(probes.meet(key, own, signer(own)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(met, pa.list_(pa.int32()))], schema=schema)

    rows = docs.where("doc_id is not null").select(text_of().alias("text")).mapInArrow(run, "key binary, met array<int>").where("size(met) > 0").dropDuplicates(["key"])
    return {r["d"]: r["n"] for r in rows.select(F.explode("met").alias("d")).groupBy("d").agg(F.count("*").alias("n")).collect()}  # deepest + 1 rows at most


def trie_rows(texts: DataFrame, depth: int, trees: int, deepest: int) -> DataFrame:
    """All columns of texts but path, with tree and prefix: one row for each trie."""
    cut = f"transform(sequence(0, {trees - 1}), i -> named_struct('tree', i, 'prefix', substring(path, i * {deepest * _VALUE} + 1, {depth * _VALUE})))"
    rest = [c for c in texts.columns if c != "path"]
    return texts.select(*rest, F.explode(F.expr(cut)).alias("_at")).select(*rest, "_at.tree", "_at.prefix")


def _runs(depth: int):
    """Sorted (tree, prefix, node) -> (u, v): v is the first node of u's run of equal prefixes; and one row a task with
    its number and the first and last run's prefix and first node."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("part", pa.int64()), ("first", pa.binary()), ("last", pa.binary())])
    width = depth * _VALUE + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = begun = key = head = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = np.empty((n, width), dtype=np.uint8)
            keys[:, :4] = b.column(0).to_numpy().astype("<i4").view(np.uint8).reshape(n, 4)
            keys[:, 4:] = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint8).reshape(n, width - 4)
            node = b.column(2).to_numpy()
            new = np.ones(n, dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            new[0] = key is None or keys[0].tobytes() != key
            at = np.where(new, np.arange(n), 0)
            np.maximum.accumulate(at, out=at)
            heads = node[at]
            if not new[0]:  # the run began in an earlier batch
                ends = int(np.argmax(new)) if new.any() else n
                heads[:ends] = head
            if begin is None:
                begin, begun = keys[0].tobytes(), int(node[0])
            key, head = keys[-1].tobytes(), int(heads[-1])
            link = ~new
            m = int(link.sum())
            yield pa.RecordBatch.from_arrays([pa.array(node[link]), pa.array(heads[link]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], schema=schema)
        if begin is not None:
            yield pa.RecordBatch.from_pylist([{"u": begun, "v": head, "part": TaskContext.get().partitionId(), "first": begin, "last": key}], schema=schema)

    return run


def trie_links(texts: DataFrame, depth: int, trees: int, deepest: int) -> tuple[DataFrame, list[DataFrame]]:
    """(u, v) for the texts of each trie node of more than one, as stars along the sorted tries; and what can be discarded
    once they were read."""
    order = ["tree", "prefix", "node"]
    rows = trie_rows(texts.select("node", "path"), depth, trees, deepest).select(*order)
    runs = rows.repartitionByRange(parts_of(texts.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(_runs(depth), "u long, v long, part long, first binary, last binary")
    runs = staged(runs, "runs")
    along = Window.orderBy("part")  # one row a range
    ends = runs.where("part is not null").select("u", F.lag("v").over(along).alias("v"), (F.lag("last").over(along) == F.col("first")).alias("same")).where("same").drop("same")
    return runs.where("part is null").select("u", "v").unionByName(ends), [runs]


def exact_sets(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle number) of every distinct shingle of each text, exactly numbered, and the sets' sizes."""
    number: dict = {}
    ids, ends, short, n = [], [], [], 0
    for i, t in enumerate(texts):
        words = words_of(t)
        if len(words) < size:
            short.append((i, tuple(words)))
            words = []
        ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words)))
        n += len(words)
        ends.append(n)
    w = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
    owner, one = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if n >= size:
        doc = np.repeat(np.arange(len(texts)), np.diff(np.array([0, *ends])))
        numbered = lambda a, b, most: np.unique(a * most + b, return_inverse=True)[1].astype(np.int64)
        total = len(number) + n  # more than any number below
        shingle = w
        for k in range(1, size):
            shingle = numbered(shingle[:-1], w[k:], total)
        whole = doc[: n - size + 1] == doc[size - 1 :]
        owner, one = doc[: n - size + 1][whole], shingle[whole]
    if short:
        extra: dict = {}
        top = int(one.max()) + 1 if len(one) else 0
        owner = np.concatenate([owner, np.array([i for i, _ in short])])
        one = np.concatenate([one, np.array([top + extra.setdefault(t, len(extra)) for _, t in short])])
    most = int(one.max()) + 1 if len(one) else 1
    both = np.unique(owner * most + one)
    owner, one = both // most, both % most
    return owner, one, np.bincount(owner, minlength=len(texts))


def intersections(owner: np.ndarray, one: np.ndarray, m: int) -> np.ndarray:
    """m x m counts of common shingles, by products of incidence matrices over the shingles of at least two texts."""
    count = np.bincount(one)
    keep = count[one] > 1
    owner, (kinds, col) = owner[keep], np.unique(one[keep], return_inverse=True)
    out = np.zeros((m, m), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    width = max(256, 2_000_000 // max(1, m))
    for at in range(0, len(kinds), width):
        lo, hi = np.searchsorted(col, [at, at + width])
        x = np.zeros((m, min(width, len(kinds) - at)), dtype=np.float32)
        x[owner[lo:hi], col[lo:hi] - at] = 1
        out += x @ x.T
    return out.astype(np.int64)


def verify_unit(ids: list[int], texts: list[str], side: list[int], threshold: float) -> Iterator[tuple[int, int, int]]:
    """(id, smallest linked id, number of links) for each text of a pair of blocks; side 0 and 1: only pairs between the
    two sides; all sides 0: all pairs."""
    m = len(ids)
    owner, one, size = exact_sets(texts)
    common = intersections(owner, one, m)
    union = size[:, None] + size[None, :] - common
    over, under = Fraction(str(threshold)).as_integer_ratio()
    link = under * common >= over * union
    np.fill_diagonal(link, False)
    s = np.array(side)
    if s.any():
        link &= s[:, None] != s[None, :]
    root = np.array(ids, dtype=np.int64)
    far = np.iinfo(np.int64).max
    while True:
        low = np.minimum(root, np.where(link, root[None, :], far).min(axis=1))
        if (low == root).all():
            break
        root = low
    yield from zip(ids, root.tolist(), link.sum(axis=1).tolist(), strict=True)


def _verify(threshold: float):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids, texts, side, out = None, [], [], [], []
        for b in batches:
            for i, j, right, node, text in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if (i, j) != unit:
                    if ids:
                        out.extend(verify_unit(ids, texts, side, threshold))
                    unit, ids, texts, side = (i, j), [], [], []
                ids.append(node)
                texts.append(text)
                side.append(right)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)
                out = []
        if ids:
            out.extend(verify_unit(ids, texts, side, threshold))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers runs of members of one root, of bounded words and texts."""
    block, last, words, texts = TaskContext.get().partitionId() << 40, None, 0, 0
    for b in batches:
        number = []
        for root, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if root != last or (texts and (words + n > BLOCK_WORDS or texts >= BLOCK_TEXTS)):
                block, last, words, texts = block + 1, root, 0, 0
            words, texts = words + n, texts + 1
            number.append(block)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(number, pa.int64())], names=["root", "node", "n_shingles", "block"])


def comparisons(member: DataFrame, texts: DataFrame, threshold: float, depth: int, trees: int, deepest: int) -> tuple[DataFrame, list[DataFrame]]:
    """(i, j, side, node): the texts of each pair of blocks that has to be compared; i = j: within a block; and what can be
    discarded once they were read."""
    order = ["root", "band", "lead", "node"]
    banded = member.withColumn("band", F.floor(F.log(F.col("n_shingles").cast("double")) / -math.log(threshold)))
    cut = banded.repartitionByRange(parts_of(member.sparkSession), *order).sortWithinPartitions(*order).select("root", "node", "n_words", "n_shingles")
    placed = staged(cut.mapInArrow(_blocks, "root long, node long, n_shingles long, block long"), "placed")
    block = placed.groupBy("block").agg(F.first("root").alias("root"), F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    several = block.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    split = placed.join(several, "root").select("node", "block").join(texts.select("node", "path"), "node")
    at = trie_rows(split, depth, trees, deepest).select("tree", "prefix", "block").distinct()
    met = at.withColumnRenamed("block", "i").join(at.withColumnRenamed("block", "j"), ["tree", "prefix"]).where("i < j").select("i", "j").distinct()
    side = lambda k: block.select(F.col("block").alias(k), F.col("low").alias(f"low_{k}"), F.col("high").alias(f"high_{k}"))
    met = met.join(side("i"), "i").join(side("j"), "j").where((F.col("high_i") >= threshold * F.col("low_j")) & (F.col("high_j") >= threshold * F.col("low_i"))).select("i", "j")
    met = staged(met, "met")
    alone = placed.select(F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"), "node")
    left = met.join(placed.select(F.col("block").alias("i"), "node"), "i").select("i", "j", F.lit(0).alias("side"), "node")
    right = met.join(placed.select(F.col("block").alias("j"), "node"), "j").select("i", "j", F.lit(1).alias("side"), "node")
    return alone.unionByName(left).unionByName(right), [placed, met]


def jaccard_classes(docs: DataFrame, *, threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, expected: float = EXPECTED) -> DataFrame:
    """doc_id, text_hash, class_id, n_links, n_copies and keeper of every document (see the module's text)."""
    bounded_batches(docs.sparkSession)
    depth = expected_depth(threshold, trees, deepest, expected)
    signed = staged(sign(docs, Signer(trees, deepest)), "signed")
    first = signed.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count("*").alias("n_copies"), *(F.first(c).alias(c) for c in ("n_words", "n_shingles", "path")))
    texts = staged(first.withColumn("node", F.monotonically_increasing_id()), "texts")
    links_, runs = trie_links(texts, depth, trees, deepest)
    near = components(links_)
    member = staged(near.join(texts.select("node", "n_words", "n_shingles", "rep", F.substring("path", 1, 8).alias("lead")), "node"), "member")
    discard(*runs)
    units, pairs = comparisons(member, texts, threshold, depth, trees, deepest)
    # a text once, however many rows have it
    found = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text_of()).alias("t"), text_of().alias("text"))
    wanted = member.select("node", F.col("rep.doc_id").alias("d"), F.col("rep.text_hash").alias("t"))
    found = found.join(wanted, ["d", "t"]).groupBy("node").agg(F.first("text").alias("text"))
    need = units.join(found, "node").select("i", "j", "side", "node", "text")
    verified = need.repartition("i", "j").sortWithinPartitions("i", "j", "node").mapInArrow(_verify(threshold), "u long, v long, links long")
    verified = staged(verified, "verified")
    discard(member, *pairs)
    classes = components(verified.select("u", "v"))
    links = verified.groupBy("u").agg(F.sum("links").alias("n_links")).withColumnRenamed("u", "node")
    heads = classes.join(texts.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("head"))
    known = texts.select("k1", "k2", "node", "rep", "n_copies").join(links, "node", "left").join(classes, "node", "left").join(heads, "root", "left")
    known = known.select("k1", "k2", F.coalesce("head", "rep").alias("head"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    mine = F.coalesce((F.col("doc_id") == F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash")), F.lit(False))
    every = signed.select("doc_id", "text_hash", "k1", "k2").join(known, ["k1", "k2"])
    every = every.select("doc_id", "text_hash", F.col("head.doc_id").alias("class_id"), "n_links", "n_copies", mine.alias("keeper"))
    none = lambda kind, v=None: F.lit(v).cast(kind)
    rest = docs.where("doc_id is null").select(none("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), none("long").alias("class_id"), none("long", 0).alias("n_links"), none("long", 0).alias("n_copies"), none("boolean", False).alias("keeper"))
    return every.unionByName(rest)


def near_duplicates(spark, sf_dir: str) -> DataFrame:
    """op9: classes of near-duplicate documents."""
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")
