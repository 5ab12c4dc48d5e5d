"""Best-fit packing of tokenised documents into fixed-length training sequences.

Method: bounded-space online best-fit.  Each packing task keeps a fixed number of open bins; a bitset has one bit
for each amount of free space that some open bin has, so the tightest bin that still takes a piece is the lowest set
bit at or above the piece's length.  If nothing fits and all bins are in use, the fullest closes first.

The stream comes in blocks of as many pieces as there are open bins, in the order of a hash, and each block's pieces
longest first: so large pieces open bins and small ones fill them, and no piece is placed twice.

Scale: texts are tokenised where they are read; only piece descriptors (about 40 bytes) are shuffled.  Packing
partitions have a constant number of pieces at any input size, and what a task holds are its open bins and one block.
Bins still open at the end of a partition close as they are; since every block has the corpus's mix of lengths, these are
nearly full, too.

Defined results: a null text is an empty document (its only id is the separator); a repeated row is one more document;
a null doc_id is kept as it is; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.llm.common import bounded_batches, staged, text_of

#: Characters on which all pre-tokeniser regex engines agree; any other text takes the tokenizers library itself.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ‐-‧€]*")
PIECES_PER_TASK = 250_000
OPEN_BINS = 4096


@lru_cache(maxsize=4)
def token_encoder(vocabulary: str, ranks: str | None) -> Callable[[str], np.ndarray]:
    """text -> uint32 ids of the tokenizers vocabulary file.

    ranks: the same vocabulary as BPE ranks; texts of plain characters are then encoded by the faster library that
    reads those (same ids, tested), all others by tokenizers.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)

    def exact(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    if not ranks:
        return exact
    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if "<|" not in text and _PLAIN.fullmatch(text):
            return np.array(fast.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)
        return exact(text)

    return encode


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole if they fit, else full pieces after a first that may be shorter."""
    first = n if n <= most else n % most or most
    return [(0, first), *((s, most) for s in range(first, n, most))]


class BestFit:
    """Bounded-space online best-fit; closed bins come back as lists of (item, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.mask, self.count = 0, 0
        self.by_free: list[list[list]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> list:
        at = self.by_free[free]
        found = at.pop()
        if not at:
            self.mask ^= 1 << free
        self.count -= 1
        return found

    def add(self, item, length: int) -> list | None:
        """Place the item; the bin that this closes, if any."""
        closed = None
        room = self.mask >> length
        if room:
            free = length + (room & -room).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.count >= self.most:
                closed = self._take((self.mask & -self.mask).bit_length() - 1)
            free, bin_ = self.capacity, []
        bin_.append((item, self.capacity - free))
        free -= length
        if not free:
            if closed is None:
                return bin_
            self.by_free[0].append(bin_)  # full, goes out with the next close
        else:
            self.by_free[free].append(bin_)
        self.mask |= 1 << free
        self.count += 1
        return closed

    def rest(self) -> Iterator[list]:
        for at in self.by_free:
            yield from at
        self.by_free, self.mask, self.count = [[] for _ in range(self.capacity + 1)], 0, 0


def token_pieces(docs: DataFrame, *, max_tokens: int = 2048, separator: int = 0, vocabulary: str, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    bounded_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_encoder(vocabulary, ranks)
        tail = np.array([separator], dtype="<u4")
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py()), tail]).astype("<u4", copy=False)
                for k, (start, length) in enumerate(cut(len(ids), max_tokens)):
                    part = ids[start : start + length]
                    row = (doc, k, start, length, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] * with_ids))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(run, ddl)


def _packer(schema: pa.Schema, capacity: int, open_bins: int):
    ties = [n for n in schema.names if n not in ("sequence_id", "offset", "ids", "length")]

    def order(row: dict) -> tuple:
        return -row["length"], *((row[n] is None, row[n] or 0) for n in ties)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        bins, made, out, block = BestFit(capacity, open_bins), 0, [], []

        def emit() -> pa.RecordBatch:
            nonlocal out
            rows, out = out, []
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        def close(bin_: list) -> None:
            nonlocal made
            out.extend({**row, "sequence_id": base | made, "offset": offset} for row, offset in bin_)
            made += 1

        def place() -> None:
            for row in sorted(block, key=order):
                done = bins.add(row, row["length"])
                if done:
                    close(done)
            block.clear()

        for batch in batches:
            for row in batch.to_pylist():
                block.append(row)
                if len(block) == open_bins:
                    place()
            if len(out) > 20_000:
                yield emit()
        place()
        for bin_ in bins.rest():
            close(bin_)
        yield emit()

    return run


def pack_pieces(pieces: DataFrame, *, capacity: int = 2048, open_bins: int = OPEN_BINS, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Adds sequence_id and offset to piece descriptors (columns doc_id, piece, length and any others)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = pieces.limit(0).withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    bounded_batches(pieces.sparkSession)
    rows = staged(pieces, "pieces")
    parts = max(1, -(-rows.count() // per_task))
    keyed = rows.withColumn("_h", F.xxhash64("doc_id", "piece")).repartition(parts)  # evenly, whatever repeats
    order = ["_h", *(c for c in pieces.columns if c != "ids")]
    return keyed.sortWithinPartitions(*order).drop("_h").mapInArrow(_packer(to_arrow_schema(shape.schema), capacity, open_bins), shape.schema)


def pack_documents(docs: DataFrame, *, max_tokens: int = 2048, separator: int = 0, vocabulary: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack all documents (see the module's text)."""
    if vocabulary is None:
        vocabulary, ranks = default_vocabulary()
    return pack_pieces(token_pieces(docs, max_tokens=max_tokens, separator=separator, vocabulary=vocabulary, ranks=ranks, with_ids=with_ids), capacity=max_tokens)


def pack(spark, sf_dir: str) -> DataFrame:
    """op1: all documents into sequences of at most 2048 tokens."""
    from strandlab.llm.common import table

    return pack_documents(table(spark, sf_dir, "documents"))
