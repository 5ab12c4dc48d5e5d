"""Token counts: delta-maintained rollups.

A change batch is a table of signed rows (source, lang, tokenizer, tokens, sign): an insert is +1, a delete is -1 and a
revised count is the old row at -1 and the new one at +1.  A commit adds the batch up by source, language and tokenizer
version (partial sums before the shuffle, so a hot source costs one row a task), writes these few totals into a folder of
its own, and then creates a marker file named after the batch id and writes into it which folder that is.  The rollup is
the sum over the folders of all batches, so commits are additive, may come in any order, and are idempotent: creating a
marker that is there already fails, on file systems whose create without overwrite is atomic (HDFS; object stores with
conditional writes), also when two writers send the same batch at once.

A writer that dies before its marker leaves nothing that counts; one that dies between creating its marker and writing
into it leaves an empty marker, which doesn't count either: whoever sends the batch again takes over with a marker of the
next number, and of several whole markers of a batch the one with the highest number counts, so a slow writer whose
marker was taken over changes nothing.

compact() merges batches into a snapshot with a numbered marker of its own that lists the ids it holds, so that a batch
that is sent again later is still known; commit() calls it after `compact_after` batches.  Of the snapshots the whole one
with the highest number counts.  A compaction deletes what the snapshot before it held already, and snapshots older than
that, so readers have the time from one compaction to the next but one.  It lists numbers first, batches next, and
creates its marker last: so a snapshot of a higher number holds all that a lower one does, and of two at once that list
the same numbers one creates the marker.  What comes to the driver is one row a batch that isn't compacted yet.

Defined results: null sources and languages are groups of their own; a null text has no tokens; repeated rows count as
often as they come; an empty batch commits empty totals; totals that have gone back to no documents are not shown.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.llm.common import bounded_batches, staged, table, temporary, text_of
from strandlab.llm.mixing import n_words
from strandlab.llm.packing import default_vocabulary, token_encoder

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
WORDS, BPE = "words-1", "byte_bpe_50k-1"
COMPACT_AFTER = 256
_FOLDER = re.compile("data-[0-9a-f]{32}")
#: Before the number of a marker that takes over; can't stand in a quoted batch id.
_AGAIN = "!"


def _marker(batch: str) -> str:
    return f"batch={quote(batch, safe='')}"


def count_words(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens by the provisional word count."""
    return docs.select("doc_id", "source", "lang", F.lit(WORDS).alias("tokenizer"), n_words().alias("tokens"))


def count_tokens(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, version: str = BPE) -> DataFrame:
    """The same by a tokenizers vocabulary, counted where the texts are read."""
    bounded_batches(docs.sparkSession)
    if vocabulary is None:
        vocabulary, ranks = default_vocabulary()
    fields = [("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("tokenizer", pa.string()), ("tokens", pa.int64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_encoder(vocabulary, ranks)
        for b in batches:
            n = [len(encode(t.as_py())) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), b.column(2).cast(pa.string()), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), text_of())
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, tokens long")


def signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(*KEYS, "tokens", F.lit(sign).alias("sign"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """The change rows of counts that replace others."""
    return signed(old, -1).unionByName(signed(new, 1))


class Rollup:
    """Totals by source, language and tokenizer version in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, compact_after: int = COMPACT_AFTER):
        self.spark, self.path, self.compact_after = spark, path.rstrip("/"), compact_after
        self.jvm = spark._jvm  # noqa: SLF001
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
        self.fs.mkdirs(self._at(""))

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, kind: str) -> list[str]:
        names = [x.getPath().getName() for x in self.fs.listStatus(self._at(""))]
        return sorted(n for n in names if n.startswith(f"{kind}="))

    def _mark(self, name: str, folder: str) -> bool:
        """Create the marker and say the folder in it; False if there is one."""
        try:
            out = self.fs.create(self._at(name), False)
        except Py4JJavaError as e:
            if self.fs.exists(self._at(name)):
                return False
            raise e
        out.write(bytearray(folder.encode()))
        out.close()
        return True

    def _folders(self, names: list[str]) -> dict[str, str]:
        """marker -> folder, of the markers whose writers have finished."""
        if not names:
            return {}
        rows = self.spark.read.text([f"{self.path}/{n}" for n in names], wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").collect()
        return {unquote(r["name"]): r["value"] for r in rows if _FOLDER.fullmatch(r["value"])}

    def _batches(self, names: list[str]) -> dict[str, str]:
        """batch's first marker -> folder that counts: that of the whole marker with the highest number."""
        found: dict[str, tuple[int, str]] = {}
        for name, folder in self._folders(names).items():
            batch, _, attempt = name.partition(_AGAIN)
            found[batch] = max(found.get(batch, (-1, "")), (int(attempt or 0), folder))
        return {batch: folder for batch, (_, folder) in found.items()}

    def _snapshots(self, names: list[str]) -> list[tuple[int, str]]:
        """Numbers and folders of the two newest whole snapshots, newest first."""
        found: list[tuple[int, str]] = []
        for name in reversed(names):
            found += [(int(n.removeprefix("snapshot=")), f) for n, f in self._folders([name]).items()]
            if len(found) == 2:
                break
        return found

    def _held(self, batches: list[str], snapshot: str | None) -> set[str]:
        """Which of the batches the snapshot holds."""
        if not batches or not snapshot:
            return set()
        return {r["batch"] for r in self.spark.read.parquet(f"{self.path}/{snapshot}/covers").where(F.col("batch").isin(batches)).collect()}

    def _newest(self) -> str | None:
        return next((f for _, f in self._snapshots(self._names("snapshot"))), None)

    def has(self, batch: str) -> bool:
        """Is the batch committed?"""
        return self._known(batch)

    def _known(self, batch: str) -> bool:
        name = _marker(batch)
        return bool(self._batches([n for n in self._names("batch") if n.partition(_AGAIN)[0] == name]) or self._held([name], self._newest()))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes; False, without reading them, if the batch is there already."""
        if self.has(batch):
            return False
        folder = f"data-{uuid.uuid4().hex}"
        totals = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("n_tokens"))
        totals.coalesce(1).write.parquet(f"{self.path}/{folder}")  # a few totals, summed up already
        name, attempt = _marker(batch), 0
        while not self._mark(name + (f"{_AGAIN}{attempt}" if attempt else ""), folder):
            if self._known(batch):
                self.fs.delete(self._at(folder), True)
                return False
            attempt += 1
        if len(self._names("batch")) >= self.compact_after:
            self.compact()
        return True

    def _open(self, snapshot: str | None) -> dict[str, str]:
        """Batches (and folders) that the snapshot doesn't hold."""
        folders = self._batches(self._names("batch"))
        held = self._held(list(folders), snapshot)
        return {n: f for n, f in folders.items() if n not in held}

    def _sum(self, folders: dict[str, str], snapshot: str | None) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders.values()] + [f"{self.path}/{snapshot}/totals"] * bool(snapshot)
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        snapshot = self._newest()
        return self._sum(self._open(snapshot), snapshot)

    def compact(self) -> bool:
        """Put all batches into a snapshot; False if there was none, or another compaction came first."""
        names = self._names("snapshot")
        known = self._snapshots(names)
        last = known[0][1] if known else None
        folders = self._open(last)
        if not folders:
            return False
        number = int(names[-1].removeprefix("snapshot=")) + 1 if names else 1
        folder = f"data-{uuid.uuid4().hex}"
        self._sum(folders, last).coalesce(1).write.parquet(f"{self.path}/{folder}/totals")
        covers = self.spark.createDataFrame([(n,) for n in sorted(folders)], "batch string")
        if last:
            covers = covers.unionByName(self.spark.read.parquet(f"{self.path}/{last}/covers"))
        covers.coalesce(1).write.parquet(f"{self.path}/{folder}/covers")
        if not self._mark(f"snapshot={number:012d}", folder):
            self.fs.delete(self._at(folder), True)
            return False
        self._forget(known)
        return True

    def _forget(self, known: list[tuple[int, str]]) -> None:
        """Delete the batches that the snapshot before held, and the snapshots before that one."""
        if not known:
            return
        last = known[0]
        markers = self._names("batch")
        held = self._held(sorted({n.partition(_AGAIN)[0] for n in markers}), last[1])
        mine = [n for n in markers if n.partition(_AGAIN)[0] in held]
        old = [n for n in self._names("snapshot") if int(n.removeprefix("snapshot=")) < last[0]]
        for name, folder in (self._folders(mine) | self._folders(old)).items():
            self.fs.delete(self._at(folder), True)
            self.fs.delete(self._at(name), False)
        for name in mine + old:  # those that were left empty
            self.fs.delete(self._at(name), False)


def token_counts(spark, sf_dir: str) -> DataFrame:
    """op7: totals after three batches: every document inserted with its word count; every count revised by the byte
    BPE vocabulary; the documents labelled low quality deleted.  The second batch is sent twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = Rollup(spark, temporary(spark, "rollup"))
    counts = staged(count_tokens(docs), "counts")
    rollup.commit("1", signed(count_words(docs), 1))
    for _ in range(2):
        rollup.commit("2", revised(count_words(docs), counts))
    low = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    rollup.commit("3", signed(counts.join(low, "doc_id", "left_semi"), -1))
    return rollup.totals()
