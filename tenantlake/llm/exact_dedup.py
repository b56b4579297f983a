"""Exact duplicates by a stateful stream, without any Python on the executors.

Two streaming queries follow a folder (or file) of Parquet documents. The first appends one row per document to a log:
its digest, its id and the locator of its content (file and row in the file). The second groups the log by digest in
a state store on disk (RocksDB, saved to the shared folder with every batch): per digest the number of rows, and the
id and locator of the row that stays. There is no watermark, so no key ever expires; a later run goes on from there.

A digest that has been seen before is a hit. The texts of all hits are read again through their locators and compared
in full: rows of one digest whose texts differ are different groups. Only hits are compared, and each task sends each
different text once, so thousands of copies of a text cost a few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tenantlake.llm.common import doc_texts
from tenantlake.session import scratch_path, stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Parquet bytes that one micro-batch of documents, or of the log, takes at most.
BATCH_BYTES = 1 << 40
_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.blockCacheSizeMB": "1",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # a store is small beside what it would reserve
    "spark.sql.streaming.numRecentProgressUpdates": "4",
}


def normalised(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def sha256(text: Column) -> Column:
    """The digest, 32 bytes."""
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


@contextmanager
def _configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings that hold while a stream is started, which takes a copy of them."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class ExactDedup:
    """De-duplication of a growing folder; ``state`` is a folder that holds the log, the state and the checkpoints.

    ``digest`` makes the key from the normalised text. It may be any function of it: texts are compared in full.
    """

    def __init__(self, spark: SparkSession, source: str, state: str, digest: Callable[[Column], Column] = sha256,
                 batch_bytes: int | None = BATCH_BYTES, files_per_batch: int | None = None):
        self.spark, self.source, self.state, self.digest = spark, source.rstrip("/"), state.rstrip("/"), digest
        self.limits = ({"maxBytesPerTrigger": str(batch_bytes)} if files_per_batch is None
                       else {"maxFilesPerTrigger": str(files_per_batch)})

    def _located(self, docs: DataFrame) -> DataFrame:
        return docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text").cast("string")).alias("text"),
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))

    def _stream(self, path: str) -> DataFrame:
        # a pattern that only the path itself fits: a plain path would have to be a folder
        pattern = f"{path[:-1]}[{path[-1]}]" if path == self.source else path
        return self.spark.readStream.schema(self.spark.read.parquet(path).schema).options(**self.limits).parquet(pattern)

    def _digests(self) -> StreamingQuery:
        rows = self._located(self._stream(self.source)).select("doc_id", self.digest(F.col("text")).alias("digest"), "file", "row")
        return (rows.writeStream.format("parquet").option("path", f"{self.state}/log")
                .option("checkpointLocation", f"{self.state}/log-checkpoint").trigger(availableNow=True).start())

    def _keys(self) -> StreamingQuery:
        kept = self._stream(f"{self.state}/log").groupBy("digest").agg(
            F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("rows"))
        # what a batch changed stands in the state store, from where it is read; there is no second copy of it
        return (kept.writeStream.format("noop").outputMode("update")
                .option("checkpointLocation", f"{self.state}/keys").trigger(availableNow=True).start())

    def advance(self) -> ExactDedup:
        """Take in all files that are new since the last time."""
        with _configured(self.spark, _STATE):
            for start in (self._digests, self._keys):
                start().awaitTermination()
        return self

    def log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.state}/log")

    def keys(self) -> DataFrame:
        """(digest, keep, rows) as the state store holds them."""
        with _configured(self.spark, _STATE):
            found = self.spark.read.format("statestore").load(f"{self.state}/keys")
        return found.select("key.digest", F.col("value.max").alias("keep"), F.col("value.count").alias("rows"))

    def _compared(self, keys: DataFrame) -> DataFrame:
        """(digest, text, rows, keep): the different texts of every digest that was hit, with the rows that have them."""
        hits = self.log().join(keys.where("rows > 1").select("digest"), "digest").select("digest", "file", "row")
        texts = self._located(self.spark.read.parquet(self.source))
        return texts.join(hits, ["file", "row"]).groupBy("digest", "text").agg(
            F.count(F.lit(1)).alias("rows"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))

    def members(self) -> DataFrame:
        """One row per document: doc_id, digest, keep (doc_id and locator of the row that stays), rows, kept.

        Fails if a text that a locator names is no longer there, since a hit can't be compared then.
        """
        log, keys = self.log(), stage(self.keys(), "exact-keys")
        compared = stage(self._compared(keys).groupBy("digest").agg(
            F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("texts")), "exact-compared")
        hit = keys.where("rows > 1").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        read, split = compared.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count_if(F.col("texts") > 1)).first()
        if read != hit:
            raise RuntimeError(f"{hit} documents share a digest, but the texts of {read} are found at their locators")
        if not split:
            found = log.join(keys, "digest")
        else:
            # digests of different texts: their rows meet their own text, all others their digest
            apart = compared.where("texts > 1").select("digest")
            places = log.join(apart, "digest", "left_semi")
            own = self._located(self.spark.read.parquet(self.source)).join(places.drop("doc_id"), ["file", "row"])
            texts = stage(self._compared(keys).join(apart, "digest", "left_semi"), "exact-apart")
            own = own.join(texts.withColumnRenamed("digest", "of"), (F.col("digest") == F.col("of")) & (own["text"] == texts["text"]))
            found = log.join(keys, "digest").join(apart, "digest", "left_anti").unionByName(
                own.select("digest", "doc_id", "file", "row", "keep", "rows"))
        return found.select("doc_id", "digest", "keep", "rows",
                            ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))).alias("kept"))


def deduplicated(members: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row, from the members of SHA-256 digests.

    A null text is an empty one. Of equal texts the row with the largest doc_id stays, one without an id only if none
    has one; of rows repeated with that doc_id, one. Repeated rows all count. Empty tables give no rows.
    """
    return members.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("rows").alias("group_size"), "kept",
                          F.lower(F.hex("digest")).alias("text_sha256"))


def exact_duplicates(spark: SparkSession, source: str, state: str | None = None) -> DataFrame:
    """All documents of a Parquet folder or file through the stream, and their groups; see ``deduplicated``."""
    return deduplicated(ExactDedup(spark, source, state or scratch_path(spark, "exact")).advance().members())


def exact_duplicates_of(docs: DataFrame) -> DataFrame:
    """The same for a frame, whose ids and texts are written to the shared folder first."""
    path = scratch_path(docs.sparkSession, "exact-documents")
    doc_texts(docs).write.parquet(path)
    return exact_duplicates(docs.sparkSession, path)
