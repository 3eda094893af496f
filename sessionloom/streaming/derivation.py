"""Derivation of stored records in micro-batches: segments, status, dead letters and vectors appear together or not at all.

Every batch writes its tables into a folder of its own attempt, and at last one manifest row that names the attempt. Readers
join the folders with the manifests, so an attempt that failed half-way is never seen, and the next attempt of the batch is seen once. A
batch whose manifest is there is not done again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bloom, sessions

#: After so many failures a record is dead; so many characters of its error are kept.
ATTEMPTS, ERROR_CHARS = 5, 2000
TABLES = {
    "segments": "record_id long, segment long, segment_id long, text string",
    "status": "record_id long, status string, attempts long, error string",
    "waiting": "record_id long, content string, attempts long, error string",
    "embeddings": "segment_id long, input_hash string, embedding array<float>, valid boolean",
    "filters": bloom.FILTER,
}
MANIFEST = "batch long, turn long, attempt string"
#: Room for the segments of a record in their ids.
SEGMENTS = 1 << 20


def chunks(content: Column) -> tuple[Column, Column]:
    """The chunks of a record, a JSON object with its text, and the error where it is none. A record without text has no chunks."""
    body = F.from_json(content, "text string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    good = content.isNotNull() & body["_corrupt"].isNull() & F.coalesce(F.ltrim(content).startswith("{"), F.lit(False))
    text = F.coalesce(body["text"], F.lit(""))
    cut = lambda tokens: F.transform(T.chunk_bounds(F.size(tokens)), lambda b: F.array_join(F.slice(tokens, b["token_start"] + 1, b["token_end"] - b["token_start"]), " "))
    parts = F.transform(F.array(T.tokens(text)), cut)[0]  # the tokens are made once, not for each chunk
    return F.when(good, parts), F.when(~good, F.concat(F.lit("not a transcript: "), F.coalesce(content, F.lit("null"))))


class Derivation:
    """A derivation with its tables under ``base``, which all executors must share.

    ``derive`` gives the segments and the error of a record's content as columns; ``embedder`` turns lists of texts into vectors of
    ``dims`` numbers, and may raise or give vectors that are not valid: those segments stay absent until :meth:`settle`.
    """

    def __init__(self, spark: SparkSession, base: str, embedder: Callable, dims: int, derive: Callable[[Column], tuple[Column, Column]] = chunks) -> None:
        self.spark, self.base, self.embedder, self.dims, self.derive = spark, base, embedder, dims, derive

    def prepare(self) -> Derivation:
        """Empty tables, so that readers find them before the first batch; to be called once."""
        for name, schema in TABLES.items():
            self._write(self.spark.createDataFrame([], schema), name, -1, 0, "none")
        self.spark.createDataFrame([(-1, 0, "none")], MANIFEST).coalesce(1).write.parquet(f"{self.base}/manifests/at=-1-0")
        return self

    def _write(self, df: DataFrame, name: str, batch: int, turn: int, attempt: str) -> DataFrame:
        path = f"{self.base}/{name}/batch={batch}/turn={turn}/attempt={attempt}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def manifests(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.base}/manifests/at=*")

    def table(self, name: str) -> DataFrame:
        """The rows of all attempts that a manifest names, with their batch and turn."""
        rows = self.spark.read.schema(f"{TABLES[name]}, {MANIFEST}").option("basePath", f"{self.base}/{name}").parquet(f"{self.base}/{name}")
        return rows.join(self.manifests(), ["batch", "turn", "attempt"], "left_semi").drop("attempt")

    def status(self) -> DataFrame:
        """The newest status of each record."""
        row = F.struct("status", "attempts", "error")
        return self.table("status").groupBy("record_id").agg(F.max_by(row, F.struct("batch", "turn")).alias("s")).select("record_id", "s.*")

    def absent(self) -> DataFrame:
        """Segments with text that have no valid vector yet."""
        held = self.table("embeddings").where("valid").select("segment_id")
        return self.table("segments").select("segment_id", "text").where(F.trim("text") != "").join(held, "segment_id", "left_anti")

    def _embedded(self, segments: DataFrame) -> DataFrame:
        named = segments.where(F.trim("text") != "").select("segment_id", "text", F.lit(self.dims).alias("dimensions"), F.lit("local").alias("provider"), F.lit("m1").alias("model"))
        return sessions.fill(named, self.embedder, self.dims)

    def _new(self, records: DataFrame) -> DataFrame:
        """Records that no earlier batch has taken, each once. Only the status of batches whose filter may hold one is read."""
        records = records.groupBy("record_id").agg(F.min("content").alias("content"))
        earlier = self.table("filters").select(*[c.split()[0] for c in bloom.FILTER.split(", ")])
        maybe = bloom.candidates(records.select(F.xxhash64("record_id").alias("_key")), earlier).select("owner").distinct()
        taken = self.table("status").join(F.broadcast(maybe.withColumnRenamed("owner", "batch")), "batch", "left_semi")  # a row per batch at most
        return records.join(taken.select("record_id").distinct(), "record_id", "left_anti")

    def apply(self, records: DataFrame, batch: int, turn: int = 0) -> None:
        """One batch of (record_id, content), with the records that wait for another attempt. A function for ``foreachBatch``."""
        if not self.manifests().where((F.col("batch") == batch) & (F.col("turn") == turn)).isEmpty():
            return
        attempt = uuid.uuid4().hex
        write = lambda df, name: self._write(df.select(*[c.split()[0] for c in TABLES[name].split(", ")]), name, batch, turn, attempt)
        last = self.manifests().agg(F.max(F.struct("batch", "turn")).alias("m")).select("m.*")
        waiting = self.table("waiting").join(F.broadcast(last), ["batch", "turn"], "left_semi").select("record_id", "content", F.col("attempts").alias("before"))
        fresh = records.where("record_id IS NOT NULL").select(F.col("record_id").cast("long"), "content")
        if turn == 0:  # later turns bring no new records
            fresh = self._new(fresh)
        todo = fresh.withColumn("before", F.lit(0).cast("long")).unionByName(waiting)
        parts, error = self.derive(F.col("content"))
        done = todo.withColumns({"parts": parts, "error": F.substring(error, 1, ERROR_CHARS)}).withColumn("attempts", F.col("before") + F.when(F.col("error").isNotNull(), 1).otherwise(0))
        state = F.when(F.col("error").isNull(), "derived").when(F.col("attempts") >= ATTEMPTS, "failed").otherwise("captured")
        done = done.withColumn("status", state)
        status = write(done, "status")
        write(done.where("status = 'captured'"), "waiting")
        segments = done.where("error IS NULL").select("record_id", F.posexplode("parts").alias("segment", "text")).withColumn("segment", F.col("segment").cast("long"))
        segments = write(segments.withColumn("segment_id", F.col("record_id") * SEGMENTS + F.col("segment")), "segments")
        write(self._embedded(segments if turn == 0 else segments.select("segment_id", "text").unionByName(self.absent())), "embeddings")
        if turn == 0:
            write(bloom.build(status.select(F.xxhash64("record_id").alias("_key")), F.lit(batch)), "filters")
        self.spark.createDataFrame([(batch, turn, attempt)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.base}/manifests/at={batch}-{turn}")

    def run(self, stream: DataFrame) -> None:
        """All that is available of a stream of records."""
        query = stream.writeStream.option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True).foreachBatch(self.apply).start()
        query.awaitTermination()

    def settle(self, turns: int = ATTEMPTS) -> int:
        """Further turns after the last batch, until no record waits and no segment lacks a vector, ``turns`` at most. Returns how many there were."""
        for n in range(turns):
            last = self.manifests().agg(F.max(F.struct("batch", "turn")).alias("m")).select("m.*").first()
            waits = self.table("waiting").where((F.col("batch") == last.batch) & (F.col("turn") == last.turn))
            if waits.isEmpty() and self.absent().isEmpty():
                return n
            self.apply(self.spark.createDataFrame([], "record_id long, content string"), last.batch, last.turn + 1)
        return turns
