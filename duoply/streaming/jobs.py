"""Live forms of attention time, edit replay, ingest and status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duoply.config import ATTENTION_SECONDS
from duoply.operators.review import triage
from duoply.sources.readings import parse_readings, records
from duoply.sources.shared import kept
from duoply.streaming import states


def replayed(spark: SparkSession, df: DataFrame, path: str, files: int = 1) -> DataFrame:
    """A stream over the rows of df, written to a folder first; one micro-batch for `files` files."""
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


#: Rows of a file that dealt() writes.
DEALT_ROWS = 1_000_000


def dealt(spark: SparkSession, df: DataFrame, path: str, *keys: str | Column, batches: int = 3) -> DataFrame:
    """A stream over the rows of df, dealt by keys (or in turn) to about `batches` micro-batches; each has files for all cores and none of more than DEALT_ROWS rows."""
    n = batches * spark.sparkContext.defaultParallelism
    df.repartition(n, *keys).write.option("maxRecordsPerFile", DEALT_ROWS).parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // batches)).parquet(path)


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Everything a stream gives until its source is empty, as a table. In update mode every micro-batch's rows are kept with their batch number."""
    out, schema = f"{path}/out", stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/b={number}")

    return _run(stream, keep, path, schema.add("_batch", "long"), mode)


def _run(stream: DataFrame, keep: Callable[[DataFrame, int], None], path: str, schema, mode: str = "append") -> DataFrame:
    """The table below path/out after keep() has written there, micro-batch by micro-batch, all that the source has now."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return stream.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/out")


def _stateful(rows: DataFrame, key: str, processor, schema: str, time: str = "none") -> DataFrame:
    states.use_rocksdb(rows.sparkSession)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", time)


def attention(rows: DataFrame, seconds: int = ATTENTION_SECONDS, late: str = "1 day") -> DataFrame:
    """(operator_id, open_game, seconds) for each gap between an operator's interactions, once the watermark has passed its end (states.Attention). Interactions in any order within the watermark count as in order, across micro-batches too; later ones are dropped. rows(operator_id, ts, open_game, event_id)."""
    timed = rows.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late).withColumn("us", F.unix_micros("event_time"))
    return _stateful(timed, "operator_id", states.Attention(seconds), states.Attention.schema, "eventtime")


def edits(rows: DataFrame) -> DataFrame:
    """(game_id, seq, accepted, length) of each edit, applied in order of seq; entries that come early wait in the state (states.Edits). rows(game_id, seq, op, pos, event_id), seq from 1."""
    return _stateful(rows, "game_id", states.Edits(), states.Edits.schema)


def ingest(rows: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Rows of new files, each key once: repeats within the watermark are ignored. rows have landed_at."""
    return rows.withWatermark("landed_at", late).dropDuplicatesWithinWatermark(keys)


def ingest_readings(spark: SparkSession, path: str, files: int = 100, late: str = "1 day") -> DataFrame:
    """Cells (as sources.readings.read_readings) of reading files as they land below a folder, at most `files` a micro-batch.

    A file is known by its name, size and time of change: if it lands again
    within `late` of its last record, elsewhere below the folder, it gives
    nothing; a changed file gives all its cells again. The state holds a row for
    each record (game and sheet) and is spread by record, so a file may hold
    millions of them.
    """
    source = spark.readStream.option("recursiveFileLookup", "true").option("lineSep", "\x1e").option("maxFilesPerTrigger", files).schema("value string").text(path)
    file = F.col("_metadata")
    found = records(source, F.struct(file["file_name"].alias("name"), file["file_size"].alias("size"), file["file_modification_time"].alias("changed")).alias("file"))
    rows = found.withColumns({"landed_at": F.current_timestamp(), "name": F.col("file.name"), "size": F.col("file.size"), "changed": F.col("file.changed"), "digest": F.xxhash64("value")})
    return parse_readings(ingest(rows, ["name", "size", "changed", "_game", "_sheet", "digest"], late))


def status(rows: DataFrame) -> DataFrame:
    """(game_id, status, reports): the latest status of each game as reports arrive (update mode). rows(game_id, status, seq)."""
    return rows.groupBy("game_id").agg(F.max_by("status", "seq").alias("status"), F.count("*").alias("reports"))


def status_totals(rows: DataFrame, path: str) -> DataFrame:
    """(status, games, _batch): how many games have each status after each micro-batch. rows(game_id, status, seq), seq as text that sorts.

    States hold each game's latest status (states.Status); a change takes the
    game from one total to the other. A micro-batch reads its own reports and
    the totals before it, one row a status; no history.
    """
    spark, out = rows.sparkSession, f"{path}/out"
    schema = "status string, games long, _batch long"

    def keep(batch: DataFrame, number: int) -> None:
        steps = batch.groupBy("status").agg(F.sum("step").alias("games"))
        if number:
            steps = steps.union(spark.read.schema(schema).parquet(f"{out}/b={number - 1}").select("status", "games")).groupBy("status").agg(F.sum("games").alias("games"))
        steps.withColumn("_batch", F.lit(number).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{out}/b={number}")

    return _run(_stateful(rows, "game_id", states.Status(), states.Status.schema), keep, path, schema)


def retriaged(fixes: DataFrame, path: str) -> DataFrame:
    """(game_id, tier, reason, _batch): as fixes arrive, the triage of every game that a micro-batch has reports of, over all its reports so far; the last row of a game is its state. What triage needs of a game's reports is kept in the state (states.Reports), one row a method and ply, so a micro-batch reads those of its own games only, and neither its size nor that of the state depends on how often they are reported; tasks condense reports before they are shuffled."""
    kinds = "game_id long, method string, ply long, san string, similarity double, status string"
    rows = fixes.select(*(F.col(n).cast(t) for n, t in (c.split() for c in kinds.split(", ")))).mapInArrow(states.first_condensed, kinds)

    def keep(batch: DataFrame, number: int) -> None:
        # triage reads its rows several times, a micro-batch's states are to be run once
        triage(kept(batch)).withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/out/b={number}")

    return _run(_stateful(rows, "game_id", states.Reports(kinds), kinds), keep, path, "game_id long, tier string, reason string, _batch long")
