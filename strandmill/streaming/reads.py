"""Reads as a stream: stateless rules, repeated names with state, counts by event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.names import first_part
from ..operators import lint, validators
from ..plans.runtime import new_folder, ship, tend
from ..sources import files


def stream_reads(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of reads as they appear in a folder; a single file is a stream of one."""
    ship(spark)
    schema = spark.read.parquet(path).schema
    if files.is_file(path):
        path = f"{path[:-1]}[{path[-1]}]"  # as a pattern, which a stream takes where it takes no file
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def lint_stream(reads: DataFrame, level: str = "high", disabled: tuple[str, ...] = (), keys: list[str] | None = None) -> DataFrame:
    """Record rules on a stream: without state, the same Columns as in batch."""
    return lint.single_violations(reads, validators.select(validators.SINGLE, level, disabled), keys)


def windowed_counts(reads: DataFrame, time_col: str, width: str = "1 day", delay: str = "1 day", keys: list[str] | None = None) -> DataFrame:
    """Records per window of event time and key; rows later than ``delay`` are left out once their window is closed.

    Rows without a time belong to no window.
    """
    timed = reads.withColumn(time_col, F.col(time_col).cast("timestamp")).where(F.col(time_col).isNotNull())
    return (
        timed.withWatermark(time_col, delay).groupBy(F.window(time_col, width).alias("w"), *(keys or []))
        .agg(F.count(F.lit(1)).alias("record_count"))
        .select(F.col("w.start").alias("window_start"), *(keys or []), "record_count")
    )


#: A range's state: 128 bits of each name, and when it was last read, in milliseconds.
_STATE = T.StructType([T.StructField(c, T.BinaryType()) for c in ("h1", "h2", "last")])


def repeated_names(reads: DataFrame, order_col: str, time_col: str, delay: str = "7 days", separator: str | None = None, ranges: int = 256) -> DataFrame:
    """First-segment reads whose name came before in the stream: rows ``(name, order_col)``.

    Names are scattered over hash ranges, each with one state: arrays of 24 bytes a name,
    looked up all at once, so Python is called once a range and batch, not once a name.
    A name is dropped when event time has passed its last read by ``delay``.  Reads
    without a time are left out.  ``ranges`` bounds the tasks that can share the work;
    the more names are alive, the more there should be.
    """
    out = T.StructType([T.StructField("name", T.StringType()), T.StructField(order_col, T.LongType())])
    hold = int(pd.Timedelta(delay).total_seconds() * 1000)

    def step(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order_col, kind="stable")
        held = [np.frombuffer(x, dtype=np.int64) for x in (state.get if state.exists else (b"", b"", b""))]
        now = state.getCurrentWatermarkMs()
        alive = held[2] + hold >= now
        new = [rows["h1"].to_numpy(), rows["h2"].to_numpy(), rows[time_col].to_numpy().astype("datetime64[ms]").astype(np.int64)]
        h1, h2, last = (np.concatenate([x[alive], y]) for x, y in zip(held, new))
        order = np.lexsort((np.arange(len(h1)), h2, h1))  # names together, those known before the batch's reads
        h1, h2, last = h1[order], h2[order], last[order]
        first = np.ones(len(h1), dtype=bool)
        first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        latest = np.maximum.reduceat(last, np.flatnonzero(first))
        state.update(tuple(x.tobytes() for x in (h1[first], h2[first], latest)))
        repeats = rows.iloc[np.sort(order[~first]) - int(alive.sum())]
        if len(repeats):
            yield pd.DataFrame({"name": repeats["name"], order_col: repeats[order_col].astype("int64")})

    name = first_part(F.col("definition"), separator)
    named = reads.where((F.col("segment") == 0) & F.col(time_col).isNotNull()).select(
        name.alias("name"), F.xxhash64(name).alias("h1"), F.xxhash64(F.lit("second"), name).alias("h2"), F.pmod(F.xxhash64(name), F.lit(ranges)).alias("range"),
        F.col(order_col).cast("long").alias(order_col), F.col(time_col).cast("timestamp").alias(time_col),
    )
    return named.withWatermark(time_col, delay).groupBy("range").applyInPandasWithState(step, out, _STATE, "append", GroupStateTimeout.NoTimeout)


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and gives its rows as a table in the shared folder.

    In append mode the sink is exactly-once parquet.  In complete mode each batch
    replaces the table.  The table and the stream's state go with the last plan that
    reads them (see runtime.tend()).
    """
    spark = stream.sparkSession
    place = new_folder(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{place}/rows").start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{place}/rows")).start()
    query.awaitTermination()
    return tend(spark.read.schema(stream.schema).parquet(f"{place}/rows"), place)
