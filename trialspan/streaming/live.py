"""Window features and scores on arriving samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKETS = 128  # groups of trials that share a state


def replay(spark: SparkSession, path: str, schema: T.StructType | str, ts: str = "ts", files_per_trigger: int = 1,
           token: str | None = None, keep: Sequence[str] = (), fmt: str = "parquet", bytes_per_trigger: int | None = None) -> DataFrame:
    """Recorded samples as a stream, one device's columns only if ``token`` is given.

    A micro-batch takes ``files_per_trigger`` files, or, if given, files of ``bytes_per_trigger`` together; its fixed cost
    (all state partitions are opened and committed) then comes once for so much data and not once a file. The arrival of files takes the place of paced sending; ``ts`` becomes the event time (times
    without a zone are read as UTC).
    """
    bound = ("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else ("maxFilesPerTrigger", files_per_trigger)
    df = spark.readStream.schema(schema).format(fmt).option(*bound).load(path)
    if token:
        df = df.select(*[F.col(f"`{c}`") for c in df.columns if token in c or c in keep or c == ts])
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        micros = f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{ts}`)"
        return df.withColumn(ts, F.expr(f"timestamp_micros({micros})"))
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def _bucket(key: str, buckets: int) -> Column:
    """Hash bucket of a trial; the one without a key has its own, so keys keep their type in pandas."""
    c = F.col(f"`{key}`")
    return F.when(c.isNull(), -1).otherwise(F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int"))


def ffill_stream(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str],
                 leftover: float = 0.0, buckets: int = BUCKETS) -> DataFrame:
    """Carry the last value of a trial forward across micro-batches; what is missing becomes 0.

    Trials share a state by hash ``buckets``, so a task calls Python once for many of them. The state is a table of one row
    a trial, with a value per column; a micro-batch bounds what one task sees.
    """
    out = df.select(key, *order, *[F.col(c).cast("double").alias(c) for c in cols])
    state = T.StructType([T.StructField("last", T.BinaryType())])

    def fill(k: tuple, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        held = _unpacked(bytes(st.get[0])).to_pandas() if st.exists else None
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(list(order), kind="stable")
        pdf, last = carried(pdf, held, key, list(cols))
        st.update((_packed(pa.Table.from_pandas(last, preserve_index=False)),))
        yield pdf.fillna({c: leftover for c in cols})[[key, *order, *cols]]

    return out.withColumn("__bucket", _bucket(key, buckets)).groupBy("__bucket").applyInPandasWithState(
        fill, out.schema, state, "append", GroupStateTimeout.NoTimeout)


def carried(pdf: pd.DataFrame, held: pd.DataFrame | None, key: str, cols: list[str]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Ordered rows of many trials with the last values carried forward, after those of ``held``; and the last values then.

    ``held`` and the second frame have a row a trial: ``key`` and ``cols``. A trial without a key is one of its own.
    """
    before = pdf.iloc[:0] if held is None else held
    rows = pd.concat([before[[key, *cols]].astype(pdf[[key, *cols]].dtypes), pdf[[key, *cols]]], ignore_index=True) if len(before) else pdf[[key, *cols]]
    trial = pd.factorize(rows[key], use_na_sentinel=False)[0]
    filled = rows[cols].groupby(trial).ffill()
    last = pd.concat([rows[[key]], filled], axis=1)[~pd.Series(trial, index=rows.index).duplicated(keep="last")]
    out = pdf.copy()
    out[cols] = filled.to_numpy()[len(before):]
    return out, last.reset_index(drop=True)


def close_recording(spark: SparkSession, path: str, schema: T.StructType | str, ts: str, beyond: str, fmt: str = "parquet") -> None:
    """Append two closing files to a finished recording; each holds one row with nothing but a time, ``beyond`` its last.

    The first lets the watermark pass everything recorded, the second makes a micro-batch that sees it. Event-time
    operators here skip such rows, so all windows and rows that still wait come out.
    """
    rows = spark.read.schema(schema).format(fmt).load(path)
    last = rows.agg(F.max(ts).alias(ts)).withColumn(ts, F.expr(f"`{ts}` + interval {beyond}"))
    kinds = dict(rows.dtypes)
    for _ in range(2):
        (last.select(*[(F.col(ts) if c == ts else F.lit(None)).cast(kinds[c]).alias(c) for c in rows.columns])
         .coalesce(1).write.mode("append").format(fmt).save(path))


def carries(df: DataFrame, ts: str) -> Column:
    """Whether a row has anything but a time; closing rows have not."""
    return F.coalesce(*[F.col(f"`{c}`").cast("string") for c in df.columns if c != ts]).isNotNull()


def merged(moments: Column) -> Column:
    """Count, mean and sum of squared deviations of several sets together, from those of each; nothing cancels."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        share = b["n"].cast("double") / n
        return F.struct(n.alias("n"), (a["mean"] + apart * share).alias("mean"),
                        (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"))

    return F.aggregate(F.filter(moments, lambda x: x["n"] > 0), zero, add)


def sliding_stats_stream(df: DataFrame, key: str, ts: str, cols: Sequence[str], length: str, stride: str,
                         lateness: str) -> DataFrame:
    """Sliding mean, population deviation, max and range per trial on a stream.

    Two chained aggregations: samples into panes of one stride, panes into windows, so a sample
    is never copied length / stride times; a window merges the moments of its panes, which are few. Rows behind the
    watermark are dropped; in append mode a window appears once the watermark has passed it (``close_recording``
    lets it pass the last ones). On a table the same call gives the windows at once.
    """
    aggs, merge, out = [F.count_if("__real").alias("__rows")], [F.sum("__rows").alias("__rows")], []
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`").cast("double")
        n = F.count(v)
        aggs += [F.struct(n.alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * n).alias("m2")).alias(f"m{i}"),
                 F.max(v).alias(f"x{i}"), F.min(v).alias(f"i{i}")]
        merge += [merged(F.collect_list(f"m{i}")).alias(f"m{i}"), F.max(f"x{i}").alias(f"x{i}"), F.min(f"i{i}").alias(f"i{i}")]
        m, x, lo = (F.col(f"{a}{i}") for a in "mxi")
        some = m["n"] > 0
        dev = F.when(x == lo, 0.0).when(some, F.sqrt(m["m2"] / m["n"]))
        out += [F.when(some, m["mean"]).alias(f"{c}_mean"), dev.alias(f"{c}_stddev"), x.alias(f"{c}_max"), (x - lo).alias(f"{c}_range")]
    rows = df.withColumn("__real", carries(df, ts)).withWatermark(ts, lateness)
    panes = rows.groupBy(F.window(ts, stride).alias("pane"), key).agg(*aggs)
    windows = panes.groupBy(F.window(F.window_time("pane"), length, stride).alias("w"), key).agg(*merge).where("__rows > 0")
    return windows.select(key, F.col("w.start").alias("t_begin"), F.col("w.end").alias("t_end"), *out)


def window_scores_stream(df: DataFrame, key: str, ts: str, cols: Sequence[str], length: str, stride: str, lateness: str,
                         model: PipelineModel, fill: float = 0.0) -> DataFrame:
    """Scores of closed windows: panes, window features, then a model that was fitted on such features and loaded.

    A feature without any value in its window is ``fill``, as it has to be in training (``window_features``).
    """
    return model.transform(window_features(df, key, ts, cols, length, stride, lateness, fill))


def window_features(df: DataFrame, key: str, ts: str, cols: Sequence[str], length: str, stride: str, lateness: str,
                    fill: float = 0.0) -> DataFrame:
    """Features of all windows, of a table to train on or of a stream to score."""
    stats = sliding_stats_stream(df, key, ts, cols, length, stride, lateness)
    return stats.na.fill(fill, feature_names(cols))


def feature_names(cols: Sequence[str]) -> list[str]:
    return [f"{c}_{stat}" for c in cols for stat in ("mean", "stddev", "max", "range")]


class CarryForward(StatefulProcessor):
    """Buffers the rows of a bucket of trials by slices of event time, and fills a slice once the watermark has passed its end.

    The rows that a micro-batch adds to a slice are one value (an Arrow table); a timer stands at each slice's end. What is
    carried on is a row a trial: the last value of each column, and the end of its last slice. A trial that is quiet for
    ``idle`` microseconds is forgotten.
    """

    def __init__(self, key: str, ts: str, order: list[str], cols: list[str], slice_us: int, idle_us: int | None, leftover: float):
        self.key, self.ts, self.order, self.cols = key, ts, order, cols
        self.slice_us, self.idle_us, self.leftover = slice_us, idle_us, leftover

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice long, part int", "rows binary")
        self.parts = handle.getMapState("parts", "slice long", "n int")
        self.last = handle.getValueState("last", "rows binary")

    def handleInputRows(self, key, rows, timerValues):
        frames = [pdf[pdf["real"]].drop(columns=["real", "bucket"]) for pdf in rows]
        pdf = pd.concat(frames, ignore_index=True) if frames else None
        if pdf is None or not len(pdf):
            return iter(())
        at = pdf[self.ts].to_numpy().astype("datetime64[us]").astype("int64") // self.slice_us
        for s, some in pdf.groupby(at):
            s = int(s)
            n = self.parts.getValue((s,))[0] if self.parts.containsKey((s,)) else 0
            if not n:
                self.handle.registerTimer((s + 1) * self.slice_us // 1000)
            self.waiting.updateValue((s, n), (_packed(pa.Table.from_pandas(some, preserve_index=False)),))
            self.parts.updateValue((s,), (n + 1,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        # all slices that end by now, in order, whatever the order of timers
        due = sorted(k[0] for k in self.parts.keys() if (k[0] + 1) * self.slice_us <= now)
        if not due:
            return
        held = _unpacked(bytes(self.last.get()[0])).to_pandas() if self.last.exists() else None
        for s in due:
            end = (s + 1) * self.slice_us
            if held is not None and self.idle_us is not None:
                held = held[held["seen"] + self.idle_us >= end]
            n = self.parts.getValue((s,))[0]
            tables = [_unpacked(bytes(self.waiting.getValue((s, i))[0])) for i in range(n)]
            pdf = pa.concat_tables(tables, promote_options="permissive").to_pandas().sort_values(self.order, kind="stable")
            pdf[self.cols] = pdf[self.cols].astype("float64")
            pdf, last = carried(pdf, held, self.key, self.cols)
            last["seen"] = end
            if held is not None:
                quiet = held[~held[self.key].isin(pdf[self.key])]
                last = pd.concat([last[~last[self.key].isin(quiet[self.key])], quiet], ignore_index=True)
            held = last
            for i in range(n):
                self.waiting.removeKey((s, i))
            self.parts.removeKey((s,))
            yield pdf.fillna(dict.fromkeys(self.cols, self.leftover))
        self.last.update((_packed(pa.Table.from_pandas(held, preserve_index=False)),))

    def close(self) -> None:
        pass


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_all()


def ffill_events(df: DataFrame, key: str, ts: str, cols: Sequence[str], lateness: str, tie: Sequence[str] = (),
                 leftover: float = 0.0, slice_seconds: float = 60.0, idle_seconds: float | None = None,
                 buckets: int = BUCKETS) -> DataFrame:
    """Carry the last value of a trial forward in event-time order, however rows arrive within ``lateness``.

    Trials share a state by hash ``buckets``. Rows wait in disk-backed state until the watermark passes the end of their
    slice, so a task holds one slice of a bucket at a time. What is missing before the first value becomes ``leftover``. Rows behind the watermark are
    dropped. With ``idle_seconds`` a trial quiet for that long is forgotten and starts anew.
    """
    spark = df.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kept = df.select(key, ts, *[F.col(f"`{c}`") for c in tie], *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    # plain names inside: state and rows travel as named tuples
    n, plain = len(kept.columns), [f"c{i}" for i in range(len(kept.columns))]
    first = n - len(cols)
    made = CarryForward(plain[0], plain[1], plain[1:first], plain[first:], int(slice_seconds * 1e6),
                        None if idle_seconds is None else int(idle_seconds * 1e6), leftover)
    rows = kept.withColumn("real", carries(kept, ts)).toDF(*plain, "real").withColumn("bucket", _bucket("c0", buckets)).withWatermark("c1", lateness)
    out = T.StructType([T.StructField(p, f.dataType) for p, f in zip(plain, kept.schema)])
    return rows.groupBy("bucket").transformWithStateInPandas(made, out, "append", "EventTime").toDF(*kept.columns)


def score_stream(df: DataFrame, model: PipelineModel, fill: Sequence[str] = ()) -> DataFrame:
    """Score arriving rows with a saved model."""
    ready = df.na.fill(0.0, list(fill)) if fill else df
    return model.transform(ready)


def run_to_parquet(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available into Parquet and stop."""
    query = (df.writeStream.outputMode(mode).format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
