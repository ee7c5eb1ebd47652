"""Structured Streaming jobs: positions with alerts, and activity.

A job started on a folder that already holds history reads it in its first
batches: the backfill and the refresh are the same code. Use a trigger of ten
minutes for a live job and ``availableNow`` to catch up and stop.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from walletscope.functions.scalars import AMOUNT, instant
from walletscope.operators.joins import LIMITS, JoinLimits, join_by_key
from walletscope.operators.returns import moonshots, with_returns
from walletscope.params import Params
from walletscope.session import materialize, scratch
from walletscope.sources.schemas import TRADES_SIGNED
from walletscope.sources.tables import signed_trades
from walletscope.streaming import alerts
from walletscope.streaming import partials as P

REFRESH = {"processingTime": "10 minutes"}
CATCH_UP = {"availableNow": True}
BUCKETS = 8
ARRIVALS = "arrivals"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_trade_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(TRADES_SIGNED).parquet(folder)


def bucket_of(token: str = "token") -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


class PositionJob:
    """Keeps positions of one stream of trades up to date and records alerts.

    Spark keeps the state: ids of trades already counted, and partial results per
    token, wallet and day. Both leave it by the watermark, a day more than the
    history window behind the newest trade, so late trades inside the window count
    and repeated ones don't. With each batch Spark hands on the keys that changed,
    which go to a table of changes, a folder a batch, split by a hash of the token;
    a repeated batch overwrites its folder.

    The window moves with the data: each batch is evaluated as of the newest trade
    seen so far. Trades later than the clock (the trigger's time, which Spark
    stores with the batch, or a fixed one) are no trades yet: they are counted as
    rejects and left out.
    """

    def __init__(
        self, spark: SparkSession, root: str, params: Params, limits: JoinLimits = LIMITS, clock: datetime | None = None
    ):
        self.spark, self.root, self.params, self.limits, self.clock = spark, root.rstrip("/"), params, limits, clock
        # Empty first entries, so that every table can be read from the start.
        self.schemas = {
            "as_of": "as_of timestamp_ntz",
            "changes": f"{P.SCHEMA}, bucket int",
            "crossings": "kind string, token string, wallet string, above boolean, bucket int",
        }
        for table, schema in self.schemas.items():
            rows = spark.createDataFrame([], schema).write.mode("ignore")
            rows = rows.partitionBy("bucket") if "bucket" in schema else rows
            rows.parquet(f"{self.root}/{table}/batch=-1")

    def _stored(self, table: str, upto: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows of all batches, or of those up to one; of some buckets only."""
        rows = self.spark.read.schema(f"{self.schemas[table]}, batch bigint").parquet(f"{self.root}/{table}")
        rows = rows if upto is None else rows.where(F.col("batch") <= upto)
        return rows if buckets is None else rows.where(F.col("bucket").isin(list(buckets)))

    def _write(self, rows: DataFrame, table: str, batch: int) -> None:
        rows.withColumn("bucket", bucket_of()).write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.root}/{table}/batch={batch}"
        )

    def current(self, upto: int | None = None) -> Params:
        """The parameters as of the newest trade of all batches, or of those up to one."""
        moment = self._stored("as_of", upto).agg(F.max("as_of")).first()[0]
        return self.params if moment is None else self.params.with_(as_of=moment)

    def returns(self) -> DataFrame:
        """Evaluated positions over everything counted so far."""
        params = self.current()
        inside = self._stored("changes").where(F.col("trade_date") >= F.lit(params.window_start.date()))
        return with_returns(P.positions_from_partials(P.latest(inside), params, self.limits))

    def alerts(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{kind}")

    def partials(self, stream: DataFrame) -> DataFrame:
        """The stateful part: each trade once, up to the clock, summed per token, wallet and day."""
        now = F.current_timestamp() if self.clock is None else F.lit(self.clock.isoformat(sep=" ") + "+00:00").cast("timestamp")
        at = P.instant_of("block_time")
        later = F.coalesce(at > now, F.lit(False))
        misfits = {c: F.col(c).isNotNull() & F.col(c).try_cast(AMOUNT).isNull() for c in ("token_amount", "usd_amount")}
        counted = stream.observe(
            ARRIVALS,
            F.count("*").alias("rows"),
            F.count_if(later).alias("later_than_clock"),
            F.count_if(F.col("block_time").isNull()).alias("without_time"),
            *[F.count_if(misfit).alias(f"misfit_{c}") for c, misfit in misfits.items()],
        )
        trades = signed_trades(counted.where(~later)).withColumn("instant", at)
        once = trades.select("*", *P.identity()).withWatermark("instant", f"{self.params.lookback_days + 1} days")
        return P.daily_partials(once.dropDuplicatesWithinWatermark(["id_1", "id_2"]), "instant")

    def process(self, changed: DataFrame, batch: int) -> None:
        """One micro-batch of changed partials. Every output is a folder named by the batch, so a repeat changes nothing."""
        with scratch(self.spark):
            self._process(changed, batch)

    def _as_of(self, changed: DataFrame, batch: int) -> Params:
        newest, before = changed.agg(F.max("last_seen")).first()[0], self.current(upto=batch - 1).as_of if batch else None
        known = [m for m in (newest, before) if m is not None]
        row = self.spark.createDataFrame([(max(known),)] if known else [], self.schemas["as_of"])
        row.write.mode("overwrite").parquet(f"{self.root}/as_of/batch={batch}")
        return self.params.with_(as_of=max(known)) if known else self.params

    def _process(self, changed: DataFrame, batch: int) -> None:
        self._write(changed, "changes", batch)
        mine = self._stored("changes", batch).where(F.col("batch") == batch)
        params = self._as_of(mine, batch)

        # A new price moves every holder of the token: all positions of touched tokens are evaluated.
        touched = materialize(mine.select("token", "bucket").distinct(), "touched")
        buckets = [r[0] for r in touched.select("bucket").distinct().collect()]
        tokens = touched.select("token")

        def of_touched(table: str, upto: int) -> DataFrame:
            return join_by_key(self._stored(table, upto, buckets), tokens, ["token"], "left_semi", limits=self.limits)

        inside = of_touched("changes", batch).where(F.col("trade_date") >= F.lit(params.window_start.date()))
        returns = with_returns(P.positions_from_partials(P.latest(inside), params, self.limits))
        shots = moonshots(returns, params).select("token", "wallet", "invested", "total_pnl", "return_pct")
        shots = materialize(shots, "shots")
        before = materialize(alerts.above(of_touched("crossings", batch - 1)), "above")
        new_shots, new_tokens = alerts.new_moonshots(shots, before), alerts.new_successful_tokens(shots, before, params)
        for kind, found in (("moonshot_alerts", new_shots), ("token_alerts", new_tokens)):
            found.write.mode("overwrite").parquet(f"{self.root}/{kind}/batch={batch}")
        self._write(alerts.crossings(shots, before, params), "crossings", batch)

    def start(self, stream: DataFrame, trigger: dict = REFRESH) -> StreamingQuery:
        if self.spark.conf.get(STATE_STORE, None) != ROCKSDB:
            self.spark.conf.set(STATE_STORE, ROCKSDB)  # state on disk, as large as the history
        # A batch is a delivery; state expires with the next one.
        self.spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
        writer = self.partials(stream).writeStream.outputMode("update").foreachBatch(self.process).trigger(**trigger)
        return writer.option("checkpointLocation", f"{self.root}/progress").start()


def arrivals(query: StreamingQuery) -> dict[str, int]:
    """What a query's recent batches took in and rejected: rows, and rows by reason."""
    total: Counter[str] = Counter()
    for progress in query.recentProgress:
        metrics = progress.observedMetrics.get(ARRIVALS)
        total.update(metrics.asDict() if metrics is not None else {})
    return dict(total)


class ActivityJob:
    """Counts trades per token and hour, and records spikes.

    Counts of a batch are a folder of their own, split by day; they add up in
    any order, so late trades count like others.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        schema = "token string, hour timestamp_ntz, trades bigint"
        rows = spark.createDataFrame([], f"{schema}, day date").write.mode("ignore")
        rows.partitionBy("day").parquet(f"{self.root}/hours/batch=-1")
        self.schema = f"{schema}, batch bigint, day date"

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/hours")

    def activity(self, first: datetime | None = None, last: datetime | None = None) -> DataFrame:
        """(token, hour, trades) of all batches so far; of the hours between two, reading only their days."""
        stored = self._stored()
        for bound, low in ((first, True), (last, False)):
            if bound is not None:
                day, hour = F.lit(bound.date()), instant(bound)
                inside = (F.col("day") >= day, F.col("hour") >= hour) if low else (F.col("day") <= day, F.col("hour") <= hour)
                stored = stored.where(inside[0] & inside[1])
        return stored.groupBy("token", "hour").agg(F.sum("trades").alias("trades"))

    def spikes(self) -> DataFrame:
        """Spikes by what is known now."""
        return alerts.activity_spikes(self.activity())

    def alerts(self) -> DataFrame:
        """Spikes as found with each batch."""
        return self.spark.read.parquet(f"{self.root}/spikes")

    def process(self, raw_batch: DataFrame, batch: int) -> None:
        counted = alerts.hourly_activity(signed_trades(raw_batch)).withColumn("day", F.to_date("hour"))
        counted.write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/hours/batch={batch}")
        mine = self._stored().where(F.col("batch") == batch).select("token", "hour")
        first, last = mine.agg(F.min("hour"), F.max("hour")).first()
        known = self.activity()
        if first is not None:
            # Only the hours of the batch and the trailing hours before them matter.
            known = self.activity(first - timedelta(hours=alerts.TRAILING_HOURS), last)
        found = alerts.activity_spikes(known).join(mine, ["token", "hour"], "left_semi")
        found.write.mode("overwrite").parquet(f"{self.root}/spikes/batch={batch}")

    def start(self, stream: DataFrame, trigger: dict = REFRESH) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.process).trigger(**trigger)
        return writer.option("checkpointLocation", f"{self.root}/progress").start()
