"""Bursts of empty flows over a stream of closed sessions: one counter per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wireloom.functions.scalars import MICROS
from wireloom.functions.shipping import ship
from wireloom.operators.sessions import SESSION_KEY
from wireloom.operators.zero_byte import BURST_KEY, ZERO_SPAN_US, exact_rate, zero_byte_sessions
from wireloom.streaming import require_rocksdb

ship(__name__)

STATE = "count bigint, first_us bigint, last_us bigint"
OUTPUT = (
    "flow_id string, session_no bigint, src_ip string, dst_ip string, dst_port int, proto string, "
    "close_us bigint, zero_byte_count bigint, zero_byte_rate double"
)
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


class BurstProcessor(StatefulProcessor):
    def __init__(self, min_count: int, max_rate: float, idle_us: int):
        self.min_count, self.idle_us = min_count, idle_us
        self.num, self.den = exact_rate(max_rate)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counter = handle.getValueState("counter", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        count, first, last = self.counter.get() if self.counter.exists() else (0, None, None)
        out = []
        batch = pd.concat(list(rows)).sort_values(["us", *SESSION_KEY])
        for flow_id, number, us in zip(batch["flow_id"], batch["session_no"], batch["us"]):
            us = int(us)
            if last is None or us - last > self.idle_us:
                count, first = 0, us
            count, last = count + 1, us
            span = (us - first) or ZERO_SPAN_US
            if count >= self.min_count and count * MICROS * self.den > span * self.num:
                out.append((flow_id, int(number), *key, us, count, count * float(MICROS) / span))
                count = 0
        self.counter.update((count, first, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.idle_us) // 1000 + 1)
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counter.clear()
        yield pd.DataFrame([], columns=COLUMNS)

    def close(self) -> None:
        pass


def stream_bursts(
    sessions: DataFrame,
    min_count: int = 3,
    max_rate: float = 1.0,
    idle_seconds: float = 600,
    watermark: str = "30 seconds",
) -> DataFrame:
    """Burst alerts of a stream of closed sessions (batch twin: ``zero_byte_bursts``)."""
    require_rocksdb(sessions.sparkSession)
    flows = (
        zero_byte_sessions(sessions)
        .withColumn("proto", F.coalesce("proto", F.lit("")))
        .withColumn("dst_port", F.col("dst_port").cast("int"))
        .withWatermark("close_ts", watermark)
        .withColumn("us", F.unix_micros("close_ts"))
        .select(*SESSION_KEY, *BURST_KEY, "us", "close_ts")
    )
    return flows.groupBy(*BURST_KEY).transformWithStateInPandas(
        statefulProcessor=BurstProcessor(min_count, max_rate, int(idle_seconds * MICROS)),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="EventTime",
    )
