"""Device telemetry as a stream: validation, rate limits, links and recoveries. Each has a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: Closed ranges of the numeric fields; own settings.
RANGES = {"lat": (-90.0, 90.0), "lon": (-180.0, 180.0), "value": (0.0, 450.0)}
EARLIEST = 946684800  # 2000-01-01
EVENTS = {"click", "view", "purchase", "signup", "error"}


def error_of(now: Column, tolerance_s: int = 300) -> Column:
    """The first rule that a fix (t_s, lat, lon, value, event) breaks; null if it is good."""
    rules = [("time missing", F.col("t_s").isNull()), ("time before 2000", F.col("t_s") < EARLIEST), ("time in the future", F.col("t_s") > now + tolerance_s), ("no fix", (F.col("lat") == 0) & (F.col("lon") == 0))]
    rules += [(f"{c} out of range", ~F.col(c).between(*b)) for c, b in RANGES.items()]
    rules += [("unknown event", ~F.col("event").isin(*sorted(EVENTS)))]
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def validated(fixes: DataFrame, now: Column, tolerance_s: int = 300) -> DataFrame:
    """Adds error; works on batches and streams alike."""
    return fixes.withColumn("error", error_of(now, tolerance_s))


def link_intervals(events: DataFrame, opens: str, closes: str | None = None) -> DataFrame:
    """device, start, end: an opening event closes the open link, as does a closing one; the last stays open (end null)."""
    kinds = [opens] if closes is None else [opens, closes]
    marks = events.filter(F.col("event").isin(*kinds))
    w = Window.partitionBy("device").orderBy("t_s", "id")
    return marks.withColumn("end", F.lead("t_s").over(w)).filter(F.col("event") == opens).select("device", F.col("id").alias("link_id"), F.col("t_s").alias("start"), "end")


def recoveries(events: DataFrame, arrived: str, recovered: str) -> DataFrame:
    """device, status, t_s: recovered wins over arrived, whatever came first; the time is the latest of its status."""
    marks = events.filter(F.col("event").isin(arrived, recovered)).withColumn("rank", F.when(F.col("event") == recovered, 2).otherwise(1))
    best = marks.groupBy("device").agg(F.max(F.struct("rank", "t_s", "id")).alias("b"), F.count("*").alias("events"))
    return best.select("device", F.when(F.col("b.rank") == 2, "recovered").otherwise("arrived").alias("status"), F.col("b.t_s").alias("t_s"), "events")


class RecoveryProcessor(StatefulProcessor):
    """Keeps for each device the best status so far and emits it whenever a batch brings events; arrived never replaces recovered."""

    def __init__(self, arrived: str, recovered: str) -> None:
        self.arrived, self.recovered = arrived, recovered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "rank int, t_s long, id long, events long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rank, t_s, last, events = self.best.get() if self.best.exists() else (0, 0, 0, 0)
        for pdf in rows:
            for event, t, i in zip(pdf["event"], pdf["t_s"], pdf["id"], strict=True):
                if event in (self.arrived, self.recovered):
                    rank, t_s, last = max((rank, t_s, last), (2 if event == self.recovered else 1, int(t), int(i)))
                    events += 1
        if events:
            self.best.update((rank, t_s, last, events))
            yield pd.DataFrame({"device": [key[0]], "status": ["recovered" if rank == 2 else "arrived"], "t_s": [t_s], "events": [events]})

    def close(self) -> None:
        pass


class RateLimiter(StatefulProcessor):
    """A token bucket for each device on event time: ``rate`` tokens a second up to ``burst``; adds allowed."""

    def __init__(self, rate: float, burst: float) -> None:
        self.rate, self.burst = rate, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens double, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["t_s", "id"])
        tokens, at = self.bucket.get() if self.bucket.exists() else (self.burst, None)
        out = []
        for t in pdf["t_s"].astype(int):
            tokens = min(self.burst, tokens + max(0, t - (t if at is None else at)) * self.rate)
            at = t if at is None else max(at, t)
            out.append(tokens >= 1)
            tokens -= 1 if tokens >= 1 else 0
        self.bucket.update((float(tokens), int(at)))
        yield pd.DataFrame({"device": [key[0]] * len(out), "id": pdf["id"].to_numpy(), "allowed": out})

    def close(self) -> None:
        pass


def recovery_stream(events: DataFrame, arrived: str, recovered: str) -> DataFrame:
    """The stream's twin of :func:`recoveries`: the last row of a device is its status."""
    return events.groupBy("device").transformWithStateInPandas(RecoveryProcessor(arrived, recovered), "device long, status string, t_s long, events long", "Update", "None")


def rate_limited(events: DataFrame, rate: float, burst: float) -> DataFrame:
    return events.groupBy("device").transformWithStateInPandas(RateLimiter(rate, burst), "device long, id long, allowed boolean", "Append", "None")


def limited(events: DataFrame, rate: float, burst: float) -> DataFrame:
    """The batch twin of :func:`rate_limited`."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, at, out = burst, None, []
        pdf = pdf.sort_values(["t_s", "id"])
        for t in pdf["t_s"].astype(int):
            tokens = min(burst, tokens + (0 if at is None else t - at) * rate)
            at = t
            out.append(tokens >= 1)
            tokens -= out[-1]
        return pd.DataFrame({"device": key[0], "id": pdf["id"].to_numpy(), "allowed": out})

    return events.groupBy("device").applyInPandas(run, "device long, id long, allowed boolean")


def changes(events: DataFrame, after: int, most: int) -> DataFrame:
    """The next ``most`` events after an id, oldest first; what a reader that comes back with its last id gets."""
    return events.filter(F.col("id") > after).orderBy("id").limit(most)


def job_stages(log: DataFrame) -> DataFrame:
    """job_id, stage, message, ended of the last event of each job (job_id, seq, type, stage, message); works on streams in complete or update mode too."""
    last = log.groupBy("job_id").agg(F.max(F.struct("seq", "type", "stage", "message")).alias("e"))
    return last.select("job_id", "e.stage", "e.message", F.col("e.type").isin("done", "failed", "cancelled").alias("ended"))


def activity(events: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Counts by event and window of event time; state is bounded by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "event").agg(F.count("*").alias("n"))
