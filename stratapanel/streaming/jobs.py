"""Structured Streaming jobs: quote bars, stops, overlay, incremental upsert, universe events.

State is keyed (position, index, ticker), small per key, and lives in the state store; sinks
are file sinks or idempotent ``foreachBatch`` writes under the shared folder.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratapanel.operators.calendar import interval_gaps, merge_intervals
from stratapanel.sources import scratch


def start(stream: DataFrame, out: str, check: str) -> StreamingQuery:
    """Process what is available into parquet files below ``out``; ``check`` says what was done before."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    )


def run_to_files(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available into a parquet sink and return the result table."""
    spark = stream.sparkSession
    out = scratch.new_path(spark, name)
    start(stream, out, scratch.new_path(spark, f"{name}-checkpoint")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_parts(parts: Sequence[DataFrame], name: str, run: Callable[[DataFrame], StreamingQuery]) -> list[dict]:
    """Let parts of a table arrive one after the other, each as many files, and run a job after each.

    ``run`` starts the job on the stream of all files, with the same checkpoint every time; each run
    spreads its new files over tasks. Returns the last progress of every run.
    """
    spark = parts[0].sparkSession
    path, told = scratch.new_path(spark, name), []
    for part in parts:
        part.write.mode("append").parquet(path)
        q = run(spark.readStream.schema(part.schema).parquet(path))
        q.awaitTermination()
        told.append(q.lastProgress)
    return told


def parts_to_files(parts: Sequence[DataFrame], name: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The result of an append job over parts that arrive one after the other."""
    spark = parts[0].sparkSession
    out, check = scratch.new_path(spark, name), scratch.new_path(spark, f"{name}-checkpoint")
    kinds = []

    def run(stream: DataFrame) -> StreamingQuery:
        made = job(stream)
        kinds.append(made.schema)
        return start(made, out, check)

    run_parts(parts, f"{name}-in", run)
    return spark.read.schema(kinds[0]).parquet(out)


def quote_bars(quotes: DataFrame, size: str = "1 day", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Open, high, low, close and volume per ticker and time window, late rows up to a bound.

    ``quotes(ts, tic, price, size)``. Order inside a window is by time; nothing per row is kept.
    """
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return quotes.withWatermark("ts", late).groupBy(w.alias("w"), "tic").agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"), F.count("*").alias("quotes"),
    ).select(F.col("w.start").alias("start"), "tic", "open", "high", "low", "close", "quotes")


def quote_sessions(quotes: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of quotes of a ticker without a pause longer than the gap."""
    return quotes.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "tic").agg(
        F.count("*").alias("quotes"), F.max("price").alias("high")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "tic", "quotes", "high")


def _by_date(
    stream: DataFrame, keys: Sequence[str], values: Sequence[str], step: Callable, schema: str, late_days: int, idle_days: int,
) -> DataFrame:
    """Fold each key's rows in date order, rows up to ``late_days`` late included, and forget idle keys.

    Rows wait in the state until the watermark is past their date, so whatever batch they come in, they are
    folded in order; later ones are dropped by the engine. ``step(key, memory, date, values)`` returns the new
    memory and the output row or None; key columns after the first come as text. A key without a row for ``idle_days`` of
    event time loses its state. Keys that share the first column (a ticker's positions) share a state and a call, as a
    call costs as much as folding hundreds of rows.
    """
    day = 86_400_000
    at = F.to_timestamp("date")
    own = [f"_key_{k}" for k in keys[1:]]
    timed = stream.withColumns({k: F.col(c).cast("string") for k, c in zip(own, keys[1:], strict=True)})
    timed = timed.withColumns({"_at": at, "_ms": F.unix_millis(at), "_day": F.unix_date(F.to_date("date"))})
    timed = timed.withWatermark("_at", f"{late_days} days").select(keys[0], *own, *values, "_at", "_ms", "_day")
    names = [c.split()[0] for c in schema.split(", ")]
    epoch = dt.date(1970, 1, 1).toordinal()

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = {tuple(k): held for k, *held in json.loads(state.get[0])} if state.exists else {}
        if not state.hasTimedOut:
            for rows in batches:
                for row in zip(*(rows[c].tolist() for c in (*own, "_ms", "_day", *values)), strict=True):
                    kept.setdefault(row[: len(own)], (None, [], 0))[1].append(list(row[len(own) :]))
        mark = state.getCurrentWatermarkMs()
        out, left, alarms = [], [], []
        for rest, (memory, waiting, last) in kept.items():
            due = sorted(r for r in waiting if r[0] < mark)
            waiting = [r for r in waiting if r[0] >= mark]
            for ms, day_number, *row in due:
                memory, made = step((key[0], *rest), memory, dt.date.fromordinal(epoch + day_number), row)
                last = ms
                if made is not None:
                    out.append(made)
            ends = last + idle_days * day
            if waiting or mark <= ends:
                left.append((rest, memory, waiting, last))
                alarms.append(min((r[0] for r in waiting), default=ends))
        if left:
            state.update((json.dumps(left),))
            state.setTimeoutTimestamp(max(min(alarms), mark + 1))
        else:
            state.remove()
        if out:  # many calls put nothing out
            yield pd.DataFrame(out, columns=names)

    return timed.groupBy(keys[0]).applyInPandasWithState(
        fold, schema, "folded string", "append", GroupStateTimeout.EventTimeTimeout
    )


def stop_loss_stream(
    prices: DataFrame, absolute: float = -0.05, trailing: float = -0.10, cooldown_days: int = 20, late_days: int = 7,
    idle_days: int = 60,
) -> DataFrame:
    """Stop signals of a stream of held-position prices; state is peak, end of the quiet time, waiting rows.

    ``prices(tic, entry_date, entry_price, date, close)``, up to ``late_days`` out of order; a signal comes when
    the watermark is past its day. A position without a price for ``idle_days`` is closed and leaves no state.
    """
    quiet = dt.timedelta(days=7 * ((cooldown_days + 6) // 7))

    def step(key: tuple, memory: list | None, date: dt.date, row: list) -> tuple[list, tuple | None]:
        entry, close = row
        peak, until = memory or (entry, None)
        peak = max(peak, close)
        if until is not None and date < dt.date.fromisoformat(until):
            return [peak, until], None
        kind = "absolute" if close / entry - 1 <= absolute else "trailing" if close / peak - 1 <= trailing else None
        if kind is None:
            return [peak, until], None
        until = date + quiet
        opened = None if key[1] is None else dt.date.fromisoformat(key[1])
        return [peak, until.isoformat()], (key[0], opened, date, kind, until)

    schema = "tic string, entry_date date, date date, kind string, cooldown_until date"
    return _by_date(prices, ["tic", "entry_date"], ["entry_price", "close"], step, schema, late_days, idle_days)


def fast_risk_off_stream(
    shocks: DataFrame, duration: int = 10, exit_at: float = 0.01, late_days: int = 7, idle_days: int = 60
) -> DataFrame:
    """Overlay state of a stream of index days; state is days since the trigger, last prices, waiting rows.

    ``shocks(index, date, spx, trigger)``, up to ``late_days`` out of order; a day's state comes when the
    watermark is past it.
    """
    def step(key: tuple, memory: list | None, date: dt.date, row: list) -> tuple[list, tuple]:
        price, hit = row
        gone, p1, p2, p3 = memory or (-1, 0.0, 0.0, 0.0)
        if gone < 0:
            gone, made = (0, (key[0], date, True, duration)) if hit else (-1, (key[0], date, False, 0))
        else:
            gone += 1
            base = p3 if gone >= 4 else p2
            if gone >= duration or (gone >= 3 and price / base - 1 > exit_at):
                gone = -1
            made = (key[0], date, gone >= 0, duration - gone if gone >= 0 else 0)
        return [gone, price, p1, p2], made

    schema = "index string, date date, is_active boolean, days_remaining long"
    return _by_date(shocks, ["index"], ["spx", "trigger"], step, schema, late_days, idle_days)


def news_stream(news: DataFrame, keys: Sequence[str], time: str = "published_datetime", late: str = "1 day") -> DataFrame:
    """Articles of a stream, each key once: what the provider sends again is dropped.

    A key's state is kept until the watermark is ``late`` past it; a repeat that comes after that, and an article
    that is first sent so late, are older than the watermark and dropped too. ``time`` must be one of the keys.
    """
    return news.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def logged_ranges(spark: SparkSession, log: str, before: int) -> DataFrame:
    """Merged intervals (tic, start, end) that the batches before one have fetched."""
    schema = "tic string, start date, end date, rows long"
    parts = [f"{log}/batch={i}" for i in range(before)]
    done = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    return merge_intervals(done, ["tic"])


def incremental_upsert(
    stream: DataFrame, keys: list[str], seq: str, rows: str, log: str, check: str
) -> StreamingQuery:
    """Write what each batch fetches beyond the logged ranges, and log its new ranges; one folder per batch.

    A batch's request is, for each ticker, the span of its dates. Only the parts of it that no earlier batch
    has logged are taken: their rows are written (the last one per key by ``seq``) and each part is logged with
    its number of rows. So a replayed range adds nothing. A batch that runs again reads the log of the
    batches before it only and overwrites its own folders, so the result is the same after a failure.
    ``resolve_upserts`` reads the rows.
    """
    spark = stream.sparkSession
    rest = [c for c in stream.columns if c not in keys]

    def write(batch: DataFrame, batch_id: int) -> None:
        # one row for each key and one for each ticker and day: what the joins with ranges get to see
        last = scratch.cut_lineage(batch.groupBy(*keys).agg(
            F.max_by(F.struct(*rest), seq).alias("r"), F.count("*").alias("_rows")
        ).select(*keys, "r.*", "_rows"), "batch")
        span = last.groupBy("tic").agg(F.min("date").alias("start"), F.max("date").alias("end"))
        known = logged_ranges(spark, log, batch_id)
        gaps = scratch.cut_lineage(interval_gaps(span, known, ["tic"]).select("tic", "start", "end"), "gaps")
        inside = (F.col("g.tic") == F.col("l.tic")) & F.col("l.date").between(F.col("g.start"), F.col("g.end"))
        new = last.alias("l").join(gaps.alias("g"), inside, "left_semi")
        new.drop("_rows").write.mode("overwrite").parquet(f"{rows}/batch={batch_id}")
        counted = gaps.alias("g").join(last.alias("l"), inside, "left").groupBy("g.tic", "g.start", "g.end").agg(
            F.coalesce(F.sum("l._rows"), F.lit(0)).alias("rows")
        )
        counted.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start()


def resolve_upserts(spark: SparkSession, path: str, keys: list[str], seq: str) -> DataFrame:
    """Last write per key over all batches."""
    d = spark.read.parquet(path)
    rest = [c for c in d.columns if c not in (*keys, "batch")]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(seq, "batch")).alias("r")).select(*keys, "r.*")


def universe_event_stream(members: DataFrame, dates: DataFrame, name: str) -> DataFrame:
    """IN and OUT events of a stream of membership rows, keyed by (date, ticker).

    ``members(date, tic)`` is the stream; ``dates(date, next)`` the short table of snapshot dates, each with
    the one after it. A member is present at its date and due at the next one; present but not due means IN,
    due but not present OUT. Rows may come in any order and be spread over batches: flags only go up, so
    each batch writes its groups to a folder of its own (again if it runs again) and the result takes the
    maximum.
    """
    spark = members.sparkSession
    out, check = scratch.new_path(spark, name), scratch.new_path(spark, f"{name}-checkpoint")
    facts = F.array(
        F.struct(F.col("date"), F.lit(1).alias("present"), F.lit(0).alias("due")),
        F.struct(F.col("next").alias("date"), F.lit(0).alias("present"), F.lit(1).alias("due")),
    )
    rows = members.join(dates, "date").select("tic", F.explode(facts).alias("f")).select("tic", "f.*")
    flags = rows.filter(F.col("date").isNotNull()).groupBy("date", "tic").agg(
        F.max("present").alias("present"), F.max("due").alias("due")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = flags.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", check)
    q.trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.parquet(out).groupBy("date", "tic").agg(F.max("present").alias("present"), F.max("due").alias("due"))
    known = seen.join(dates.select(F.col("next").alias("date")), "date", "left_semi")  # the first snapshot has no events
    event = F.when((F.col("present") == 1) & (F.col("due") == 0), "IN").when(F.col("present") == 0, "OUT")
    return known.select("date", "tic", event.alias("event")).filter(F.col("event").isNotNull())
