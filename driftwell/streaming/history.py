"""The history features of an entity as a stateful stream.

A row waits in its entity's state until the watermark has passed its time, for more rows of that time may come, in this batch or
another.  Then the time is closed: its rows are answered from the state before any of them is added, so they don't see each
other, however the stream was cut into batches.  Rows at or before an entity's last closed time are late: they are given out
with late = true and change nothing, or stop the query in strict mode.  Rows of unknown entities, and rows without a time, are
given out at once, their features null.  A row without TransactionID is an end marker: it moves the watermark and is no
transaction.

The state of an entity is one row: sums, the first values it has been seen with, and the newest times of the last day.  Further
values have a row each, and further times of the last day too, by number.  Two cursors, an hour and a day behind, move along the
numbers and take what the day's has passed away, so a batch costs its own rows, however much history there is, and an entity of
few rows one read and one write: every call to the state waits for the JVM, and rows are few, so they are plain Python values.
(Spark's time to live is by the clock of the machine, which a replay doesn't follow.)
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import batched, chain
from math import floor, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = (
    "TransactionID long, TransactionDT double, late boolean, prior_transaction_count long, prior_mean_amount double, prior_std_amount double, prior_count_1h long, prior_count_24h long, "
    "seconds_since_previous double, history_span_days double, prior_distinct_products long, entity_product_is_new double, entity_hour_probability double, "
    "prior_distinct_email_domains long, entity_email_is_new double, prior_distinct_devices long, entity_device_is_new double"
)
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
#: What an entity has been seen with: the column, and the names of its count and of what is new.
RELATIONS = {"ProductCD": ("prior_distinct_products", "entity_product_is_new"), "P_emaildomain": ("prior_distinct_email_domains", "entity_email_is_new"), "DeviceInfo": ("prior_distinct_devices", "entity_device_is_new")}
_ROW = {"TransactionID": "long", "TransactionDT": "double", "TransactionAmt": "double"} | dict.fromkeys(RELATIONS, "string")
#: Rows, mean and squared deviations of amounts, first and last time, number of the next time, and for each cursor its number and the
#: rows behind it; then counts of hours of the day and of different values, values by relation, and the newest times with their rows.
_SUMS = (
    "n long, mean double, m2 double, first double, last double, next long, hour_at long, hour_rows long, day_at long, day_rows long, hours array<long>, different array<long>, "
    "values array<array<string>>, times array<double>, rows array<long>"
)
_EMPTY = (0, 0.0, 0.0, None, None, 0, 0, 0, 0, 0, [0] * 24, [0] * len(RELATIONS), [[] for _ in RELATIONS], [], [])
#: Values of a relation, and times, in an entity's own row.
INLINE = 64
HOUR, DAY = 3600.0, 86_400.0
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A row of the stream as one array of texts, and answers as one value: Spark hands over each cell of a group by itself.
_PACKED, _ANSWERS, _AT_ONCE = "row", "answers binary", 10_000
_Answers = Row("answers")


def _read(cells: list) -> tuple:
    """A row of _ROW."""
    return int(cells[0]), float(cells[1]), float(cells[2]), *cells[3:]


def _packed(rows: Iterator[tuple]) -> Iterator[Row]:
    for some in batched(rows, _AT_ONCE):
        yield _Answers(pickle.dumps(some, pickle.HIGHEST_PROTOCOL))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed answers as rows of OUTPUT."""
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    shape = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in OUTPUT.split(", "))])
    rows = chain.from_iterable(pickle.loads(x.as_py()) for batch in batches for x in batch.column(0))
    for some in batched(rows, _AT_ONCE):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), shape)], schema=shape)


def _timer(time: float) -> int:
    """The millisecond from which on ``time`` is over."""
    return floor(time * 1000) + 1


class _History(StatefulProcessor):
    def __init__(self, strict: bool):
        self.strict = strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", _SUMS)
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} {k}" for c, k in _ROW.items()))
        self.seen = handle.getMapState("seen", "relation int, value string", "time double")
        self.times = handle.getMapState("times", "number long", "time double, rows long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        sums, new, late = self.sums.get(), [], []
        last = sums[4] if sums else None
        for row in (_read(x[_PACKED]) for x in rows):
            if last is None or row[1] > last:
                new.append(row)
                continue
            if self.strict:
                raise ValueError(f"late rows of {key}: {row[1]} is not after {last}")
            late.append((row[0], row[1], True, *[None] * (len(_NAMES) - 3)))
        yield from _packed(late)
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(_timer(min(r[1] for r in new)))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        rows, now = list(self.waiting.get()), timerValues.getCurrentWatermarkInMs()
        over = [r for r in rows if _timer(r[1]) <= now]
        if not over:
            return
        if rest := [r for r in rows if _timer(r[1]) > now]:
            self.waiting.put([tuple(r) for r in rest])
            self.handle.registerTimer(_timer(min(r[1] for r in rest)))
        else:
            self.waiting.clear()
        yield from _packed(self._closed(sorted(over, key=lambda r: (r[1], r[0]))))

    def _closed(self, rows: list[tuple]) -> Iterator[tuple]:
        """The answers to rows of whole times in their order; the state is that after them."""
        n, mean, m2, start, last, number, hour_at, hour_rows, day_at, day_rows, hours, different, values, times, counts = self.sums.get() or _EMPTY
        hours, different, values, times, counts = list(hours), list(different), [list(v) for v in values], list(times), list(counts)
        inline = stored = number - len(times)  # numbers from here on are in the lists; those from ``day_at`` to here have rows of their own
        known = [dict.fromkeys(v, True) for v in values]

        def at(i: int) -> tuple[float, int]:
            return (times[i - inline], counts[i - inline]) if i >= inline else self.times.getValue((i,))

        def is_known(r: int, value: str) -> bool:
            if value not in known[r]:
                known[r][value] = different[r] > INLINE and self.seen.containsKey((r, value))
            return known[r][value]

        i = 0
        while i < len(rows):
            time, begin = rows[i][1], i
            while i < len(rows) and rows[i][1] == time:
                i += 1
            while hour_at < number and (there := at(hour_at))[0] < time - HOUR:
                hour_at, hour_rows = hour_at + 1, hour_rows + there[1]
            while day_at < number and (there := at(day_at))[0] < time - DAY:
                if day_at < stored:
                    self.times.removeKey((day_at,))
                day_at, day_rows = day_at + 1, day_rows + there[1]
            phase = int(time // HOUR) % 24
            shared = (
                n, mean if n else None, sqrt(max(m2 / n, 0.0)) if n >= 2 else None, n - hour_rows, n - day_rows, None if last is None else time - last, (time - start) / DAY if n else None,
            )
            probability, before, fresh = (hours[phase] + 1) / (n + 24) if n else None, tuple(different), []
            for row in rows[begin:i]:
                new = []
                for r, value in enumerate(row[3:]):
                    is_new = None
                    if value is not None:
                        is_new = 0.0 if is_known(r, value) else 1.0
                        if is_new:
                            fresh.append((r, value))
                    new.append(is_new if before[r] else None)
                yield (row[0], time, False, *shared, before[0], new[0], probability, before[1], new[1], before[2], new[2])
            for r, value in fresh:
                if not known[r][value]:
                    known[r][value] = True
                    different[r] += 1
                    if len(values[r]) < INLINE:
                        values[r].append(value)
                    else:
                        self.seen.updateValue((r, value), (time,))
            for row in rows[begin:i]:
                n += 1
                off = row[2] - mean
                mean += off / n
                m2 += off * (row[2] - mean)
            hours[phase] += i - begin
            times.append(time)
            counts.append(i - begin)
            start, last, number = time if start is None else start, time, number + 1
        # The newest times stay in the row; older ones of the last day get rows of their own, those that have passed go.
        keep = max(day_at, number - INLINE)
        for old in range(max(day_at, inline), keep):
            self.times.updateValue((old,), at(old))
        self.sums.update((n, mean, m2, start, last, number, hour_at, hour_rows, day_at, day_rows, hours, different, values, times[keep - inline :], counts[keep - inline :]))


def history_stream(stream: DataFrame, key: list[str], strict: bool = False, delay: str = "0 seconds") -> DataFrame:
    """Features of a stream of transactions (TransactionID, TransactionDT, TransactionAmt, ProductCD, P_emaildomain,
    DeviceInfo and the key columns).

    A row comes out when a row has been seen, in an earlier batch, whose time is later by more than ``delay``; rows of one time may
    come in any batches until then.  What is later than the last time of a finite stream is only an end marker, a row with a
    TransactionDT and no TransactionID (``replay`` writes one).  Rows without a complete key have no history and are no one's:
    they come out at once with null features, never late.  Null amounts count as 0.  List and map state need the RocksDB store;
    the session is set to it.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    have = F.lit(True)
    for k in key:
        have = have & F.col(k).isNotNull()
    cast = {c: F.col(c).cast(k) for c, k in _ROW.items()} | {"TransactionAmt": F.coalesce(F.col("TransactionAmt").cast("double"), F.lit(0.0))}
    rows = stream.select(*key, *[c.alias(n) for n, c in cast.items()]).withColumn("_at", F.timestamp_seconds("TransactionDT")).withWatermark("_at", delay)
    # One expression that needs the event time: else its parts would be applied before the watermark, which then missed rows.
    kind = F.when(F.col("_at").isNull(), "unknown").when(F.col("TransactionID").isNull(), "marker").when(have, "known").otherwise("unknown")
    # Without the event time Spark has nothing to drop late rows by: they are told instead.
    rows = rows.withColumn("_kind", kind).drop("_at")
    kinds = dict(stream.dtypes)
    # The key as one text; adding 0 makes -0 and 0 the same.
    one = F.to_json(F.struct(*[(F.col(k) + F.lit(0.0) if kinds[k] in ("double", "float") else F.col(k)).alias(k) for k in key])).alias("_key")
    known = rows.where("_kind = 'known'").select(one, F.array(*[F.col(c).cast("string") for c in _ROW]).alias(_PACKED))
    known = known.groupBy("_key").transformWithState(_History(strict), _ANSWERS, "append", "EventTime").mapInArrow(_unpacked, OUTPUT)
    given = {"TransactionID": F.col("TransactionID"), "TransactionDT": F.col("TransactionDT"), "late": F.lit(False)}
    columns = [c.split() for c in OUTPUT.split(", ")]
    return known.unionByName(rows.where("_kind = 'unknown'").select(*[given.get(c, F.lit(None)).cast(k).alias(c) for c, k in columns]))


def end_marker(df: DataFrame, time: str = "TransactionDT", after: float = 1.0) -> DataFrame:
    """One row of nulls, but for a time ``after`` seconds beyond the last of ``df``; none if ``df`` has no times."""
    last = df.agg(F.max(time).alias("_last")).where("_last is not null")
    return last.select(*[((F.col("_last") + after) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])


def replay(df: DataFrame, folder: str, parts: int, time: str = "TransactionDT") -> DataFrame:
    """Writes ``df`` in ranges of time in ascending order, an end marker last, and reads them as a stream, one range a batch.

    Every range is as many files as each of them has rows for, so that large ones are written and read by many tasks.  Rows without a
    time go with the first range.
    """
    from driftwell.operators.prefix import RANGE_ROWS, cuts_of, range_of

    cuts = cuts_of(df, time, parts)
    placed = df.withColumn("_part", F.coalesce(range_of(time, cuts), F.lit(0)))
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}  # one row a range
    files = max(1, min(sizes.values(), default=0) // RANGE_ROWS)
    for i in sorted(sizes):
        placed.where(F.col("_part") == i).drop("_part").repartition(files).write.mode("overwrite").parquet(f"{folder}/part={i:05d}")
    end_marker(df, time).write.mode("overwrite").parquet(f"{folder}/part={parts:05d}")
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(folder)


def tumbling(stream: DataFrame, time: str, width: str = "1 day", late: str = "0 seconds") -> DataFrame:
    """Rows and sums by window of event time, late rows dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("rows"), F.sum("TransactionAmt").alias("amount"))
