"""Causal features of generated streams against a plain history that looks through all earlier rows."""

from __future__ import annotations

import math
import pickle
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftwell.operators import history
from driftwell.sources.tables import TRANSACTION

NAMES = TRANSACTION.fieldNames()
START = "2031-05-07T21:30:00-04:00"


def stream(seed: int, n: int, entities: int = 3, span: int = 12 * 86_400) -> list[dict]:
    """Rows in order of time with many ties, gaps of minutes to days, and anything missing now and then."""
    rnd = random.Random(seed)
    maybe = lambda v, share=0.15: None if rnd.random() < share else v
    times = sorted(rnd.choice([rnd.randrange(span), rnd.randrange(span // 3600) * 3600, 7 * 3600 + rnd.randrange(3) * 1800]) for _ in range(n))
    rows = []
    for i, t in enumerate(times):
        e = rnd.randrange(entities)
        rows.append(
            {
                "TransactionID": 7000 + i * 3, "TransactionDT": float(t), "TransactionAmt": rnd.choice([0.0, round(rnd.uniform(3, 80), 2), 31.5]), "card1": float(e), "card2": 8.5, "card3": 4.0, "card5": maybe(2.0, 0.08), "addr1": maybe(float(e % 2), 0.08),
                "card4": maybe(rnd.choice(["amber", "birch"])), "ProductCD": maybe(rnd.choice("PQR")), "P_emaildomain": maybe(rnd.choice(["left.test", "right.test"])), "R_emaildomain": maybe(rnd.choice(["left.test", "up.test"])),
                "DeviceInfo": maybe(rnd.choice(["tablet", "kiosk", "watch"]), 0.4), "has_identity": rnd.random() < 0.5,
            }
        )
    return rows


def as_tuples(rows: list[dict]) -> list[tuple]:
    return [tuple(r[n] for n in NAMES) for r in rows]


def expected(rows: list[dict], row: dict, reference: str | None) -> dict:
    """All features of one row, from the definitions."""
    t, x, day = row["TransactionDT"], row["TransactionAmt"], 86_400
    key = lambda r: tuple(r[p] for p in history.ENTITY_PARTS)
    known = None not in key(row)
    earlier = [r for r in rows if r["TransactionDT"] < t]
    own = [r for r in earlier if known and key(r) == key(row)]
    n, amounts = len(own), [r["TransactionAmt"] for r in own]
    mean = sum(amounts) / n if n else None
    spread = math.sqrt(sum((a - mean) ** 2 for a in amounts) / n) if n >= 2 else None
    relative = x / mean if n and mean > 0 else None
    days = (t - min(r["TransactionDT"] for r in own)) / day if n else None
    phase = int(t // 3600) % 24
    out = {
        "amount": x, "log_amount": math.log1p(x), "relative_day": t // day, "hour_phase": phase, "hour_sin": math.sin(2 * math.pi * (t % day) / day), "hour_cos": math.cos(2 * math.pi * (t % day) / day),
        "has_identity": row["has_identity"], "entity_known": known, "prior_transaction_count": n if known else None, "prior_mean_amount": mean, "prior_std_amount": spread, "amount_to_prior_mean": relative,
        "amount_zscore": (x - mean) / spread if n >= 5 and spread > 1e-12 else None, "prior_count_1h": sum(r["TransactionDT"] >= t - 3600 for r in own) if known else None,
        "prior_count_24h": sum(r["TransactionDT"] >= t - day for r in own) if known else None, "seconds_since_previous": t - own[-1]["TransactionDT"] if n else None, "history_span_days": days,
        "entity_hour_probability": (sum(int(r["TransactionDT"] // 3600) % 24 == phase for r in own) + 1) / (n + 24) if n else None, "prior_global_count": len(earlier),
        "history_sufficient": n >= 5, "frequent_entity": n >= 20 and days >= 7, "usual_amount": None if n < 5 or relative is None else 2 / 3 <= relative <= 1.5,
        "email_domains_match": None if None in (row["P_emaildomain"], row["R_emaildomain"]) else row["P_emaildomain"] == row["R_emaildomain"], "calendar_available": reference is not None,
    }
    for plural, name, column in (("products", "product", "ProductCD"), ("email_domains", "email", "P_emaildomain"), ("devices", "device", "DeviceInfo")):
        seen = {r[column] for r in own} - {None}
        out[f"prior_distinct_{plural}"] = len(seen) if known else None
        out[f"entity_{name}_is_new"] = None if row[column] is None or not seen else row[column] not in seen
    for name, parts in (("product", ["ProductCD"]), ("email", ["P_emaildomain"]), ("device", ["DeviceInfo"]), ("product_card", ["ProductCD", "card4"]), ("email_pair", ["P_emaildomain", "R_emaildomain"])):
        value = lambda r, parts=parts: tuple(r[p] for p in parts)
        there = None not in value(row)
        same, all_of = sum(value(r) == value(row) for r in earlier), sum(None not in value(r) for r in earlier)
        out[f"{name}_prior_frequency"] = same / all_of if there and all_of else None
        if len(parts) == 2:
            out[f"{name}_prior_support"] = same if there else None
    local = datetime.fromisoformat(reference).replace(tzinfo=None) + timedelta(seconds=t) if reference else None
    out |= {"hour": local.hour, "day_of_week": local.weekday(), "is_weekend": local.weekday() > 4, "is_business_hours": local.weekday() < 5 and 9 <= local.hour < 17} if local else dict.fromkeys(("hour", "day_of_week", "is_weekend", "is_business_hours"))
    return out


def agrees(got, want: dict, columns) -> None:
    for c in columns:
        g, w = got[c], want[c]
        assert (g is None and w is None) or (g is not None and w is not None and math.isclose(g, w, rel_tol=1e-7, abs_tol=1e-9)), (got.TransactionID, c, g, w)


@pytest.mark.parametrize(("seed", "reference"), [(1, START), (2, None)])
def test_features_equal_plain_history(spark, seed, reference):
    rows = stream(seed, 170)
    got = {r.TransactionID: r for r in history.features(spark.createDataFrame(as_tuples(rows), TRANSACTION), reference).collect()}
    assert len(got) == len(rows)
    for row in rows:
        agrees(got[row["TransactionID"]], expected(rows, row, reference), history.FEATURES)
    seen = [expected(rows, r, reference) for r in rows]
    assert any(e["frequent_entity"] for e in seen) and any(e["prior_count_1h"] for e in seen) and any(e["entity_device_is_new"] for e in seen)
    with pytest.raises(ValueError):
        history.features(spark.createDataFrame(as_tuples(rows[:1]), TRANSACTION), "2031-05-07T21:30:00")


def test_future_rows_change_nothing(spark):
    rows = stream(5, 60)
    cut = next(i for i in range(30, 60) if rows[i]["TransactionDT"] > rows[i - 1]["TransactionDT"])
    short, whole = ({r.TransactionID: r for r in history.features(spark.createDataFrame(as_tuples(part), TRANSACTION)).collect()} for part in (rows[:cut], rows))
    for i, r in short.items():
        agrees(whole[i], r.asDict(), history.FEATURES)


def test_codes_of_any_type_are_one_entity(spark):
    rows = [r for r in stream(6, 40) if r["card5"] and r["addr1"] is not None]
    a = spark.createDataFrame(as_tuples(rows), TRANSACTION)
    b = a.withColumns({"card1": F.col("card1").cast("long"), "addr1": F.col("addr1").cast("int").cast("string")})
    counts = [{r.TransactionID: r.prior_transaction_count for r in history.features(x).collect()} for x in (a, b)]
    assert counts[0] == counts[1] and max(counts[0].values()) > 3


@pytest.mark.parametrize("seed", [21, 22])
def test_hot_entities_are_shared_by_many_tasks(spark, seed):
    """One entity with half of all rows, cut by time: the same features as by windows, and no window over the entity."""
    rows = stream(seed, 260, 2)
    for r in rows[::2]:
        r.update(card1=50.0, card5=2.0, addr1=1.0)
    for r in rows[20:26]:
        r["TransactionDT"] = rows[20]["TransactionDT"]
    keyed = history.row_features(history.with_keys(spark.createDataFrame(as_tuples(rows), TRANSACTION)))
    times = sorted(r["TransactionDT"] for r in rows)
    got = history.entity_features(keyed, sorted({times[i] for i in range(15, 260, 15)}), 60)
    names = [c for c in history.FEATURES if c in got.columns]
    found = {r.TransactionID: r for r in got.collect()}
    assert len(found) == len(rows)
    for row in rows:
        agrees(found[row["TransactionID"]], expected(rows, row, None), names)
    cold = {r.TransactionID: r for r in history.entity_features(keyed).select("TransactionID", *names).collect()}
    for i, r in cold.items():
        agrees(found[i], r.asDict(), names)


def test_empty(spark):
    assert history.features(spark.createDataFrame([], TRANSACTION)).count() == 0


STREAMED = (
    "prior_transaction_count", "prior_mean_amount", "prior_std_amount", "prior_count_1h", "prior_count_24h", "seconds_since_previous", "history_span_days", "entity_hour_probability", "prior_distinct_products",
    "entity_product_is_new", "prior_distinct_email_domains", "entity_email_is_new", "prior_distinct_devices", "entity_device_is_new",
)


def run(stream_df, path: str) -> None:
    stream_df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def test_stream_equals_plain_history(spark, tmp_path):
    from driftwell.streaming.history import history_stream, replay

    rows = stream(11, 90)
    run(history_stream(replay(spark.createDataFrame(as_tuples(rows), TRANSACTION), f"{tmp_path}/in", 4), list(history.ENTITY_PARTS)), str(tmp_path))
    got = {r.TransactionID: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == len(rows) and not any(r.late for r in got.values())
    for row in rows:
        agrees(got[row["TransactionID"]], expected(rows, row, None), STREAMED)


def put(spark, folder: str, rows: list[dict]) -> None:
    """One file, which is one batch."""
    spark.createDataFrame(as_tuples(rows), TRANSACTION).coalesce(1).write.parquet(folder)


def source(spark, root: str, *names: str):
    return spark.readStream.schema(TRANSACTION).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{root}/{{{','.join(names)}}}")


def marker(time: float) -> dict:
    """The end of a stream: a time without a transaction."""
    return dict.fromkeys(NAMES) | {"TransactionDT": time}


def test_late_rows_are_told_or_stop_the_stream(spark, tmp_path):
    """A batch that is refused leaves the state as it was: the same stream goes on when the late rows are gone."""
    from driftwell.streaming.history import history_stream

    rows = [r for r in stream(12, 40, 1) if r["card5"] and r["addr1"] is not None]
    middle, times = len(rows) // 2, [r["TransactionDT"] for r in rows]
    while times[middle] == times[middle - 1]:
        middle += 1
    late = {**rows[0], "TransactionID": 1}
    put(spark, f"{tmp_path}/a", [*rows[:middle], marker(times[middle - 1] + 0.01)])
    put(spark, f"{tmp_path}/b", [late, *rows[middle:], marker(times[-1] + 0.01)])
    for strict in (False, True):
        path = f"{tmp_path}/{strict}"
        run(history_stream(source(spark, tmp_path, "a"), list(history.ENTITY_PARTS), strict), path)
        if strict:
            with pytest.raises(Exception, match="late rows"):
                run(history_stream(source(spark, tmp_path, "a", "b"), list(history.ENTITY_PARTS), strict), path)
            done = spark.read.parquet(f"{path}/out").collect()
            assert {r.TransactionID for r in done} == {r["TransactionID"] for r in rows[:middle]}
        else:
            run(history_stream(source(spark, tmp_path, "a", "b"), list(history.ENTITY_PARTS), strict), path)
            got = {r.TransactionID: r for r in spark.read.parquet(f"{path}/out").collect()}
            assert got[1].late and got[1].prior_transaction_count is None and len(got) == len(rows) + 1
            for row in rows:
                agrees(got[row["TransactionID"]], expected(rows, row, None), STREAMED)


def test_times_may_be_split_over_batches(spark, tmp_path):
    """Files cut anywhere, a time in three of them, rows of a file in any order: the same features as over all rows at once."""
    from driftwell.streaming.history import history_stream

    rows = sorted(stream(15, 80, 2, 86_400), key=lambda r: r["TransactionDT"])
    for r in rows[30:42]:
        r["TransactionDT"] = rows[30]["TransactionDT"]
    rnd = random.Random(1)
    cuts = [0, 17, 33, 36, 39, 41, 60, 80]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = rows[a:b]
        rnd.shuffle(part)
        put(spark, f"{tmp_path}/{i}", part)
    put(spark, f"{tmp_path}/end", [marker(rows[-1]["TransactionDT"] + 1)])
    run(history_stream(source(spark, tmp_path, *map(str, range(len(cuts) - 1)), "end"), list(history.ENTITY_PARTS)), str(tmp_path))
    got = {r.TransactionID: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == len(rows) and not any(r.late for r in got.values())
    for row in rows:
        agrees(got[row["TransactionID"]], expected(rows, row, None), STREAMED)


def test_rows_wait_for_the_watermark(spark, tmp_path):
    """Nothing of a time comes out before a later one by the delay; rows out of order within it are in their place; no time, no key."""
    from driftwell.streaming.history import history_stream

    whole = [{**r, "TransactionDT": i // 3 * 250.5} for i, r in enumerate(stream(16, 60, 1)) if r["card5"] and r["addr1"] is not None]
    start, end = whole[0]["TransactionDT"], whole[-1]["TransactionDT"]
    first = [r for r in whole if r["TransactionDT"] < (start + end) / 2]
    held = first[3::4]
    put(spark, f"{tmp_path}/a", [r for r in first if r not in held])
    put(spark, f"{tmp_path}/b", [*held, *[r for r in whole if r not in first], {**whole[0], "TransactionID": 2, "TransactionDT": None}, {**whole[0], "TransactionID": 3, "card1": None}])
    stream_of = lambda *names: history_stream(source(spark, tmp_path, *names), list(history.ENTITY_PARTS), delay="2 hours")
    run(stream_of("a"), str(tmp_path / "s"))
    assert spark.read.schema("TransactionID long").parquet(f"{tmp_path}/s/out").count() == 0
    run(stream_of("a", "b"), str(tmp_path / "s"))
    assert {r.TransactionID for r in spark.read.parquet(f"{tmp_path}/s/out").collect()} == {2, 3}
    put(spark, f"{tmp_path}/end", [marker(end + 7_201)])
    run(stream_of("a", "b", "end"), str(tmp_path / "s"))
    got = {r.TransactionID: r for r in spark.read.parquet(f"{tmp_path}/s/out").collect()}
    assert len(got) == len(whole) + 2 and got[2].prior_transaction_count is None and not got[2].late
    for row in whole:
        agrees(got[row["TransactionID"]], expected(whole, row, None), STREAMED)


def test_full_stream_equals_batch(spark, sf):
    """Every event comes out once, unknown entities with null features, e-mail domains and devices too."""
    from driftwell.plans import queries

    got = {r.TransactionID: r for r in queries.full_stream_history(spark, sf).collect()}
    want = queries.entity(spark, sf).collect()
    assert len(got) == len(want) and set(got) == {r.TransactionID for r in want}
    unknown = [got[r.TransactionID] for r in want if not r._known]
    assert unknown and all(v is None for g in unknown for k, v in g.asDict().items() if k not in ("TransactionID", "late")) and not any(g.late for g in unknown)
    for r in want:
        for c in ("prior_transaction_count", "prior_count_24h", *(f"prior_distinct_{x}" for x in ("products", "email_domains", "devices")), *(f"entity_{x}_is_new" for x in ("product", "email", "device"))):
            assert got[r.TransactionID][c] == r[c], c


GLOBAL = ("prior_global_count", *(f"{n}_prior_frequency" for n in history.FREQUENCIES), "product_card_prior_support", "email_pair_prior_support")


def test_global_counts_equal_plain_history(spark, tmp_path):
    """Batch by batch, one sent twice; the totals are few tables and a refused batch changes none."""
    from driftwell.streaming import global_counts

    rows = stream(13, 80)
    cuts = [0, *sorted(i for i in random.Random(3).sample(range(1, 80), 9) if rows[i]["TransactionDT"] > rows[i - 1]["TransactionDT"]), 80]
    parts = [spark.createDataFrame(as_tuples(rows[a:b]), TRANSACTION) for a, b in zip(cuts, cuts[1:])]
    root = f"file://{tmp_path}/g"
    handle = global_counts.counting(root)
    for n, part in enumerate(parts):
        handle(part, n)
        if n == 2:
            handle(part, n)
    got = {r.TransactionID: r for r in spark.read.parquet(*[f"{root}/features/batch-{n}" for n in range(len(parts))]).collect()}
    for row in rows:
        agrees(got[row["TransactionID"]], expected(rows, row, None), GLOBAL)
    before = global_counts.state(spark, root, len(parts))
    assert len(before[1]) <= 4
    with pytest.raises(ValueError):
        handle(parts[0], len(parts))
    assert global_counts.state(spark, root, len(parts) + 1) == before


def test_tumbling_windows(spark, tmp_path):
    from driftwell.streaming.history import tumbling

    rows = stream(14, 70)
    timed = spark.createDataFrame(as_tuples(rows), TRANSACTION).select(F.timestamp_seconds("TransactionDT").alias("at"), "TransactionAmt")
    timed.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(timed.schema).parquet(f"{tmp_path}/in")
    tumbling(source, "at").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    want: dict[int, list[float]] = {}
    for r in rows:
        want.setdefault(int(r["TransactionDT"] // 86_400), []).append(r["TransactionAmt"])
    got = {int(r.window.start.timestamp() // 86_400): (r.rows, round(r.amount, 6)) for r in spark.table("days").collect()}
    assert got == {d: (len(v), round(sum(v), 6)) for d, v in want.items()}


class _State:
    """One entity's state of every kind, without Spark; it counts the calls, each of which waits for the JVM."""

    def __init__(self):
        self.one, self.list, self.map, self.calls = None, [], {}, 0

    def _call(self, value=None):
        self.calls += 1
        return value

    def getValueState(self, *_):
        return self

    getListState = getMapState = getValueState

    def get(self):
        return self._call(self.one)

    def update(self, value):
        self._call()
        self.one = value

    def getValue(self, key):
        return self._call(self.map[key])

    def containsKey(self, key):
        return self._call(key in self.map)

    def updateValue(self, key, value):
        self._call()
        self.map[key] = value

    def removeKey(self, key):
        self._call()
        del self.map[key]


class _Waiting(_State):
    def get(self):
        return iter(self._call(list(self.list)))

    def appendList(self, rows):
        self._call()
        self.list += rows

    def put(self, rows):
        self._call()
        self.list = list(rows)

    def clear(self):
        self._call()
        self.list = []

    def registerTimer(self, _):
        self._call()


@pytest.mark.parametrize("inline", [2, 64])
def test_an_entity_of_few_rows_is_one_read_and_one_write(monkeypatch, inline):
    """values and times in the entity's own row, and those beyond it in rows of their own, tell the same."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    from driftwell.streaming import history as streaming

    monkeypatch.setattr(streaming, "INLINE", inline, raising=False)
    rows = [r for r in stream(31, 120, 1, 4 * 86_400) if r["card5"] and r["addr1"] is not None]
    one, sums, waiting, seen, times = streaming._History(False), _State(), _Waiting(), _State(), _State()
    one.init(SimpleNamespace(getValueState=lambda *_: sums, getListState=lambda *_: waiting, getMapState=lambda name, *_: {"seen": seen, "times": times}[name], registerTimer=waiting.registerTimer))
    got, batches = {}, 0
    for i in range(0, len(rows), 12):
        part = [Row(row=["0.0" if c == "TransactionAmt" and r[c] is None else None if r[c] is None else str(r[c]) for c in streaming._ROW]) for r in rows[i : i + 12]]
        assert not list(one.handleInputRows(("key",), iter(part), None))
        following = rows[i + 12]["TransactionDT"] if i + 12 < len(rows) else math.inf
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda end=following: 10**15 if end == math.inf else math.floor(end * 1000))
        answers = [Row(*streaming._NAMES)(*r) for x in one.handleExpiredTimer(("key",), now, None) for r in pickle.loads(x.answers)]
        got |= {r.TransactionID: r for r in answers}
        batches += 1
    assert len(got) == len(rows)
    for row in rows:
        agrees(got[row["TransactionID"]], expected(rows, row, None), STREAMED)
    calls = sums.calls + waiting.calls + seen.calls + times.calls
    assert (seen.map and times.map and len(sums.one[-1]) <= 2) if inline == 2 else calls <= 8 * batches and not seen.map and not times.map
