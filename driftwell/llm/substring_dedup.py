"""Removal of byte strings of 50 bytes and more that an earlier document has, without sorting every suffix.

Blockwise suffix sorting with a difference cover keeps a sample of positions such that any two suffixes reach sampled
positions after equally many bytes, sorts one bucket of suffixes at a time and settles long ties by ranks in the sample.
Here only strings of ``length`` bytes matter, so ties end there and a cover chosen by content serves better than one
chosen by position: in every ``length``-byte window the smallest hash of a ``seed``-byte string marks one cover
position.  Equal windows have it at the same place, so they meet in the same bucket; a modular cover has to keep 5 of 21
positions for that, this one about 1 of 14.

1. Each document's cover positions go to buckets by seed hash.  A position stands for the run of windows that chose it;
   equal runs have equal run hashes, and all but those of the smallest doc_id are removed.
2. Seeds that different runs share (the edges of repeated passages) are settled window by window: the windows of one
   instance of each such run go to buckets by window hash, in the same way.
3. The intervals meet their documents again, and what is left of each text is kept.

Positions travel packed, one row for each bucket and Arrow batch.  A batch first settles what it can by itself: of equal
runs the smallest goes on, and of many different runs with one seed only two, the others being known to be edges.  So a
passage that a third of all documents have, or a seed inside their near copies, arrives a few times a batch at most, not once
a document.
The number of buckets follows the bytes of the corpus, so that a bucket's size doesn't.

Strings are compared by 112 bits of two independent polynomial hashes, not byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import textkernel as tk
from driftwell.llm.scratch import Scratch, settings


@dataclass(frozen=True)
class SubstringDedup:
    """Strings of ``length`` bytes; cover positions by the smallest hash of ``seed`` bytes (length - seed < 200).

    From ``edge_runs`` different runs of one seed on, a batch settles them by itself; the results are the same.
    """

    length: int = 50
    seed: int = 25
    edge_runs: int = 8


#: One cover position on its way: seed hash, run hash in two parts, row of the batch, first window and number of windows.
_POINT = np.dtype([("h", "<u8"), ("c", "<u4"), ("c2", "<u2"), ("doc", "<u2"), ("start", "<u4"), ("n", "u1")])
#: Rows of an Arrow batch (``doc`` has 16 bits), bytes of one, bytes of text for each bucket, and the fewest buckets for each
#: shuffle partition.
_ROWS, _BYTES, _BUCKET_BYTES, _BUCKETS = 1500, 4 << 20, 16 << 20, 1
#: Partitions for each bucket: with room, few of them get several.
_ROOM = 2
#: Single windows that are sorted at once.
_WINDOWS = 200_000
_SLICE = 1 << 18
#: Bytes of a long document that are looked at together.
_LONG = 1 << 20
_LAST = np.iinfo(np.int64).max
_rng = np.random.default_rng(99)
_LETTER_2 = _rng.integers(1, (1 << 63) - 1, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_SENT = "bucket int, kind int, ids binary, keys binary, points binary"
_HITS = "rid long, kind int, spans binary"
#: Intervals that a smaller document has, runs to be settled window by window, and points on their way.
COVER, OPEN, POINTS = 0, 1, 2
#: Bits for the place in the slice below those of the seed's hash: the same for slices of any size, so that equal windows
#: choose equally everywhere.  Of hashes that are equal in the bits above, the first wins, in equal windows the same one.
_PLACE_BITS = np.uint64(32)


def _prefix(values: np.ndarray, up: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def cover_points(data: np.ndarray, offsets: np.ndarray, cfg: SubstringDedup) -> np.ndarray:
    """The cover positions of some documents as points; ``doc`` is the row."""
    n, width = len(data), cfg.length - cfg.seed + 1
    if n < cfg.length:
        return np.zeros(0, _POINT)
    up, down = tk._Powers.upto(n + 1)
    sums = _prefix(tk._LETTER[data], up)
    seeds = tk.mix((sums[cfg.seed :] - sums[: -cfg.seed]) * down[: n - cfg.seed + 1])
    low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    least = (seeds & ~low) | np.arange(len(seeds), dtype=np.uint64)
    span = 1
    while span < width:  # the smallest of ``width`` neighbours; of equal hashes the first
        step = min(span, width - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    size = np.diff(offsets)
    rows = np.repeat(np.arange(len(size)), np.maximum(size - cfg.length + 1, 0))
    starts = np.arange(len(rows)) + np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(np.maximum(size - cfg.length + 1, 0))))[:-1], np.maximum(size - cfg.length + 1, 0))
    chosen = (least[starts] & low).astype(np.int64)
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (chosen[1:] != chosen[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(rows)))
    begin, spot, row = starts[first], chosen[first], rows[first]
    end = begin + count + cfg.length - 1
    sums = _prefix(_LETTER_2[data], up)
    run = tk.mix((sums[end] - sums[begin]) * down[begin] + (spot - begin).astype(np.uint64) * tk._PLACE[0] + count.astype(np.uint64) * tk._PLACE[1])
    out = np.zeros(len(first), _POINT)
    # Seeds are chosen as the smallest hashes there are; mixed again, they fall into all buckets alike.
    out["h"], out["c"], out["c2"], out["doc"] = tk.mix(seeds[spot] ^ tk._PLACE[2]), run >> np.uint64(32), run & np.uint64(0xFFFF), row
    out["start"], out["n"] = begin - offsets[row], count
    return out


def sliced_points(data: np.ndarray, offsets: np.ndarray, cfg: SubstringDedup) -> np.ndarray:
    """``cover_points``, a long document in slices: windows are divided among them, and a run that is cut is two runs, whose
    seed they share, as at the edges of a passage."""
    if len(offsets) > 2 or len(data) <= 2 * _LONG:
        return cover_points(data, offsets, cfg)
    found = []
    for a in range(0, len(data) - cfg.length + 1, _LONG):
        part = data[a : a + _LONG + cfg.length - 1]
        p = cover_points(part, np.array([0, len(part)]), cfg)
        p["start"] += np.uint32(a)
        found.append(p)
    return np.concatenate(found)


def sliced_windows(data: np.ndarray, row: int, spans: np.ndarray, cfg: SubstringDedup) -> np.ndarray:
    """``window_points``, a long document in slices."""
    if len(data) <= 2 * _LONG:
        return window_points(data, row, spans, cfg)
    found = []
    for a in range(0, len(data), _LONG):
        own = spans[(spans >> 8 >= a) & (spans >> 8 < a + _LONG)]
        if len(own):
            # A run has at most 255 windows.
            p = window_points(data[a : a + _LONG + 256 + cfg.length], row, own - (a << 8), cfg)
            p["start"] += np.uint32(a)
            found.append(p)
    return np.concatenate(found)


def window_points(data: np.ndarray, row: int, spans: np.ndarray, cfg: SubstringDedup) -> np.ndarray:
    """The single windows of the runs in ``spans`` (start << 8 | number) of one document, as points."""
    up, down = tk._Powers.upto(len(data) + 1)
    begin, count = spans >> 8, spans & 255
    at = np.unique(np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()))
    out = np.zeros(len(at), _POINT)
    for field, letters in (("h", tk._LETTER), ("c", _LETTER_2)):
        sums = _prefix(letters[data], up)
        h = tk.mix((sums[at + cfg.length] - sums[at]) * down[at])
        out[field] = h if field == "h" else h >> np.uint64(32)
        if field == "c":
            out["c2"] = h & np.uint64(0xFFFF)
    out["doc"], out["start"], out["n"] = row, at, 1
    return out


def _send(points: np.ndarray, ids: np.ndarray, keys: np.ndarray, buckets: int, length: int, edges: int) -> pa.RecordBatch:
    """Points by bucket, after what the batch can settle itself.

    Of equal runs those of the smallest doc_id go on.  With ``edges``, seeds that different documents have in so many different
    runs are settled as far as that: the runs are OPEN, and of each seed a point of the smallest and one of the largest
    doc_id go on, which tell other batches.

    POINTS rows carry the points, and the ids and row keys of the documents they name; settled intervals and open runs go as
    rows of their kind without points but ``keys`` and packed spans in ``ids``, to the bucket of their row key.
    """
    order = np.lexsort((ids[points["doc"]], points["c2"], points["c"], points["h"]))
    p = points[order]
    same = np.zeros(len(p), bool)
    same[1:] = (p["h"][1:] == p["h"][:-1]) & (p["c"][1:] == p["c"][:-1]) & (p["c2"][1:] == p["c2"][:-1])
    head = np.flatnonzero(~same)
    smallest = np.repeat(ids[p["doc"][head]], np.diff(np.append(head, len(p))))
    later = ids[p["doc"]] > smallest
    rows: list[tuple[int, int, bytes, bytes, bytes]] = []

    def settled(kind: int, done: np.ndarray) -> None:
        done = done[np.argsort(done["doc"], kind="stable")]
        for i, j in _runs(done["doc"]):
            key = keys[done["doc"][i]]
            spans = _merged(done[i:j], length) if kind == COVER else _packed(done[i:j])
            rows.append((int(np.uint64(key) % np.uint64(buckets)), kind, spans.tobytes(), key.tobytes(), b""))

    settled(COVER, p[later])
    p = p[~later]
    if edges and len(p):
        by_doc = p[np.lexsort((ids[p["doc"]], p["h"]))]
        seed = np.ones(len(p), bool)
        seed[1:] = by_doc["h"][1:] != by_doc["h"][:-1]
        first = np.flatnonzero(seed)
        last = np.append(first[1:], len(p)) - 1
        shared = (last - first + 1 >= max(edges, 2)) & (ids[by_doc["doc"][first]] < ids[by_doc["doc"][last]])
        known = np.repeat(shared, last - first + 1)
        settled(OPEN, by_doc[known])
        known[np.concatenate([first[shared], last[shared]])] = False
        p = by_doc[~known]
    to = ((p["h"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    for part, b in ((p[i:j], int(to[i])) for i, j in _runs(to)):
        docs, index = np.unique(part["doc"], return_inverse=True)
        part = part.copy()
        part["doc"] = index
        rows.append((b, POINTS, ids[docs].tobytes(), keys[docs].tobytes(), part.tobytes()))
    bucket, kind, *rest = zip(*rows, strict=True) if rows else ((), (), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), *[pa.array(x, pa.binary()) for x in rest]], ["bucket", "kind", "ids", "keys", "points"])


def _packed(points: np.ndarray) -> np.ndarray:
    """Runs of windows as start << 8 | number."""
    return points["start"].astype(np.int64) << 8 | points["n"]


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    cuts = np.flatnonzero(np.diff(values)) + 1
    bounds = [0, *cuts.tolist(), len(values)]
    return ((a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a)


def _merged(points: np.ndarray, length: int) -> np.ndarray:
    """Byte intervals (start, stop) of some runs of windows, overlapping ones joined."""
    points = points[np.argsort(points["start"], kind="stable")]
    begin = points["start"].astype(np.int64)
    stop = np.maximum.accumulate(begin + points["n"] + length - 1)
    fresh = np.ones(len(begin), bool)
    fresh[1:] = begin[1:] > stop[:-1]
    head = np.flatnonzero(fresh)
    return np.column_stack([begin[head], stop[np.append(head[1:], len(begin)) - 1]])


def _joined(pairs: np.ndarray) -> np.ndarray:
    """Byte intervals (start, stop) in their order, those that overlap or touch joined."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    stop = np.maximum.accumulate(pairs[:, 1]) if len(pairs) else pairs[:, 1]
    head = np.flatnonzero(np.append(True, pairs[1:, 0] > stop[:-1])[: len(pairs)])
    return np.column_stack([pairs[head, 0], stop[np.append(head[1:], len(pairs)) - 1]]) if len(pairs) else pairs


def _settle(length: int, open_runs: bool):
    """One bucket: intervals that smaller documents have, and with ``open_runs`` the runs whose seed other runs share.

    Most seeds occur once and go first, before anything else is put together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid: list[int] = []
        kind: list[int] = []
        spans: list[bytes] = []
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            columns = (batch.column(batch.schema.get_field_index(c)) for c in ("kind", "ids", "keys", "points"))
            for what, i, k, p in zip(*columns, strict=True):
                i, k, p = (np.frombuffer(x.as_py(), t) for x, t in ((i, np.int64), (k, np.int64), (p, _POINT)))
                if what.as_py() == POINTS:
                    parts.append((i, k, p))
                else:
                    rid.append(int(k[0]))
                    kind.append(what.as_py())
                    spans.append(i.tobytes())
        if parts:
            seeds = np.sort(np.concatenate([p["h"] for _, _, p in parts]))
            repeated = np.unique(seeds[1:][seeds[1:] == seeds[:-1]])
            del seeds
            for n, (i, k, p) in enumerate(parts):
                at = np.searchsorted(repeated, p["h"])
                at[at == len(repeated)] = 0
                p = p[repeated[at] == p["h"]] if len(repeated) else p[:0]
                parts[n] = (i[p["doc"]], k[p["doc"]], p)
            doc, key, p = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            order = np.lexsort((doc, p["c2"], p["c"], p["h"]))
            doc, key, p = doc[order], key[order], p[order]
            seed = np.ones(len(p), bool)
            seed[1:] = p["h"][1:] != p["h"][:-1]
            new = seed.copy()
            new[1:] |= (p["c"][1:] != p["c"][:-1]) | (p["c2"][1:] != p["c2"][:-1])
            head = np.flatnonzero(new)
            smallest = np.repeat(doc[head], np.diff(np.append(head, len(p))))
            found = [(COVER, doc > smallest)]
            if open_runs and len(p):
                group = np.cumsum(seed) - 1
                lo, hi = np.full(group[-1] + 1, _LAST), np.full(group[-1] + 1, np.iinfo(np.int64).min)
                np.minimum.at(lo, group[head], doc[head])
                np.maximum.at(hi, group[head], doc[head])
                found.append((OPEN, (doc == smallest) & (lo < hi)[group]))
            for what, mask in found:
                k, q = key[mask], p[mask]
                order = np.argsort(k, kind="stable")
                k, q = k[order], q[order]
                for a, b in _runs(k):
                    rid.append(int(k[a]))
                    kind.append(what)
                    spans.append((_merged(q[a:b], length) if what == COVER else _packed(q[a:b])).tobytes())
        for a in range(0, len(rid), 20_000):
            b = a + 20_000
            yield pa.RecordBatch.from_arrays([pa.array(rid[a:b], pa.int64()), pa.array(kind[a:b], pa.int32()), pa.array(spans[a:b], pa.binary())], ["rid", "kind", "spans"])

    return run


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Document order (null ids last) and row keys of a batch."""
    ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
    return ids, batch.column(1).to_numpy(zero_copy_only=False)


def repeated_strings(spark: SparkSession, docs: DataFrame, cfg: SubstringDedup = SubstringDedup()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) for every row of ``docs``.

    Reads doc_id and text as UTF-8 bytes; null texts are empty.  Texts shorter than ``length`` lose nothing.  A row
    without doc_id comes after all others; rows with the same doc_id take nothing from each other.  Exact repetitions of
    a whole row are decided alike.  An empty table gives an empty result.
    """
    scratch = Scratch(spark, "substrings")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = keyed.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit("/"), "text").alias("rid"), "text")
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(_BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // _BUCKET_BYTES))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = _columns(batch)
            data, offsets = tk.buffers(batch.column(2))
            found = []
            for a, b in tk.slices(offsets, _SLICE):
                p = sliced_points(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], cfg)
                p["doc"] += a
                found.append(p)
            if found:
                yield _send(np.concatenate(found), ids, keys, buckets, cfg.length, cfg.edge_runs)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = _columns(batch)
            data, offsets = tk.buffers(batch.column(2))
            found, held = [], 0
            for i, spans in enumerate(batch.column(3)):
                own = np.concatenate([np.frombuffer(s.as_py(), np.int64) for s in spans])
                found.append(sliced_windows(data[offsets[i] : offsets[i + 1]], i, own, cfg))
                held += len(found[-1])
                if held >= _WINDOWS or i == len(ids) - 1:
                    yield _send(np.concatenate(found), ids, keys, buckets, cfg.length, 0)
                    found, held = [], 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.buffers(batch.column(1))
            size, removed, count, digest, kept = np.diff(offsets), [], [], [], []
            for i, spans in enumerate(batch.column(2).to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                gone = _joined(np.concatenate([np.frombuffer(s, np.int64).reshape(-1, 2) for s in spans or []] or [np.zeros((0, 2), np.int64)]))
                ends = [0, *gone[:, 1].tolist()]
                left = b"".join(own[x:y].tobytes() for x, y in zip(ends, [*gone[:, 0].tolist(), len(own)], strict=True))
                removed.append(len(own) - len(left))
                count.append(len(gone))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            arrays = [batch.column(0), pa.array(size), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(_ROWS), spark__sql__execution__arrow__maxBytesPerBatch=str(_BYTES)):
        runs = scratch.keep(keyed.mapInArrow(cover, _SENT).repartition(_ROOM * buckets, "bucket").groupBy("bucket").applyInArrow(_settle(cfg.length, True), _HITS), "runs")
        open_rows = runs.where(F.col("kind") == OPEN).groupBy("rid").agg(F.collect_list("spans").alias("spans"))
        edges = keyed.join(open_rows, "rid").select("doc_id", "rid", "text", "spans").mapInArrow(windows, _SENT)
        edges = scratch.keep(edges.repartition(_ROOM * buckets, "bucket").groupBy("bucket").applyInArrow(_settle(cfg.length, False), _HITS), "edges")
        covered = runs.where(F.col("kind") == COVER).unionByName(edges).groupBy("rid").agg(F.collect_list("spans").alias("spans"))
        out = keyed.join(covered, "rid", "left").select("doc_id", "text", "spans")
        return out.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
