"""The corpus operators against brute force, on real small tables and on awkward rows.

The awkward table has nulls in every column, empty, blank and very long texts, ties, repeated rows and columns whose
names the operators use themselves.
"""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from driftwell.llm import decontaminate, fingerprint, line_dedup, mixing, quality, secrets
from driftwell.llm.canonical import composed
from driftwell.llm.near_dedup import NearDedup, near_duplicates
from driftwell.llm.quote_linking import linked_conversations
from driftwell.llm.substring_dedup import repeated_strings
from driftwell.llm.token_rollup import TokenRollup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, component string, token string, key int, size int, h int, c string, spans int, weight int, range int"


def lowered(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def sentence(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def awkward():
    rnd = random.Random(4)
    base = sentence(rnd, 120)
    long = sentence(rnd, 60_000)
    words = base.split()
    near = " ".join(words[:50] + ["Changed"] + words[51:])
    texts = [base, base, near, base.upper(), None, "", " \n\t ", "one", "one two three", "One two three", "a b c d", long, long[: len(long) // 2] + base, "é" * 80, "é" * 80, "a" * 5000, "ab" * 4000, "x y z\0w", f"{base}\n{base}\n{base}"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None if t is None else len(t), *([None] * 10)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[7], (100, None, None, None, None, *([None] * 10)), (101, base[10:], "de", "s1", 1, *(["x"] * 3), *([1] * 3), "x", *([1] * 3))]
    return rows


@pytest.fixture(scope="module")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA)


@pytest.fixture(scope="module")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# Near duplicates


def near_brute(rows, width):
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = WORD.findall(lowered(t or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) or rows[i][0] == rows[j][0]:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((rows[i][0], len(sets[i]), least[root(i)], least[root(i)] == rows[i][0]) for i in range(len(rows)))


@pytest.mark.parametrize("table", ["docs", "real"])
def test_near_duplicates(spark, request, table):
    df = request.getfixturevalue(table)
    got = sorted(tuple(r) for r in near_duplicates(spark, df, NearDedup(width=4)).collect())
    assert got == near_brute(pairs(df), 4)


def test_near_duplicates_in_chains(spark):
    """A chain of edits, each text near the next only, is one component; so is a group too wide for any one leader."""
    rnd = random.Random(8)
    words = sentence(rnd, 300).split()
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words)))
        words[10 * i : 10 * i + 8] = sentence(rnd, 8).split()
    base = sentence(rnd, 200).split()
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randrange(0, 9)):
            w[rnd.randrange(200)] = sentence(rnd, 1)
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates(spark, df, NearDedup(width=4)).collect()) == near_brute(rows, 4)


def test_near_duplicates_without_ids_and_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted((tuple(r) for r in near_duplicates(spark, df).collect()), key=str) == sorted([(None, 2, None, True), (1, 2, 1, True)], key=str)
    assert near_duplicates(spark, df.limit(0)).count() == 0


# Repeated strings


def strings_brute(rows):
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("table", ["docs", "real"])
def test_repeated_strings(spark, request, table):
    df = request.getfixturevalue(table)
    got = sorted(tuple(r) for r in repeated_strings(spark, df).drop("kept").collect())
    assert got == strings_brute(pairs(df))


def test_repeated_strings_edges(spark):
    """Passages of 49, 50 and 51 bytes, runs of one byte, overlaps of two sources."""
    rnd = random.Random(2)
    p = [bytes(rnd.choices(range(97, 123), k=200)).decode() for _ in range(6)]
    texts = [p[0] + p[1], p[2] + p[0][:49] + p[3], p[4] + p[0][100:150] + p[5], p[0][60:111] + "zz", p[1][20:90] + p[1][60:140], "a" * 300, "b" + "a" * 120 + "c", p[0][150:] + p[1][:30]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in repeated_strings(spark, df).drop("kept").collect()) == strings_brute(rows)
    assert repeated_strings(spark, df.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, p[0]), (5, p[0])], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in repeated_strings(spark, nameless).collect()} == {None: 200, 5: 0}


def test_equal_windows_choose_equally(spark):
    """A passage marks the same places in a slice of any size, also where hashes are nearly alike."""
    import numpy as np

    from driftwell.llm import substring_dedup as sd

    rnd = random.Random(44)
    passage = bytes(rnd.choices(b"ab", k=400))
    cfg, marks = sd.SubstringDedup(), []
    for before in (0, 60, 5_000, 300_000):
        data = np.frombuffer(bytes(rnd.choices(b"abcdefgh", k=before)) + passage, np.uint8)
        p = sd.cover_points(data, np.array([0, len(data)]), cfg)
        inside = p[p["start"] >= before + cfg.length]
        marks.append([(int(x["h"]), int(x["c"]), int(x["c2"]), int(x["start"]) - before, int(x["n"])) for x in inside])
    assert all(m == marks[0] for m in marks) and len(marks[0]) > 10


@pytest.mark.parametrize("edge_runs", [2, 8])
def test_repeated_strings_in_many_batches(spark, monkeypatch, edge_runs):
    """Near copies and a passage that everyone has, in batches of a few rows and buckets of a few bytes."""
    from driftwell.llm import substring_dedup as sd

    rnd = random.Random(45)
    monkeypatch.setattr(sd, "_ROWS", 12)
    monkeypatch.setattr(sd, "_BUCKET_BYTES", 1000)
    base, passage = sentence(rnd, 60), sentence(rnd, 14)
    rows = []
    for i in range(90):
        words = base.split() if i % 3 == 0 else sentence(rnd, 30).split()
        words[rnd.randrange(len(words))] = sentence(rnd, 1)
        at = rnd.randrange(len(words))
        rows.append((i * 7 % 90, " ".join([*words[:at], passage, *words[at:]])))
    rows += [(i, t) for i, t in rows[:3]] + [(95, None), (96, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in repeated_strings(spark, df, sd.SubstringDedup(edge_runs=edge_runs)).drop("kept").collect()) == strings_brute(rows)


def test_long_texts_are_sliced(monkeypatch):
    """Slices tell every window once, and the single windows of runs that reach over their ends."""
    import numpy as np

    from driftwell.llm import substring_dedup as sd

    cfg, rnd = sd.SubstringDedup(), np.random.default_rng(3)
    data = rnd.integers(97, 101, 5_000).astype(np.uint8)
    whole = sd.cover_points(data, np.array([0, len(data)]), cfg)
    monkeypatch.setattr(sd, "_LONG", 700)
    parts = sd.sliced_points(data, np.array([0, len(data)]), cfg)
    windows = np.sort(np.concatenate([np.arange(p["start"], p["start"] + p["n"]) for p in parts]))
    assert len(parts) > len(whole) and (windows == np.arange(len(data) - cfg.length + 1)).all()
    spans = sd._packed(whole)
    one, other = (np.sort(f(data, 4, spans, cfg), order=["start"]) for f in (sd.window_points, sd.sliced_windows))
    assert (one == other).all() and len(one) == len(data) - cfg.length + 1


def test_strings_over_the_slices_of_a_long_text(spark):
    rnd = random.Random(33)
    word = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    early, later = word(200), word(300)
    at = 1 << 20
    long = word(at - 90) + early + word(at - 200 - 110 - 20) + later + word(400_000)
    rows = [(0, f"{word(70)}\u00e9{early}\u00e9{word(70)}"), (1, long), (2, f"{word(80)}\u00e9{later}\u00e9{word(90)}"), (3, later + early)]
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_strings(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = {0: rows[0][1], 1: long.replace(early, "", 1), 2: rows[2][1].replace(later, "", 1), 3: ""}
    assert got == {i: (len(t.encode()) - len(kept[i].encode()), int(t != kept[i]), hashlib.sha256(kept[i].encode()).hexdigest()) for i, t in rows}


# Quality


def test_quality(spark, sf, docs):
    d, labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    scored = quality.quality_scores(spark, d, labels).join(labels, "doc_id").toPandas()
    held = scored[scored.held_out]
    assert len(held) > 50 and ((held.score >= 0.3) == (held.quality == 1)).mean() > 0.93
    assert scored.score.between(0, 1).all()
    odd = quality.quality_scores(spark, docs, labels.unionByName(labels.limit(3)).unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0)], labels.schema)))
    assert odd.count() == docs.count() and odd.where("score is null or isnan(score) or predicted is null or held_out is null").count() == 0
    assert {r.score for r in quality.quality_scores(spark, docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(spark, docs.limit(0), labels).count() == 0


def test_quality_equals_a_plain_fit(spark, sf):
    """The same features, solved in one piece: ridge by the whole design matrix, calibration by its definition."""
    import numpy as np
    import pyarrow as pa
    from zlib import crc32

    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    cfg = quality.QualityModel(features=40, folds=3)
    got = {r.doc_id: r for r in quality.quality_scores(spark, d, labels, cfg).collect()}
    rows, known = pairs(d), {r.doc_id: float(r.quality) for r in labels.where("quality is not null").collect()}
    x = quality.statistics(pa.array([t for _, t in rows]))
    spread = x.astype(float).std(axis=0)
    z = quality._Fourier(cfg, x.astype(float).mean(axis=0), np.where(spread > 1e-6, spread, 1.0))(x)
    held = [crc32(str(i).encode()) % 5 == 0 for i, _ in rows]
    assert [got[i].held_out for i, _ in rows] == held
    learn = [k for k, (i, _) in enumerate(rows) if i in known and not held[k]]
    fold = {r.doc_id: r.f for r in d.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("f")).collect()}
    y, f = np.array([known[rows[k][0]] for k in learn]), np.array([fold[rows[k][0]] for k in learn])

    def solve(own):
        a, b = z[learn][own], y[own]
        ridge = np.diag([cfg.ridge * len(b)] * cfg.features + [1e-9])
        return np.linalg.solve(a.T @ a + ridge, a.T @ b)

    raw = np.zeros(len(y))
    for k in range(3):
        raw[f == k] = z[learn][f == k] @ solve(f != k)
    at = np.clip(((raw - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = sorted(set(at))
    n = np.array([(at == b).sum() for b in bins], float)
    rate = np.array([y[at == b].mean() for b in bins])
    # The isotonic fit by its minimax formula.
    mean = lambda i, j: (rate[i : j + 1] * n[i : j + 1]).sum() / n[i : j + 1].sum()
    level = np.array([max(min(mean(i, j) for j in range(k, len(bins))) for i in range(k + 1)) for k in range(len(bins))])
    middle = quality.LOW + (np.array(bins) + 0.5) * (quality.HIGH - quality.LOW) / quality.BINS
    knots = [(middle[own] * n[own]).sum() / n[own].sum() for v in np.unique(level.round(12)) if (own := level.round(12) == v).any()]
    want = np.clip(np.interp(z @ solve(np.ones(len(y), bool)), knots, np.unique(level.round(12))), 0, 1)
    assert max(abs(got[i].score - w) for (i, _), w in zip(rows, want, strict=True)) < 1e-4


def test_held_out_labels_are_never_read(spark, sf):
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.quality_scores(spark, d, x).collect()} for x in (labels, turned))
    assert a == b


def test_isotonic():
    import numpy as np

    assert quality.isotonic(np.array([1.0, 3.0, 2.0, 4.0]), np.ones(4)).tolist() == [1, 2.5, 2.5, 4]


# Mixing


@pytest.mark.parametrize("table", ["docs", "real"])
def test_mixing(spark, request, table):
    df = request.getfixturevalue(table)
    got = mixing.mix_sources(spark, df).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((d, len(WORD.findall(t or ""))) for d, t in pairs(df))
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    names = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    size = {s: sum(r.size for r in by[s]) for s in names}
    left, total, target = set(names), 1.5 * sum(size.values()), {}
    while True:
        room = total - sum(target.values())
        share = {s: room * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= over
    for s in names:
        assert by[s][0].target == pytest.approx(target[s]) and sum(r.taken for r in by[s]) == pytest.approx(target[s], abs=1)
    again = mixing.mix_sources(spark, df.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixing_in_ranges(spark, docs, monkeypatch):
    """The same whatever the ranges, also with weights far apart and of nothing, against a plain prefix sum."""
    rnd = random.Random(17)
    df = spark.createDataFrame([(i if i % 50 else None, sentence(rnd, rnd.randrange(9)) if i % 7 else None, ("x", "y", None)[i % 9 // 4]) for i in range(600)], "doc_id long, text string, source string")
    weights = df.where("doc_id is not null").select("doc_id", F.element_at(F.array(*[F.lit(w) for w in (0.0, 1.0, 100.0, 1000.0)]), (F.col("doc_id") % 4 + 1).cast("int")).alias("quality_weight"))
    whole = mixing.mix_sources(spark, df, weights).collect()
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    assert Counter(map(tuple, mixing.mix_sources(spark, df, weights).collect())) == Counter(map(tuple, whole))
    by = defaultdict(list)
    for r in whole:
        by[r.source].append(r)
    for rows in by.values():
        epochs, target = int(rows[0].target // rows[0].source_size), rows[0].target
        part = sorted((r for r in rows if r.size), key=lambda r: r.taken - epochs * r.size - r.size)
        # All whole, then at most one in part, then none; what is whole is heavier on the whole.
        extra = [r.taken - epochs * r.size for r in part]
        assert sum(0 < e < r.size for e, r in zip(extra, part, strict=True)) <= 1 and sum(r.taken for r in rows) == round(target)
        share = lambda k, rows=rows: sum(r.taken for r in rows if r.doc_id and r.doc_id % 4 == k) / sum(r.size for r in rows if r.doc_id and r.doc_id % 4 == k)
        assert share(0) <= share(3)


def test_mixing_follows_weights(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    weights = df.select("doc_id", F.when(F.col("doc_id") % 4 < 2, 1.0).otherwise(0.1).alias("quality_weight"))
    r = mixing.mix_sources(spark, df, weights).groupBy((F.col("doc_id") % 4 < 2).alias("heavy")).agg(F.sum("taken").alias("t")).collect()
    taken = {x.heavy: x.t for x in r}
    assert taken[True] > 1.1 * taken[False]
    assert mixing.mix_sources(spark, df.limit(0)).count() == 0


# Decontamination


def contained_brute(rows, items, width=5):
    def grams(t, n):
        w = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t or ""))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, len(w)

    out = []
    for d, t in rows:
        for i, s in items:
            n = grams(s, 1)[1]
            if n:
                own = grams(s, min(width, n))[0]
                both = len(own & grams(t, min(width, n))[0])
                if 100 * both >= 80 * len(own):
                    out.append((d, i, both, len(own)))
    return sorted(out)


def test_contained_items(spark, sf, real, docs, awkward):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = sorted(tuple(r)[:4] for r in decontaminate.contained_items(spark, real, bench).collect())
    assert got == contained_brute(pairs(real), [(r.item_id, r.text) for r in bench.collect()]) and got
    words = awkward[0][1].split()
    items = [(1, " ".join(words[5:40])), (2, "!".join(words[5:39] + ["other"])), (3, "ONE"), (4, None), (5, "..."), (6, " ".join(words[5:20] + sentence(random.Random(1), 20).split())), (7, " ".join(words[5:40]))]
    df = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r)[:4] for r in decontaminate.contained_items(spark, docs, df).collect()) == contained_brute(pairs(docs), items)
    assert decontaminate.contained_items(spark, docs, df.limit(0)).count() == 0
    assert decontaminate.clean_documents(spark, docs, df).columns == docs.columns


def test_items_in_blocks(spark, real, sf, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.contained_items(spark, real, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 300)
    assert sorted(map(tuple, decontaminate.contained_items(spark, real, bench).collect())) == whole


def test_blocks_are_bounded(spark, monkeypatch):
    from driftwell.llm.scratch import Scratch

    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 100)
    rows = [(i, 5, b"12345678" * (1 + i * 7 % 90)) for i in range(200)] + [(900, 5, b"12345678" * 500)]
    sets = decontaminate._blocks(Scratch(spark, "blocks"), spark.createDataFrame(rows, "item_id long, width int, members binary"))
    blocks = defaultdict(list)
    for r in sets.collect():
        blocks[r.size, r.number].append(len(r.members) // 8)
    assert sum(map(len, blocks.values())) == 201 and all(sum(b) <= 100 or len(b) == 1 for b in blocks.values()) and len(blocks) < 150
    passes = decontaminate._passes([(*k, sum(b)) for k, b in blocks.items()])
    assert sorted(x for own in passes for x in own) == sorted(blocks) and len(passes) < len(blocks)
    assert all(sum(sum(blocks[x]) for x in own) <= 100 or len(own) == 1 for own in passes) and decontaminate._passes([]) == []


def test_short_items_equal_sql(spark, tmp_path):
    import duckdb

    items = [(1, "green blue"), (2, "Green"), (3, "a b c d"), (4, "a b c d e f"), (5, None), (6, " . ")]
    texts = [(1, "the green, blue sea"), (2, "blue green"), (3, "x a b c d e f y"), (4, None), (5, "a b c")]
    for name, rows, key in (("benchmark", items, "item_id"), ("documents", texts, "doc_id")):
        spark.createDataFrame(rows, f"{key} long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = decontaminate.contained_items(spark, *(spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "benchmark"))).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(decontaminate.ORACLE).fetchall()) and {(1, 1), (1, 2), (2, 2), (3, 3), (3, 4)} == {(r.doc_id, r.item_id) for r in got}


# Fingerprints


def folded(t):
    nfc = lambda x: unicodedata.normalize("NFC", x)
    return re.sub(r"[\s  ]+", " ", nfc(nfc(t or "").upper().lower())).strip(" ")


def test_composition(spark):
    rnd = random.Random(3)
    pool = [*"aeiouAEIOUnN c", *map(chr, range(0x300, 0x346)), *map(chr, range(0xC0, 0x180)), *map(chr, range(0x1E00, 0x1F00)), *map(chr, range(0x1100, 0x1113)), *map(chr, range(0x1161, 0x1176)), *map(chr, range(0x11A8, 0x11C3)), "Å", "豈", "가", "̈́", "ে", "া", "א", "ָ"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(30))) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", composed(F.col("t")).alias("c")).collect()
    assert [r.c for r in got] == [unicodedata.normalize("NFC", r.t) for r in got]


def test_fingerprints(spark, docs):
    got = fingerprint.fingerprints(spark, docs).collect()
    texts = dict(pairs(docs))
    by = defaultdict(set)
    for r in got:
        by[r.fingerprint].add(folded(texts[r.doc_id]))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({folded(t) for t in texts.values()})
    # With two bits for each half almost every bucket has different texts, and bytes decide.
    few = fingerprint.fingerprints(spark, docs, bits=1).collect()
    assert {r.doc_id: r.fingerprint for r in few}.keys() == texts.keys()
    assert len({r.fingerprint for r in few}) == len({folded(t) for t in texts.values()})
    assert fingerprint.fingerprints(spark, docs.limit(0)).count() == 0


def test_edit_report(spark, real):
    got = {r.doc_id: r for r in fingerprint.edit_report(spark, real).collect()}
    rows = sorted((d, t or "") for d, t in pairs(real))
    for k, (d, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(folded(t) == folded(edited)), float(folded(t) == folded(following)))


def test_edit_report_of_few_rows(spark):
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    r = fingerprint.edit_report(spark, one).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    none = spark.createDataFrame([(None, "abcd"), (1, None)], "doc_id long, text string")
    assert fingerprint.edit_report(spark, none).count() == 2
    assert fingerprint.edit_report(spark, one.limit(0)).count() == 0


# Secrets


def test_secrets(spark):
    key, hexa = "AKIA" + "A1" * 9, "0123456789abcdef" * 2
    texts = [f'é password = "{hexa}" x', f"{key} {key}9 AKIA123", f"TOKEN:abc token=token=abcdef secret:token:abcdefgh {hexa[:23]}", None, "", f"api_key: '{'z' * 40}'", f"Secret={hexa}", f"ghp_{'a1B2' * 9}"]
    rows = [(i, t, f"s{i}") for i, t in enumerate(texts)] + [(20 + i, f"token={'copied' * 3}", f"o{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("found", F.lit(1)).withColumn("owner", F.lit("x"))
    got = {r.doc_id: r for r in secrets.secret_report(spark, df).collect()}
    assign = re.compile(secrets.KINDS[0][1])
    for d, t, _ in rows:
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t or "") if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(base))
        assert got[d].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (t, got[d].spans, listed)
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert set(filter(None, listed.split(","))) <= set(got[d].spans.split(","))
    assert "forge" in got[7].spans
    assert (got[20].n_copied, got[20].n_live, got[0].n_live, got[0].n_copied) == (1, 0, 1, 0)
    assert secrets.secret_report(spark, df.limit(0)).count() == 0


def test_secrets_in_long_texts_and_repeated_rows(spark, monkeypatch):
    """Very many matches in one text, over several chunks; rows that repeat are one document; nulls anywhere."""
    monkeypatch.setattr(secrets, "CHUNK", 7)
    rnd = random.Random(5)
    text = " ".join("".join(rnd.choice("0123456789abcdef") for _ in range(rnd.randrange(20, 30))) for _ in range(3000)) + " token=abcdefgh"
    rows = [(1, text, "a"), (1, text, "a"), (2, "password: hunter22", None), (None, "password: hunter22", "b"), (3, None, None)]
    got = secrets.secret_report(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = ",".join(f"hex:{m.start()}:{m.end()}" for m in re.finditer("[0-9a-f]{24,}", text))
    twice = [r for r in got if r.doc_id == 1]
    assert len(twice) == 2 and twice[0] == twice[1] and [x for x in twice[0].spans.split(",") if x.startswith("hex")] == want.split(",") and twice[0].n_assign == 1
    by = {r.doc_id: (r.n_live, r.n_copied) for r in got}
    assert by[2] == by[None] == (1, 0) and by[3] == (0, 0) and by[1] == (twice[0].n_hex + 1, 0)


# Lines


def lines_brute(rows, cfg=line_dedup.TemplateTree()):
    """Lines that recur as they are, and templates as plain tuples: what stays at its place in a leaf's texts, else a field."""
    def masked(line):
        if re.search("[0-9]", line) and len(WORD.findall(line)) > 2:
            line = re.sub(r"[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*", "<*>", line)
        return tuple(re.sub(r"[\x20\x09\x0B-\x0D]+", " ", line).strip(" ").split(" "))

    leaf, place, same = defaultdict(set), defaultdict(set), defaultdict(set)
    each = [(t, i, w) for _, t in rows if t is not None for i, w in enumerate(map(masked, t.split("\n"))) if w != ("",)]
    node = lambda w: (len(w), *w[: cfg.depth])
    for t, _, w in each:
        leaf[node(w)].add(t)
        same[w].add(t)
        for j, x in enumerate(w):
            place[node(w), j, x].add(t)
    enough = lambda texts, w: len(texts) >= max(cfg.documents, cfg.leaf_share * len(leaf[node(w)]))

    def template(w):
        words = [(j, x) for j, x in enumerate(w) if j >= cfg.depth and x != "<*>"]
        stays = tuple((j, x) for j, x in words if enough(place[node(w), j, x], w))
        return (node(w), stays) if stays and len(stays) >= cfg.kept_share * len(words) else None

    texts, hits = defaultdict(set), defaultdict(set)
    for t, _, w in each:
        if template(w):
            texts[template(w)].add(t)
    for t, i, w in each:
        if len(same[w]) >= cfg.documents or template(w) and enough(texts[template(w)], w):
            hits[t].add(i)
    out = []
    for d, t in rows:
        lines = t.split("\n") if t is not None else []
        rest = [x for i, x in enumerate(lines) if i not in hits[t]]
        out.append((d, "\n".join(rest) if t is not None else None, len(lines), len(lines) - len(rest)))
    return Counter(out)


def test_lines_equal_brute_force(spark, docs, real):
    for df in (docs, real):
        got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_recurring_lines(spark, df).collect())
        assert got == lines_brute(pairs(df))
    assert any(k[3] for k in got)


def test_license_block_and_one_document(spark):
    """Five lines in a fixed order go from all of forty documents; what one document repeats stays; names may clash."""
    rnd = random.Random(21)
    block = [sentence(rnd, 9) for _ in range(5)]
    rows = [(i, "\n".join([sentence(rnd, 12), *block, sentence(rnd, 12)])) for i in range(40)]
    rows += [(50, "\n".join([sentence(rnd, 12), "this line is said again"] * 12)), (51, block[0]), (52, "\n".join([*block, "x"]))]
    names = ["dropped", "_lines", "_left", "row", "lines", "rest", "left", "id", "class", "line", "node", "at", "n_dropped"]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    out = line_dedup.drop_recurring_lines(spark, df)
    assert set(out.columns) == {*df.columns, "n_lines", "emptied"}
    got = {r.doc_id: r for r in out.collect()}
    texts = dict(rows)
    for i in range(40):
        lines = texts[i].split("\n")
        assert (got[i].text, got[i].n_dropped, got[i].lines) == (f"{lines[0]}\n{lines[6]}", 5, 4)
    assert got[50].text == texts[50] and not got[50].emptied
    # Nothing but recurring lines, or nearly: they go there too.
    assert (got[51].text, got[51].n_dropped, got[51].emptied) == ("", 1, True) and (got[52].text, got[52].n_dropped, got[52].emptied) == ("x", 5, False)


def test_lines(spark, docs):
    rnd = random.Random(6)
    rows = []
    for i in range(40):
        lines = [sentence(rnd, 12) for _ in range(3)]
        lines.insert(rnd.randrange(4), f"Updated on 2024-01-{i % 28 + 1:02d} by user{i} in the main archive")
        rows.append((i, "\n".join(lines), i))
    copies = "\n".join(sentence(rnd, 9) for _ in range(4))
    rows += [(100 + i, copies, 0) for i in range(30)] + [(200 + i, "All lines recur everywhere here", 0) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines long")
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(spark, df).collect()}
    assert all(got[i].n_dropped == 1 and "Updated" not in got[i].text for i in range(40))
    assert all(got[100 + i].text == copies and got[100 + i].n_lines == 4 for i in range(30))
    out = line_dedup.drop_recurring_lines(spark, docs)
    assert set(out.columns) == {*docs.columns, "n_lines", "n_dropped", "emptied"}
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(pairs(docs))
    assert line_dedup.drop_recurring_lines(spark, docs.limit(0)).count() == 0


def test_documents_of_recurring_lines_only_are_marked(spark):
    line = "This line recurs in every kind of place"
    rnd = random.Random(9)
    rows = [(i, f"{sentence(rnd, 8)}\n{line}\n{sentence(rnd, 8)}") for i in range(12)] + [(50, line), (51, f"{line}\n "), (52, " ")]
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_dropped == 1 and not got[0].emptied and (got[52].text, got[52].emptied) == (" ", False)
    assert (got[50].text, got[50].n_dropped, got[50].emptied) == ("", 1, True) and (got[51].text, got[51].n_dropped, got[51].emptied) == (" ", 1, True)


def test_lines_of_few_tokens_that_stand_in_one_text_stay(spark):
    """A leaf's leading tokens are no evidence: lines of 4 to 6 tokens with a common opening and an end of their own stay."""
    rnd = random.Random(15)
    words = iter(sorted({"".join(rnd.choice("abcdefgh") for _ in range(9)) for _ in range(4000)}))
    ends = {n: [" ".join(next(words) for _ in range(n - 3)) for _ in range(60)] for n in (4, 5, 6)}
    rows = [(i, "\n".join([*(f"I would like {ends[n][i]}" for n in ends), f"Page {i} of 60", f"The total price is {i} EUR today"])) for i in range(60)]
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert got[i].text.split("\n") == text.split("\n")[:3], got[i]


def test_templates_grow_with_their_leaf(spark):
    """Of a leaf with very many texts a template needs a share; a line that recurs as it is needs none."""
    rnd = random.Random(16)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(9))
    rows = [(i, f"We are happy {word()} {word()} {word()}") for i in range(200)]
    rows += [(300 + i, f"{word()}\nWe are happy to {word()} you") for i in range(7)] + [(400 + i, f"{word()}\nWe are happy at the lake") for i in range(7)]
    few = rows[:50] + rows[200:]
    for part, gone in ((rows, {400}), (few, {300, 400})):
        got = {r.doc_id: r.n_dropped for r in line_dedup.drop_recurring_lines(spark, spark.createDataFrame(part, "doc_id long, text string")).collect()}
        assert {d // 100 * 100 for d, n in got.items() if n} == gone and all(n for d, n in got.items() if d >= 400)


def test_lines_of_one_very_long_text(spark):
    line = "This line recurs in every kind of place"
    rows = [(i, line) for i in range(2)] + [(i, f"{i}\n" + f"{line}\n" * (200_000 if i == 9 else 1) + f"end{i}") for i in range(5, 10)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_recurring_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9] == ("9\nend9", 200_000) and got[0] == ("", 1)


def test_block_of_lines_over_documents(spark):
    """Lines inside a block always have the same neighbours; copies of a text are one document."""
    rnd = random.Random(12)
    block = [sentence(rnd, 7) for _ in range(3)]
    often, copied = sentence(rnd, 6), "\n".join(sentence(rnd, 9) for _ in range(4))
    rows = [(i, "\n".join([sentence(rnd, 9), *block, sentence(rnd, 9)])) for i in range(6)] + [(20 + i, copied) for i in range(30)]
    rows += [(60, "\n".join(x for _ in range(12) for x in (sentence(rnd, 8), often)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(spark, df).collect()}
    texts = dict(rows)
    for i in range(6):
        lines = texts[i].split("\n")
        assert (got[i].n_dropped, got[i].text) == (3, f"{lines[0]}\n{lines[4]}")
    assert all(got[20 + i].text == copied for i in range(30)) and got[60].text == texts[60]


def test_short_lines_over_documents(spark):
    """Lines of 1 and 2 tokens go as they are, without fields; blank lines stay."""
    rnd = random.Random(14)
    rows = [(i, "\n".join(["Advertisement", sentence(rnd, 9), " \t", "Read  more", f"Page {i}", sentence(rnd, 9), "", "Page 99"])) for i in range(6)]
    rows += [(10 + i, f"{sentence(rnd, 9)}\nOnly here") for i in range(4)]
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        lines = text.split("\n")
        want = lines if i >= 10 else [lines[1], lines[2], lines[4], lines[5], lines[6]]
        assert got[i].text.split("\n") == want and got[i].n_dropped == len(lines) - len(want)


def test_lines_equal_sql(spark, sf):
    import duckdb

    from driftwell.llm import queries

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = queries.op1_line_dedup(spark, sf).collect()
    assert Counter(map(tuple, got)) == Counter(con.execute(queries.ORACLES["op1_line_dedup"]).fetchall()) and sum(r.n_dropped for r in got)


def test_pipeline_drops_blocks(spark, sf):
    import corpus_pipeline

    rnd = random.Random(13)
    block = [sentence(rnd, 7) for _ in range(3)]
    rows = [(i, "\n".join([sentence(rnd, 9), *block, sentence(rnd, 9)]), 0) for i in range(12)]
    out = corpus_pipeline.without_boilerplate(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), sf).collect()
    assert len(out) == 12 and all(not set(block) & set(r.text.split("\n")) and r.n_chars == len(r.text) for r in out)


# Token counts


def test_rollup(spark, tmp_path):
    pytest.importorskip("tiktoken")
    from driftwell.llm.token_rollup import FOLDER, VERSIONS, _encoder, vocabulary

    roll = TokenRollup(spark, f"file://{tmp_path}/store")
    schema = "action string, doc_id long, source string, lang string, text string"
    first = [("insert", i, f"s{i % 2}" if i else None, "en", t) for i, t in enumerate(["a b", None, "", "Hello world, hello " * 50, "x" * 3000])]
    assert roll.commit(1, spark.createDataFrame(first, schema)) and roll.commit(2, spark.createDataFrame([("delete", 0, None, None, None), ("revise", 3, "s9", "de", "short now"), ("delete", 77, None, None, None), ("ignored", 4, None, None, "?")], schema))
    before = sorted(map(tuple, roll.totals().collect()), key=str)
    assert not roll.commit(2, spark.createDataFrame([("delete", 4, None, None, None)], schema))
    assert sorted(map(tuple, roll.totals().collect()), key=str) == before
    count = {v: (lambda t, e=_encoder(vocabulary(FOLDER, f)): len(e.encode_ordinary(t))) for v, f in VERSIONS.items()}
    want = Counter()
    docs = Counter()
    for s, l, t in (("s1", "en", ""), ("s0", "en", ""), ("s9", "de", "short now"), ("s0", "en", "x" * 3000)):
        for v in VERSIONS:
            want[s, l, v] += count[v](t)
            docs[s, l, v] += 1
    assert before == sorted(((*k, docs[k], want[k]) for k in docs), key=str)
    assert roll.committed() == [1, 2]
    with pytest.raises(ValueError, match="no vocabulary"):
        TokenRollup(spark, f"file://{tmp_path}/other", folder="/nowhere").commit(1, spark.createDataFrame(first, schema))


def test_rollup_over_many_batches(spark, tmp_path):
    """Random batches against a plain ledger; few tables stay, and a small batch reads its documents' buckets only."""
    pytest.importorskip("tiktoken")
    from driftwell.llm import token_rollup as tr

    rnd, one = random.Random(31), {"bpe-50k": tr.VERSIONS["bpe-50k"]}
    encoder = tr._encoder(tr.vocabulary(tr.FOLDER, one["bpe-50k"]))
    roll = TokenRollup(spark, f"file://{tmp_path}/store", one)
    held: dict[int, list] = {}
    for batch in range(7):
        rows = []
        for d in rnd.sample(range(300), 250 if batch == 0 else 9):
            action = "insert" if batch == 0 else rnd.choice(["insert", "delete", "revise"])
            rows.append((action, d, rnd.choice(["a", "b", None]), rnd.choice(["en", None]), rnd.choice([None, "", sentence(rnd, 6)])))
        assert roll.commit(batch, spark.createDataFrame(rows, "action string, doc_id long, source string, lang string, text string"))
        for action, d, s, l, t in rows:
            if action != "insert":
                held[d] = []
            if action != "delete":
                held.setdefault(d, []).append((s, l, len(encoder.encode_ordinary(t or ""))))
    want = defaultdict(lambda: [0, 0])
    for cells in held.values():
        for s, l, n in cells:
            want[s, l, "bpe-50k"][0] += 1
            want[s, l, "bpe-50k"][1] += n
    assert {tuple(r)[:3]: list(r)[3:] for r in roll.totals().collect()} == dict(want)
    assert Counter((r.doc_id, r.source, r.lang, r.tokens) for r in roll.ledger().collect() for _ in range(r.copies)) == Counter((d, *c) for d, cells in held.items() for c in cells)
    parts = roll._state()[0]
    assert len(parts) <= 4 and all(a[1] > b[1] for a, b in zip(parts, parts[1:]))
    read = roll.counted_before(spark.createDataFrame([(5,)], "doc_id long"))
    assert len({f.split("bucket=")[1].split("/")[0] for f in read.inputFiles()}) <= tr.BUCKETS
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("Aggregate") < plan.index("LeftSemi") and read.count() == len(set(held.get(5, [])))


def test_buckets_double_with_the_ledger(spark, tmp_path, monkeypatch):
    """Tables of different numbers of buckets are read together, each by its own."""
    from driftwell.llm import token_rollup as tr

    monkeypatch.setattr(tr, "BUCKETS", 2)
    monkeypatch.setattr(tr, "BUCKET_ROWS", 30)
    assert [tr.buckets_for(n) for n in (0, 60, 61, 500)] == [2, 2, 4, 32]
    roll = TokenRollup(spark, f"file://{tmp_path}/r")
    shape = "action string, doc_id long, source string, lang string, text string"
    roll.commit(1, spark.createDataFrame([("insert", i, "s", "en", "a b c") for i in range(300)], shape))
    roll.commit(2, spark.createDataFrame([("delete", i, None, None, None) for i in range(0, 300, 2)], shape))
    roll.commit(3, spark.createDataFrame([("revise", i, "t", "en", "a") for i in range(1, 40, 2)], shape))
    assert len({n for *_, n in roll._state()[0]}) > 1
    assert {(r.source, r.version): r.documents for r in roll.totals().collect()} == {(s, v): n for v in tr.VERSIONS for s, n in (("s", 130), ("t", 20))}
    assert roll.ledger().count() == 300


def test_corpus_rollup(spark, sf, awkward, docs):
    """The registered query against a plain count."""
    pytest.importorskip("tiktoken")
    from driftwell.llm import token_rollup as tr

    rows = [(r.doc_id, r.source, r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = rows[:150] + [(r[0], r[3], r[2], None if r[1] is None else r[1][:5000]) for r in awkward] + [(None, "s", None, "no id #")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, text string, tokens int, version string")
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    labels = [(r.doc_id, r.quality, r.toxic) for r in labels] + [(None, 0, 1), (3, None, None), (100, 0, 0), (101, 0, 1)]
    quality, toxic = defaultdict(list), defaultdict(list)
    for d, q, t in labels:
        quality[d] += [q] * (q is not None)
        toxic[d] += [t] * (t is not None)
    want = defaultdict(lambda: [0, 0])
    for d, s, l, t in rows:
        if d is not None and toxic[d] and max(toxic[d]) == 1:
            continue
        if d is not None and quality[d] and max(quality[d]) == 0:
            t = re.sub(r"[#$%&*!|]+", "", t) if t is not None else None
        for v, f in tr.VERSIONS.items():
            want[s, l, v][0] += 1
            want[s, l, v][1] += len(tr._encoder(tr.vocabulary(tr.FOLDER, f)).encode_ordinary(t or ""))
    got = tr.corpus_rollup(spark, df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r)[:3]: list(r)[3:] for r in got.collect()} == dict(want)
    assert tr.corpus_rollup(spark, df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


# Conversations


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there my friend\nhow are you doing today"), (1, 1, "assistant", "I am doing very fine thanks"), (1, 2, "user", "On Mon, X wrote:\n> hello  THERE my friend\n> how are you doing today\nI quote the first one"),
        (1, 3, "assistant", "> I quote the first one\n>> Hello there my friend\nYes you did\n\n"), (1, 4, "user", "> I am doing very fine thanks\nok"), (1, 5, "user", "> yes you did\nlast"),
        (2, 0, "user", "> I am doing very fine thanks\n> "), (2, 1, "user", "> later words come after this\nx"), (2, 2, "user", "later words come after this"), (None, 0, "u", None), (3, None, None, "> a b c d"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit(1)).withColumn("source", F.lit("s"))
    got = {(r.conv_id, r.turn): r for r in linked_conversations(spark, df).collect()}
    parents = {k: (r.parent_turn, r.thread_turn, r.reply_depth) for k, r in got.items()}
    assert parents[1, 2] == (0, 0, 1) and parents[1, 3] == (2, 0, 2) and parents[1, 4] == (1, 1, 1) and parents[1, 5] == (3, 0, 3)
    assert parents[2, 0] == (None, 0, 0) and parents[2, 1] == (None, 1, 0) and parents[None, 0] == (None, 0, 0)
    assert (got[1, 2].text, got[1, 3].text, got[1, 3].n_quotes) == ("I quote the first one", "Yes you did", 2)
    assert linked_conversations(spark, df.limit(0)).count() == 0


def quotes_brute(rows):
    """The links of every message by looking through all earlier ones; parents followed up one by one."""
    fold = lambda t: re.sub(r"[ \t\n\x0b-\x0d]+", " ", t.lower()).strip(" ")
    mark, wrote = re.compile(r"^(?:[ \t]*>)+"), re.compile(r"(?i)\bwrote:[ \t]*$")
    keys, body = {}, {}
    for c, t, _, text in rows:
        lines = [(m[0].count(">") if (m := mark.match(x)) else 0, mark.sub("", x)) for x in (text or "").split("\n")]
        own = keys.setdefault((c, t), {})
        kept = [x for i, (d, x) in enumerate(lines) if d == 0 and not (wrote.search(x) and i + 1 < len(lines) and lines[i + 1][0] > 0)]
        body[c, t] = "\n".join(kept).strip() if any(d for d, _ in lines) else text or ""
        i = 0
        while i < len(lines):
            j = i
            while j < len(lines) and lines[j][0] == lines[i][0]:
                j += 1
            whole = "\n".join(x for _, x in lines[i:j])
            paragraphs = re.split(r"\n\s*\n", whole)
            parts = [whole, *paragraphs, *whole.split("\n"), *(s for p in paragraphs for s in re.split(r"(?<=[.!?]) ", fold(p)))]
            for k, p in enumerate(map(fold, parts)):
                n = len(p.split(" ")) if p else 0
                if n >= 3:
                    own[lines[i][0], p] = (n, own.get((lines[i][0], p), (0, False))[1] or k == 0)
                elif n and k == 0 and lines[i][0]:
                    own[lines[i][0], "few", p] = (n, True)
            i = j
        if 1 <= len(fold(body[c, t]).split(" ")) < 3 and fold(body[c, t]):
            own[0, "few", fold(body[c, t])] = (1, False)
    out, parent = {}, {}
    for (c, t), own in sorted(keys.items()):
        found, linked = Counter(), 0
        for (depth, *text), (n, _) in own.items():
            origins = [u for (d, u), other in keys.items() if d == c and u < t and (0, *text) in other] if depth else []
            if origins:
                found[depth, max(origins)] += n
                linked += 1
        if found:
            parent[c, t] = max(found, key=lambda k: (-k[0], found[k], k[1]))[1]
        top, deep = t, 0
        while (c, top) in parent:
            top, deep = parent[c, top], deep + 1
        out[c, t] = (body[c, t], parent.get((c, t)), top, deep, sum(1 for (d, *_), (_, w) in own.items() if d and w), linked)
    return out


def test_quotes_equal_brute_force(spark):
    """Generated threads: whole and partial quotations, wrapped anew, of paragraphs, sentences and a few words, nested."""
    rnd = random.Random(61)
    rows = []
    for c in range(4):
        texts = []
        for t in range(rnd.choice([1, 40, 120])):
            say = lambda n: sentence(rnd, n).capitalize() + "."
            own = rnd.choice([say(8) + " " + say(5), f"{say(9)}\n{say(4)}\n\n{say(12)} {say(6)}", rnd.choice(["Yes please", "No"]), "", say(3)])
            if texts and rnd.random() < 0.6:
                old = rnd.choice(texts[-20:])
                cut = rnd.choice([old, old.split("\n\n")[-1], rnd.choice(re.split(r"(?<=[.]) ", old)), old.replace(" ", "\n", 2), old.replace("\n", " ").upper()])
                own = rnd.choice(["On day X, Y wrote:\n", ""]) + "\n".join(f"{rnd.choice(['> ', '>', ' > '])}{x}" for x in cut.split("\n")) + "\n" + own
            texts.append(own)
            rows.append((c, t, "user", own))
    got = linked_conversations(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = quotes_brute(rows)
    assert {(r.conv_id, r.turn): (r.text, r.parent_turn, r.thread_turn, r.reply_depth, r.n_quotes, r.n_linked) for r in got} == want and len(got) == len(rows)
    assert sum(w[1] is not None for w in want.values()) > 50


def test_quotes_in_long_and_repeated_rows(spark):
    """One message of many lines, read in time that follows its lines; rows that repeat a turn; odd marks."""
    lines = [f"line {i} of the long message" for i in range(6000)]
    rows = [(1, 0, "u", "\n".join(lines)), (1, 1, "u", "\n".join("> " + x for x in lines) + "\nlong reply"), (1, 2, "u", "> line 17 of the long message\nshort"), (1, 2, "u", "> line 17 of the long message\nshort")]
    rows += [(2, 0, None, "\u0001|x 1|2 a b"), (2, 1, "u", "> \u0001|x 1|2 a b"), (2, 2, "u", "  kept as it is \n")]
    got = linked_conversations(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == 7 and by[1, 1].parent_turn == 0 and by[1, 2].parent_turn == 0 and by[1, 1].text == "long reply" and by[2, 2].text == "  kept as it is \n" and by[2, 1].parent_turn == 0


def test_quotes_over_ranges_of_turns(spark, monkeypatch):
    from driftwell.llm import quote_linking

    monkeypatch.setattr(quote_linking, "RANGE", 4)
    rows = [(1, t, "user", "the very same words" if t in (0, 9) else f"> the very same words\nreply {t}" if t in (3, 8, 20) else f"turn {t}") for t in range(21)]
    got = {r.turn: r.parent_turn for r in linked_conversations(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[3], got[8], got[20]) == (0, 0, 9)
