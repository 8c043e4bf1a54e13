"""Spelling variants, WARC archives and collocations against brute force, on real small tables and on awkward rows."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import collocation, spelling, warc
from driftwell.llm.collocation import Collocations, collocations
from driftwell.llm.spelling import Spelling, spelling_variants

from .test_operators import SCHEMA, awkward, docs, lowered, real  # noqa: F401


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# Spelling variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def variants_of(counts, times=2):
    """word, form, root, n, n_near, form_n by comparing each word with all of its length and of the next; no roots at 0 times."""
    near = defaultdict(set)
    by_length = defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    for length, own in by_length.items():
        for a, b in itertools.chain(itertools.combinations(own, 2), itertools.product(own, by_length.get(length + 1, []))):
            if one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= times * n else None

    def root(w):
        while times and form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), counts[form[w]] if form[w] else -1) for w, n in counts.items())


def word_counts(rows, letters=5, least=3, every=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= letters and n >= least}


def variants(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


@pytest.mark.parametrize("table", ["docs", "real"])
def test_spelling_variants(spark, request, table):
    df = request.getfixturevalue(table)
    got = variants(spelling_variants(spark, df, Spelling(leaf=64)))
    assert got == variants_of(word_counts(rows_of(df, "doc_id", "text")))
    assert got


def test_spelling_of_runs_at_the_edges(spark):
    """Upper case letters with accents stay, x and division signs are letters, every second run loses one; null ids."""
    rnd = random.Random(2)
    runs = ["Straße", "STRAßE", "étÉs×÷", "ab", "naïve", "naive", "nativ", "nave", "Ωmega", "ÀÀÀÀÀÀ"]
    rows = [(None if i % 7 == 0 else i, " ".join(rnd.choice(runs) for _ in range(40))) for i in range(60)] + [(5, None), (6, ""), (7, "a1b2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert variants(spelling_variants(spark, df, Spelling(every=2, letters=3))) == variants_of(word_counts(rows, 3, 3, 2))


def test_spelling_of_anagrams_and_dense_words(spark):
    """Words alike in their letters can't be divided by any cut: their leaf is dealt out, and pairs meet by what is left."""
    rnd = random.Random(3)
    anagrams = ["".join(p) for p in itertools.permutations("abcdef")]
    others = ["".join(p) for p in itertools.permutations("abcdeg")]
    longer = {w[:i] + "g" + w[i:] for w in rnd.sample(anagrams, 80) for i in range(7)}
    dense = {"".join(rnd.choice("xy") for _ in range(rnd.choice((7, 8, 9)))) for _ in range(400)}
    counts = {w: rnd.randrange(3, 40) for w in {*anagrams, *others, *longer, *dense}}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = spelling.near_words(spark, words, Spelling(leaf=50)).collect()
    want = {w: (n_near, form, form_n) for w, form, _, _, n_near, form_n in variants_of(counts, 0)}
    assert {r.word: (r.n_near, r.form or "", -1 if r.form_n is None else r.form_n) for r in got} == want
    assert len(got) == len(counts)


def test_near_pairs_of_random_words():
    rnd = random.Random(5)
    for _ in range(40):
        size = rnd.randrange(1, 7)
        letters = rnd.choice(("ab", "abc", "aéÿ"))
        for step, (add, take) in {0: (1, 1), 1: (1, 0), -1: (0, 1)}.items():
            if size - step < 1:
                continue
            own = sorted({"".join(rnd.choice(letters) for _ in range(size)) for _ in range(rnd.randrange(1, 60))})
            asks = sorted({"".join(rnd.choice(letters) for _ in range(size - step)) for _ in range(rnd.randrange(1, 60))})
            rows = lambda ws, n: np.frombuffer("".join(ws).encode("latin-1"), np.uint8).reshape(-1, n)
            got = [(own[i], asks[j]) for a, b in spelling.near_pairs(rows(own, size), rows(asks, size - step), add, take) for i, j in zip(a, b, strict=True)]
            want = [(a, b) for a in own for b in asks if one_edit(a, b)]
            assert sorted(got) == sorted(want)
            i, j = spelling._pairs_alike(rows(own, size), rows(asks, size - step))
            assert {(own[a], asks[b]) for a, b in zip(i, j, strict=True)} >= set(want)


def test_tree_reaches_every_leaf_it_must():
    """No leaf with a point within the budget is left out, and each point has one home among those it reaches."""
    rnd = np.random.default_rng(6)
    points = np.minimum(rnd.poisson(0.6, (800, spelling._DIMENSIONS)), 5).astype(np.int16)
    tree = spelling.Tree.fitted(points, 40)
    home = tree.homes(points, np.zeros(len(points), np.int64))
    assert len(set(home.tolist())) > 20
    for add, take in ((1, 1), (0, 1), (1, 0)):
        moved = points.copy()
        dims = rnd.integers(0, spelling._DIMENSIONS, (2, len(points)))
        rows = np.arange(len(points))
        if add:
            moved[rows, dims[0]] += 1
        if take:
            moved[rows, dims[1]] -= moved[rows, dims[1]] > 0
        reached = set(zip(*(x.tolist() for x in tree.reached(points, add, take)), strict=True))
        target = tree.homes(moved, np.zeros(len(points), np.int64))
        assert all((i, leaf) in reached for i, leaf in enumerate(target.tolist()))


def test_spelling_of_long_words_and_texts(spark):
    long = "ab" * 400
    rows = [(i, f"{long} {long[:-1]}c {'x' * 70_000} {'x' * 70_001}" + " filler" * 300_000 * (i == 1)) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert variants(spelling_variants(spark, df)) == variants_of(word_counts(rows))


def test_chunks_cut_no_run(monkeypatch):
    monkeypatch.setattr(spelling, "_CHUNK", 5)
    rnd = random.Random(9)
    for _ in range(300):
        text = "".join(rnd.choice("abéÿ Ω.ÿ漢") for _ in range(rnd.randrange(0, 40))).encode()
        parts = list(spelling._chunks(text))
        assert b"".join(parts) == text
        assert [r for p in parts for r in spelling._RUN.findall(p)] == spelling._RUN.findall(text)


def test_roots_follow_chains(spark):
    from driftwell.llm.scratch import Scratch

    forms = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [(f"v{i}", "w5") for i in range(50)]
    got = dict(tuple(r) for r in spelling.roots(Scratch(spark, "t"), spark.createDataFrame(forms, "word string, form string")).collect())
    assert set(got.values()) == {"w37"} and len(got) == 87


def test_spelling_of_nothing(spark, docs):  # noqa: F811
    out = spelling_variants(spark, docs.limit(0))
    assert out.count() == 0 and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling_variants(spark, spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")).count() == 0


# WARC


def report_brute(rows, least=100):
    firsts = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        if len(body) >= least and page_id is not None:
            firsts[body] = min(page_id, firsts.get(body, page_id))
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        first = firsts.get(body)
        again = first is not None and page_id != first
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    copy, other = "<p>é</p>" * 40, "x" * 100
    rows = [
        (5, "http://a/?q=a%20b", copy), (3, "http://b", copy), (9, None, copy), (None, "http://c", copy), (1, "u v\r\nWARC-Type: x", "x" * 99), (2, "u", "x" * 99), (7, "", None), (8, "u", ""), (4, "é", other), (6, "u", other), (6, "u", other), (4, "é", other),
        (-2, "u", "WARC/1.1\r\n\r\nno header\r\n\r\n" * 9), (10, "u", "\u0000" * 120), (None, "n", "only without id" * 20), (None, "n", "only without id" * 20), (11, "u", "z" * 3_000_000),
    ]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, offset int").repartition(3)


def test_warc_report(spark, pages, sf):
    got = sorted((tuple(r) for r in warc.page_report(spark, pages).collect()), key=str)
    assert got == report_brute(rows_of(pages, "page_id", "url", "html"))
    real = spark.read.parquet(f"{sf}/pages.parquet")
    doubled = real.unionByName(real.select((F.col("page_id") + 1_000_000).alias("page_id"), "url", "html"))
    got = sorted((tuple(r) for r in warc.page_report(spark, doubled, warc.Warc(archive_bytes=20_000, stretch_bytes=5_000, read_bytes=3_000)).collect()), key=str)
    assert got == report_brute(rows_of(doubled, "page_id", "url", "html"))
    empty = warc.page_report(spark, pages.limit(0))
    assert empty.count() == 0 and empty.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_archives_are_plain_warc_and_scanned_archives_have_the_same_index(spark, pages, tmp_path):
    index = warc.write_archives(spark, pages, f"file://{tmp_path}/out", warc.Warc(archive_bytes=500))
    rows = index.collect()
    assert len(rows) == pages.count() and len({r.archive for r in rows}) > 3
    for r in rows:
        with open(r.archive.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            fields, body = warc.parsed(gzip.decompress(f.read(r.length)))
        assert fields["warc-type"] == r.record_type and int(fields["content-length"]) == len(body)
        assert body == b"" or hashlib.sha256(body).hexdigest() == r.digest
    scanned = warc.index_archives(index.select("archive").distinct(), warc.Warc(read_bytes=700))
    key = ["archive", "offset", "length", "digest", "record_type"]
    assert sorted(map(str, rows_of(scanned, *key))) == sorted(map(str, rows_of(index, *key)))


def test_plain_archives_are_scanned_and_read(spark, tmp_path):
    bodies = [b"", b"one", b"\r\n\r\n" * 5, bytes(range(256)) * 40]
    data = b"".join(warc.record(f"urn:x:{i}", f"http://{i}", "0" * 64, b) for i, b in enumerate(bodies))
    (tmp_path / "a.warc").write_bytes(data)
    index = warc.index_archives(spark.createDataFrame([(f"file://{tmp_path}/a.warc",)], "archive string"), warc.Warc(read_bytes=50))
    got = {r.record_id: bytes(r.payload) for r in warc.read_records(index).collect()}
    assert got == {f"urn:x:{i}": b for i, b in enumerate(bodies)}
    (tmp_path / "cut.warc").write_bytes(data[:-20])
    with pytest.raises(Exception, match="ends inside a record"):
        warc.index_archives(spark.createDataFrame([(f"file://{tmp_path}/cut.warc",)], "archive string")).collect()


def test_selected_records_only(spark, pages, tmp_path):
    index = warc.write_archives(spark, pages.where("page_id is not null"), f"file://{tmp_path}/out")
    some = warc.read_records(index.where("url = 'u'")).select("record_id", "record_type", "url")
    assert {(r.record_id, r.record_type) for r in some.collect()} == {(f"urn:page:{i}", "revisit" if i == 6 else "response") for i in (2, 8, 6, -2, 10, 11)}
    escaped = warc.read_records(index).where("record_id = 'urn:page:1'").first()
    assert escaped.url == "u%20v%0D%0AWARC-Type:%20x" and escaped.record_type == "response"


def test_reads_are_coalesced():
    offsets, lengths = np.array([0, 10, 50, 51, 500, 2000]), np.array([10, 10, 1, 5, 900, 1])
    assert warc.coalesced(offsets, lengths, 30, 100) == [(0, 4), (4, 5), (5, 6)]
    assert warc.coalesced(offsets, lengths, 10_000, 10_000) == [(0, 6)]
    assert warc.coalesced(offsets, lengths, 0, 15) == [(0, 1), (1, 2), (2, 4), (4, 5), (5, 6)]
    assert warc.coalesced(offsets[:0], lengths[:0], 0, 15) == []


# Collocations


def phrases_brute(rows, cfg):
    counts = defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, cfg.longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        own = {p: a for p, a in f.items() if len(p) > 1 and a >= cfg.least}
        table = []
        for p, a in own.items():
            score, k = min((cfg.scale * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            held = any(100 * b >= cfg.inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in own.items() if len(q) > len(p))
            if not held:
                table.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(table)[: cfg.top], 1)]
    return sorted(out)


@pytest.mark.parametrize("cfg", [Collocations(), Collocations(least=2, top=40), Collocations(longest=4, least=3, inside=70), Collocations(longest=2, least=2)])
def test_collocations(spark, real, cfg):  # noqa: F811
    df = real.where("doc_id % 3 = 0")
    got = sorted(tuple(r) for r in collocations(spark, df, cfg).collect())
    assert got == phrases_brute(rows_of(df, "text", "lang"), cfg) and got


def test_collocations_of_awkward_rows(spark, docs):  # noqa: F811
    cfg = Collocations(least=2, top=50)
    rnd = random.Random(7)
    base = [(" ".join(rnd.choice(("A", "b", "CÉ", "d", "é", "\x00", "x y", "e.", "f\r\ng", "h\x0bi", "\t", "", ",")) for _ in range(60)), rnd.choice(("en", None, "und", "x y"))) for _ in range(40)]
    rows = [*base, *base[:3], (None, "en"), ("", None), (" . , ", "de"), ("one", "fr")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "text string, lang string, w1 int, prefix string")
    got = sorted(tuple(r) for r in collocations(spark, df, cfg).collect())
    assert got == phrases_brute(rows, cfg) and {r[0] for r in got} == {"en", "und", "x y"}
    few = docs.where(F.length("text") < 10_000)
    assert sorted(tuple(r) for r in collocations(spark, few, cfg).collect()) == phrases_brute(rows_of(few, "text", "lang"), cfg)
    empty = collocations(spark, docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3 * 10**12 + 7, 5 * 10**12 + 11, 4 * 10**12 + 1
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocation._score(Collocations(), F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row.s == 10**6 * a * a // (left * right)
