"""Spelling variants by k-d trees over letter counts.

A word is a point: how often it has each letter.  One inserted letter adds one to one count, one deleted letter takes one
away, one replaced letter does both; so words that are one edit apart are at most two apart in L1, and what is added and what
is taken away is at most one each.

The words of one length are in one tree.  Its upper part is fitted on a bounded sample, and only says which task a point goes
to; every word is in exactly one leaf, and goes as a question to each leaf of its own, the next longer and the next shorter
length whose box it can reach by one edit.  So all words near a point meet it in one task.  There the tree goes on: boxes are
drawn tightly around the points that are left, questions that can't reach a box leave it, and of few points each is
compared letter by letter.

The words near a word give its form; roots are found by doubling along the forms.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import textkernel as tk
from driftwell.llm.scratch import Scratch, settings


@dataclass(frozen=True)
class Spelling:
    """Words of ``letters`` code points and ``least`` occurrences; a form has ``times`` the occurrences of its word.

    Every ``every``-th (document, word) loses a letter first; 0: none does.  Trees are fitted on a sample of about ``sample``
    words (all lengths together), for leaves of ``leaf`` words; results don't depend on either.
    """

    letters: int = 5
    least: int = 3
    times: int = 2
    every: int = 97
    sample: int = 200_000
    leaf: int = 4096


#: Letters are those of Latin-1 that are left when A-Z are folded: one byte each there, two in UTF-8 from U+00C0 on.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_REST = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])*")
_DIMENSIONS = 26 + 64
_DIMENSION = np.zeros(256, np.int64)
_DIMENSION[97:123] = np.arange(26)
_DIMENSION[0xC0:] = np.arange(26, _DIMENSIONS)
#: A cut that leaves less on a side is none.
_EVEN = 0.02
#: Bytes of text at once, distinct words that a task holds, cut values that are tried, sampled words for a leaf at least, points that
#: are compared one by one, and pairs that are compared at once.
_CHUNK, _HELD, _CUTS, _FEW, _NEXT, _PAIRS = 1 << 20, 300_000, 8, 16, 8, 1 << 18
_rng = np.random.default_rng(1984)
#: What a question may add to its letters, and take away from them, to become a point of this tree.
_ROLES = {0: (1, 1), -1: (0, 1), 1: (1, 0)}
POINT = 9


def _chunks(text: bytes) -> Iterator[bytes]:
    """Parts of a text that no run of letters crosses."""
    a = 0
    while a < len(text):
        b = min(a + _CHUNK, len(text))
        while b < len(text) and 0x80 <= text[b] < 0xC0:
            b -= 1
        b = _REST.match(text, b).end() if b < len(text) else b
        yield text[a:b]
        a = b


def _shortened(word: bytes, h: int) -> bytes:
    letters = word.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _word_counts(cfg: Spelling):
    def emit(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            data, offsets = tk.buffers(batch.column(1))
            low = tk.LOWER[data].tobytes()
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                own: Counter = Counter()
                for part in _chunks(low[offsets[i] : offsets[i + 1]]):
                    own.update(_RUN.findall(part))
                seed = zlib.crc32(f"{doc_id}:".encode())
                for word, n in own.items():
                    if len(word) >= cfg.letters:
                        h = zlib.crc32(word, seed)
                        held[_shortened(word, h) if cfg.every and h % cfg.every == 0 else word] += n
                if len(held) >= _HELD:
                    yield emit(held)
                    held = Counter()
        yield emit(held)

    return run


def word_counts(docs: DataFrame, cfg: Spelling = Spelling()) -> DataFrame:
    """(word, n): the words of ``docs`` (columns doc_id and text) that are long and frequent enough."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Each task has summed up its own words, so a word that every document has arrives a few times a task.
    return texts.mapInArrow(_word_counts(cfg), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= cfg.least) & (F.char_length("word") >= cfg.letters))


def letter_counts(words: np.ndarray) -> np.ndarray:
    """Points of words of one length, a row of Latin-1 bytes each."""
    n, length = words.shape
    out = np.zeros((n, _DIMENSIONS), np.int16 if length < 1 << 15 else np.int64)
    if length <= 256:
        rows = np.arange(n)
        for j in range(length):
            out[rows, _DIMENSION[words[:, j]]] += 1
    else:
        for i in range(n):
            out[i] = np.bincount(_DIMENSION[words[i]], minlength=_DIMENSIONS)
    return out


@dataclass
class Tree:
    """The upper part of one length's tree: inner nodes (dimension, cut, left, right) and leaves (first number, how many).

    Points up to the cut are on the left.  Negative nodes are leaves; one that no cut divides has several numbers, by which its
    points are dealt out, since points alike are never near each other.
    """

    nodes: list[tuple[int, int, int, int]]
    leaves: list[tuple[int, int]]

    @classmethod
    def fitted(cls, points: np.ndarray, leaves: int) -> Tree:
        tree, used = cls([], []), 0

        def leaf(blocks: int) -> int:
            nonlocal used
            tree.leaves.append((used, blocks))
            used += blocks
            return -len(tree.leaves)

        def grow(own: np.ndarray, leaves: int) -> int:
            if leaves <= 1 or len(own) < 2:
                return leaf(max(1, leaves))
            share = np.stack([(own <= c).mean(axis=0) for c in range(_CUTS)])
            even = np.minimum(share, 1 - share)
            cut, dimension = np.unravel_index(int(even.argmax()), even.shape)
            if even[cut, dimension] < _EVEN:
                return leaf(leaves)
            low = own[:, dimension] <= cut
            at = len(tree.nodes)
            tree.nodes.append((0, 0, 0, 0))
            part = min(leaves - 1, max(1, round(leaves * float(low.mean()))))
            tree.nodes[at] = (int(dimension), int(cut), grow(own[low], part), grow(own[~low], leaves - part))
            return at

        grow(points, leaves)
        return tree

    def homes(self, points: np.ndarray, salts: np.ndarray) -> np.ndarray:
        """The leaf number of each point."""
        out = np.zeros(len(points), np.int64)
        stack = [(0 if self.nodes else -1, np.arange(len(points)))]
        while stack:
            at, own = stack.pop()
            if not len(own):
                continue
            if at < 0:
                first, blocks = self.leaves[-at - 1]
                out[own] = first + salts[own] % blocks
                continue
            dimension, cut, left, right = self.nodes[at]
            low = points[own, dimension] <= cut
            stack += [(left, own[low]), (right, own[~low])]
        return out

    def reached(self, points: np.ndarray, add: int, take: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf number) for every leaf whose box a point reaches with ``add`` letters more and ``take`` letters less."""
        rows: list[np.ndarray] = []
        numbers: list[np.ndarray] = []
        everything = np.arange(len(points))
        stack: list[tuple] = [(0 if self.nodes else -1, everything, np.zeros(len(points), np.int64), np.zeros(len(points), np.int64), {}, {})]
        while stack:
            at, own, added, taken, low, high = stack.pop()
            if not len(own):
                continue
            if at < 0:
                first, blocks = self.leaves[-at - 1]
                for b in range(blocks):
                    rows.append(own)
                    numbers.append(np.full(len(own), first + b, np.int64))
                continue
            d, cut, left, right = self.nodes[at]
            x = points[own, d].astype(np.int64)
            # Along a dimension that was cut before, the new bound takes the place of the old one.
            more = taken + np.maximum(x - cut, 0) - (np.maximum(x - high[d], 0) if d in high else 0)
            ok = more <= take
            stack.append((left, own[ok], added[ok], more[ok], low, high | {d: cut}))
            more = added + np.maximum(cut + 1 - x, 0) - (np.maximum(low[d] - x, 0) if d in low else 0)
            ok = more <= add
            stack.append((right, own[ok], more[ok], taken[ok], low | {d: cut + 1}, high))
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(rows or empty), np.concatenate(numbers or empty)


_WHOLE = Tree([], [(0, 1)])


def _grown(words: DataFrame, cfg: Spelling) -> dict[int, Tree]:
    """Trees of the lengths that have more words than a leaf, fitted on a sample that is the same in every run."""
    by_length = {r.length: r.words for r in words.groupBy(F.char_length("word").alias("length")).agg(F.count("*").alias("words")).where(F.col("words") > cfg.leaf).collect()}
    if not by_length:
        return {}
    rate = min(1.0, cfg.sample / sum(by_length.values()))
    some = words.where(F.char_length("word").isin(list(by_length)) & (F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < int(rate * 1_000_000)))
    samples: dict[int, list[bytes]] = {}
    for r in some.select("word").toLocalIterator():
        samples.setdefault(len(r.word), []).append(r.word.encode("latin-1"))
    trees = {}
    for length, own in samples.items():
        points = letter_counts(np.frombuffer(b"".join(own), np.uint8).reshape(-1, length))
        trees[length] = Tree.fitted(points, min(-(-by_length[length] // cfg.leaf), max(1, len(own) // _FEW)))
    return trees


_SENT = "length long, leaf long, role int, word binary, n long"


def _router(trees: dict[int, Tree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            n = batch.column(1).to_numpy(zero_copy_only=False)
            sizes = np.array([len(w) for w in words], np.int64)
            for length in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == length)
                points = letter_counts(np.frombuffer(b"".join(words[i] for i in own), np.uint8).reshape(-1, length))
                tree = trees.get(length, _WHOLE)
                home = tree.homes(points, np.array([zlib.crc32(words[i]) for i in own], np.int64))
                out = [(length, np.arange(len(own)), home, POINT)]
                for step, (add, take) in _ROLES.items():
                    rows, leaves = trees.get(length + step, _WHOLE).reached(points, add, take)
                    if step == 0:  # a point is a question in its own leaf anyway
                        rows, leaves = rows[leaves != home[rows]], leaves[leaves != home[rows]]
                    # Seen from the leaf, the question is so much longer or shorter.
                    out.append((length + step, rows, leaves, -step))
                for to, rows, leaves, role in out:
                    for a in range(0, len(rows), 100_000):
                        r = own[rows[a : a + 100_000]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(r), to)), pa.array(leaves[a : a + 100_000]), pa.array(np.full(len(r), role, np.int32)), pa.array([words[i] for i in r], pa.binary()), pa.array(n[r])],
                            ["length", "leaf", "role", "word", "n"],
                        )

    return run


def _one_edit(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row: is there exactly one inserted, deleted or replaced letter between two words?"""
    if p.shape[1] == q.shape[1]:
        return (p != q).sum(axis=1) == 1
    short, long = (p, q) if p.shape[1] < q.shape[1] else (q, p)
    front = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= short.shape[1]


def _blanked(words: np.ndarray, drop: bool) -> np.ndarray:
    """(row, position) hashes of the words without the letter at each position; with ``drop`` the rest closes up."""
    times = np.random.default_rng(11).integers(1, 1 << 63, words.shape[1] + 1, dtype=np.uint64) | np.uint64(1)
    letters = tk._LETTER[words]
    here = letters * times[: words.shape[1]]
    if not drop:
        return here.sum(axis=1, keepdims=True) - here + tk.mix(np.arange(words.shape[1], dtype=np.uint64) + np.uint64(1))
    before = np.cumsum(here, axis=1) - here
    closed = letters[:, 1:] * times[: words.shape[1] - 1]
    after = np.zeros_like(here)
    after[:, :-1] = closed[:, ::-1].cumsum(axis=1)[:, ::-1]
    return before + after


def _whole(words: np.ndarray) -> np.ndarray:
    times = np.random.default_rng(11).integers(1, 1 << 63, words.shape[1] + 2, dtype=np.uint64) | np.uint64(1)
    return (tk._LETTER[words] * times[: words.shape[1]]).sum(axis=1, keepdims=True)


def _pairs_alike(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of many points of one box and many questions: they meet by what is left when one letter is taken out."""
    if p.shape[1] == q.shape[1]:
        a, b = _blanked(p, False), _blanked(q, False)
    else:
        a, b = (_blanked(p, True), _whole(q)) if p.shape[1] > q.shape[1] else (_whole(p), _blanked(q, True))
    rows_a, rows_b = (np.repeat(np.arange(len(x)), x.shape[1]) for x in (a, b))
    a, b = a.ravel(), b.ravel()
    order = np.argsort(a, kind="stable")
    a, rows_a = a[order], rows_a[order]
    first, last = np.searchsorted(a, b, "left"), np.searchsorted(a, b, "right")
    many = last - first
    at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    found = np.unique(np.column_stack([rows_a[at], np.repeat(rows_b, many)]), axis=0) if len(at) else np.zeros((0, 2), np.int64)
    return found[:, 0], found[:, 1]


def near_pairs(p: np.ndarray, q: np.ndarray, add: int, take: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(point, question) rows that are one edit apart, in parts; ``add`` and ``take`` say what turns a question into a point."""
    cp, cq = letter_counts(p), letter_counts(q)
    used = np.flatnonzero(cp.any(axis=0) | cq.any(axis=0))
    cp, cq = np.ascontiguousarray(cp[:, used]), np.ascontiguousarray(cq[:, used])
    stack = [(np.arange(len(p)), np.arange(len(q)))]
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def checked() -> tuple[np.ndarray, np.ndarray]:
        i, j = (np.concatenate(x) for x in zip(*kept, strict=True))
        ok = _one_edit(p[i], q[j])
        return i[ok], j[ok]

    while stack:
        own, asks = stack.pop()
        box = cp[own]
        low, high = box.min(axis=0), box.max(axis=0)
        x = cq[asks]
        added, taken = np.maximum(low - x, 0).sum(axis=1), np.maximum(x - high, 0).sum(axis=1)
        asks = asks[(added <= add) & (taken <= take)]
        if not len(asks):
            continue
        alike = bool((low == high).all())
        if alike and len(own) * len(asks) > _PAIRS // 16:
            i, j = _pairs_alike(p[own], q[asks])
            new = [(own[i[a : a + _PAIRS]], asks[j[a : a + _PAIRS]]) for a in range(0, len(i), _PAIRS)]
        elif alike or len(own) <= _NEXT:
            step = max(1, _PAIRS // len(own))
            new = [(np.tile(own, len(part)), np.repeat(part, len(own))) for part in (asks[a : a + step] for a in range(0, len(asks), step))]
        else:
            d = int(box.var(axis=0).argmax())
            left = box[:, d] <= np.floor(box[:, d].mean())
            stack += [(own[left], asks), (own[~left], asks)]
            continue
        for pair in new:
            kept.append(pair)
            held += len(pair[0])
            if held >= _PAIRS:
                yield checked()
                kept, held = [], 0
    if kept:
        yield checked()


_NEAR = "word string, n long, n_near long, form string, form_n long"


def _leaf(table: pa.Table) -> pa.Table:
    """The points of one leaf with the number of near words and the most frequent of them."""
    table = table.combine_chunks()
    role, n = table["role"].to_numpy(), table["n"].to_numpy()
    length = int(table["length"][0].as_py())

    def rows(mask: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(mask)
        return np.frombuffer(b"".join(table["word"].take(pa.array(own)).to_pylist()), np.uint8).reshape(-1, size), n[own]

    p, pn = rows(role == POINT, length)
    count, best_n, best = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), np.zeros(len(p), f"S{length + 1}")
    for step, (add, take) in _ROLES.items() if len(p) else ():
        # Questions that are ``-step`` longer become points by adding and taking as much.
        size = length - step
        q, qn = rows((role == POINT) | (role == 0) if step == 0 else role == -step, size)
        if not len(q) or size < 1:
            continue
        names = np.ascontiguousarray(q).view(f"S{size}").ravel().astype(f"S{length + 1}")
        for i, j in near_pairs(p, q, add, take):
            count += np.bincount(i, minlength=len(p))
            order = np.lexsort((names[j], -qn[j], i))
            i, j = i[order], j[order]
            head = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
            i, j = i[head], j[head]
            better = (qn[j] > best_n[i]) | ((qn[j] == best_n[i]) & (names[j] < best[i]))
            best_n[i[better]], best[i[better]] = qn[j[better]], names[j[better]]
    text = lambda x: x.tobytes().decode("latin-1") if isinstance(x, np.ndarray) else x.decode("latin-1")
    forms = pa.array([text(b) if c else None for b, c in zip(best.tolist(), count.tolist(), strict=True)], pa.string())
    form_n = pa.array(best_n, mask=count == 0)
    return pa.Table.from_arrays([pa.array([text(w) for w in p], pa.string()), pa.array(pn), pa.array(count), forms, form_n], ["word", "n", "n_near", "form", "form_n"])


def near_words(spark: SparkSession, words: DataFrame, cfg: Spelling = Spelling()) -> DataFrame:
    """word, n, n_near, form and form_n of every row of ``words`` (word, n; a table, words once each, letters of Latin-1).

    ``form`` is the most frequent near word, of equally frequent ones the first by code points; null if no word is near.
    """
    trees = _grown(words, cfg)
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="50000"):
        sent = words.select("word", "n").mapInArrow(_router(trees), _SENT)
        found = sent.groupBy("length", "leaf").applyInArrow(_leaf, _NEAR)
        return Scratch(spark, "spelling-near").keep(found, "near")


def roots(scratch: Scratch, forms: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root): the end of the forms that start at each row of ``forms`` (word, form; no cycles).

    Each round follows every chain twice as far.  A form that very many words have meets one row; both sides are tables.
    """
    ahead = scratch.keep(forms.select("word", F.col("form").alias("root")), "roots-0")
    for i in range(1, rounds + 1):
        more = ahead.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        ahead = scratch.keep(ahead.join(more, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), f"roots-{i}")
        if ahead.where("moved").limit(1).count() == 0:
            return ahead.drop("moved")
        ahead = ahead.drop("moved")
    raise RuntimeError(f"chains of forms did not end in {rounds} rounds")


def spelling_variants(spark: SparkSession, docs: DataFrame, cfg: Spelling = Spelling()) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs`` (columns doc_id and text) that is long and frequent enough.

    Null and empty texts have no words; texts of any length are read in parts.  A null doc_id counts as an empty one; rows
    that repeat count as often as they stand there.  Of near words with equal numbers the first by code points is the form;
    a word without a frequent near word has no form and is its own root.  An empty table gives an empty result.
    """
    scratch = Scratch(spark, "spelling")
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="2000"):
        words = scratch.keep(word_counts(docs, cfg), "words")
    near = near_words(spark, words, cfg)
    fits = F.col("form_n") >= cfg.times * F.col("n")
    near = near.select("word", "n", "n_near", F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"))
    ends = roots(scratch, near.where("form is not null"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB twin of op11_spelling_variants: words meet by what is left when one letter is taken out.  Bytes of UTF-8 go through the CRC
#: one by one; letters from U+00C0 on are 0xC3 and their code less 64.
ORACLE = r"""
WITH RECURSIVE table256 AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL),
each AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (
  SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM each),
hashed AS (SELECT run, k, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT)) AS h FROM bytes, table256),
words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 97 = 0 THEN run[1:(h % length(run))] || run[(h % length(run) + 2):] ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
spots AS (SELECT word, n, length(word) AS size, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT word, n, size, i, word[1:(i - 1)] || word[(i + 1):] AS rest FROM spots),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, b.n_near, b.m AS form_n, min(p.other) AS form FROM words w JOIN best b ON w.word = b.word JOIN pairs p ON p.word = b.word AND p.m = b.m WHERE b.m >= 2 * w.n GROUP BY ALL),
chain AS (SELECT word, form AS last FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON chain.last = forms.word),
ends AS (SELECT word, last AS root FROM chain WHERE last NOT IN (SELECT word FROM forms))
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM words w LEFT JOIN forms f ON w.word = f.word LEFT JOIN best b ON w.word = b.word LEFT JOIN ends e ON w.word = e.word
"""
