"""Phrase collocations by marginalising the longest windows.

Every word occurrence opens one window of ``longest`` words, padded where its piece ends.  These windows are the only n-grams
that are taken from the texts: sums over ever shorter prefixes give the count of every shorter phrase, of every word and of
all words of a language.  (A phrase of k words is the prefix of as many windows as it occurs, for each occurrence opens one.)

The windows travel as one string, their words with a blank between them; a padded window has fewer words.  Windows, and then
prefixes, that are too rare to be phrases themselves are folded into their next shorter prefix before it is summed, so that
the last step, a ROLLUP by language, first and second word, meets few rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftwell.llm.scratch import Scratch, settings


@dataclass(frozen=True)
class Collocations:
    """Phrases of 2 to ``longest`` words that occur ``least`` times; the first ``top`` of each language.

    A phrase goes when a longer one contains it and has at least ``inside`` percent of its occurrences.  ``scale`` times the
    score is rounded down.
    """

    longest: int = 3
    least: int = 10
    inside: int = 50
    scale: int = 1_000_000
    top: int = 2000


#: Piece ends (besides the line feed) and letters, and what they become.
_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r"
_TO = "abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n"
#: Groups in which each language is ranked before all of it is.
_SALTS = 128


def _words(cfg: Collocations) -> list[str]:
    return [f"w{i}" for i in range(1, cfg.longest + 1)]


def windows(docs: DataFrame, cfg: Collocations) -> DataFrame:
    """(lang, window): of every word occurrence the word and those that follow it, with a blank between them."""
    text = F.translate(F.col("text").cast("string"), _FROM, _TO)
    pieces = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(text, "\n")).alias("piece"))
    pieces = pieces.select("lang", F.trim("piece", F.lit(" \t")).alias("piece")).where("piece <> ''")
    tokens = pieces.select("lang", F.split("piece", r"[\x20\x09]+").alias("t"))
    # Position by position the words that follow; lists that are shorter end in nulls, which concat_ws leaves out.
    lead = F.arrays_zip(*[(F.col("t") if k == 0 else F.slice("t", k + 1, F.size("t"))).alias(w) for k, w in enumerate(_words(cfg))])
    return tokens.select("lang", F.inline(lead).alias(*_words(cfg))).select("lang", F.concat_ws(" ", *_words(cfg)).alias("window"))


def phrase_counts(scratch: Scratch, docs: DataFrame, cfg: Collocations) -> DataFrame:
    """(lang, size, w1, w2, ..., f): words of every phrase of ``size`` words with ``least`` occurrences or more, and of each language
    (size 0) the number of all words."""
    names = _words(cfg)
    n_words = lambda c: F.size(F.split(c, " "))
    word = lambda c, i: F.get(F.split(c, " "), F.lit(i))

    def phrases(df: DataFrame, column: str, size: int) -> DataFrame:
        return df.select("lang", F.lit(size).alias("size"), *[(word(column, i) if i < size else F.lit(None).cast("string")).alias(w) for i, w in enumerate(names)], F.col("n").alias("f"))

    found = []
    rows = windows(docs, cfg).groupBy("lang", F.col("window").alias("prefix")).agg(F.count("*").alias("n"))
    for size in range(cfg.longest, 2, -1):
        often = (F.col("n") >= cfg.least) & (n_words("prefix") == size)
        rows = rows.select("lang", F.substring_index("prefix", " ", size - 1).alias("prefix"), F.when(often, F.col("prefix")).alias("phrase"), "n")
        # The largest table of all, and the shuffle files it comes from are still there.
        with settings(scratch.spark, spark__sql__parquet__compression__codec="zstd"):
            rows = scratch.keep(rows, f"windows-{size}")
        found.append(phrases(rows.where("phrase is not null"), "phrase", size))
        rows = rows.groupBy("lang", "prefix").agg(F.sum("n").alias("n"))
    first, second = word("prefix", 0), F.when(F.col("n") >= cfg.least, word("prefix", 1))
    rolled = rows.select("lang", first.alias("w1"), second.alias("w2"), "n").rollup("lang", "w1", "w2").agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    rolled = scratch.keep(rolled.where("level < 7 and (level > 0 or w2 is not null)").where((F.col("level") == 3) | (F.col("n") >= cfg.least)), "rolled")
    rest = [F.lit(None).cast("string").alias(w) for w in names[2:]]
    # The level has a bit for each column that is summed over: 0 for two words, 1 for one, 3 for the language.
    found.append(rolled.select("lang", F.when(F.col("level") == 0, 2).when(F.col("level") == 1, 1).otherwise(0).alias("size"), "w1", "w2", *rest, F.col("n").alias("f")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return scratch.keep(out, "counts")


def _score(cfg: Collocations, a: Column, left: Column, right: Column) -> Column:
    """floor(scale * a * a / (left * right)), exact up to counts of 10^15; it never passes ``scale``."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(cfg.scale).cast("decimal(7,0)") * wide(a) * wide(a), wide(left) * wide(right))


def collocations(spark: SparkSession, docs: DataFrame, cfg: Collocations = Collocations()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first phrases of every language of ``docs`` (columns text and lang).

    Null and empty texts have no words; a null lang is ``und``, with what has that name.  Texts of any length are cut into
    pieces by Spark's own functions.  Rows that repeat count as often as they stand there.  Of cuts with equal scores the
    first counts; phrases with equal scores go by occurrences, then by their bytes.  An empty table gives an empty result.
    """
    scratch = Scratch(spark, "collocations")
    names = _words(cfg)
    counts = phrase_counts(scratch, docs.select("text", "lang"), cfg)

    def part(size: int, words: list[str], f: str) -> DataFrame:
        """Counts of the phrases of ``size`` words, under other names."""
        own = counts.where(F.col("size") == size)
        return own.select("lang", *[F.col(x).alias(y) for x, y in zip(names, words, strict=False)], F.col("f").alias(f))

    found: list[DataFrame] = []
    for size in range(2, cfg.longest + 1):
        words = names[:size]
        table = part(size, words, "a")
        for k in range(1, size):
            table = table.join(part(k, words[:k], "_l"), ["lang", *words[:k]]).join(part(size - k, words[k:], "_r"), ["lang", *words[k:]])
            cut = F.struct(_score(cfg, F.col("a"), F.col("_l"), F.col("_r")).alias("score"), F.lit(k).alias("k"), F.col("_l").alias("l"), F.col("_r").alias("r"))
            table = table.withColumn("cut", cut if k == 1 else F.least("cut", cut)).drop("_l", "_r")
        found.append(table.select("lang", *words, "a", "cut"))

    kept = []
    for size, table in enumerate(found, 2):
        words = names[:size]
        # What longer phrases hold of each phrase of this size.
        inner = [
            longer.select("lang", *[F.col(x).alias(y) for x, y in zip(names[at : at + size], words, strict=False)], F.col("a").alias("_f"))
            for longer_size, longer in enumerate(found, 2)
            if longer_size > size
            for at in range(longer_size - size + 1)
        ]
        if inner:
            held = inner[0]
            for more in inner[1:]:
                held = held.unionByName(more)
            held = held.groupBy("lang", *words).agg(F.max("_f").alias("_f"))
            table = table.join(held, ["lang", *words], "left").where(F.col("_f").isNull() | (F.lit(100) * F.col("_f") < F.lit(cfg.inside) * F.col("a")))
        kept.append(table.select("lang", F.concat_ws(" ", *words).alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")))
    ranked = kept[0]
    for more in kept[1:]:
        ranked = ranked.unionByName(more)

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of a language are among the first of each of its salts, so no task meets all its phrases.
    ranked = ranked.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    ranked = ranked.withColumn("_place", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_place") <= cfg.top)
    ranked = scratch.keep(ranked.drop("_salt", "_place"), "ranked")
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= cfg.top)
    total = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    long = lambda c: F.col(c).cast("long").alias(c)
    return ranked.join(total, "lang").select("lang", long("rank"), "phrase", long("a"), long("l"), long("r"), long("n"), long("score"))


#: DuckDB twin of op13_phrase_collocation: every length counted by itself.
ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
t AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS t FROM pieces),
w AS (SELECT lang, t, unnest(range(1, len(t) + 1)) AS i FROM t),
n1 AS (SELECT lang, t[i] AS w1, count(*) AS f FROM w GROUP BY ALL),
n2 AS (SELECT lang, t[i] AS w1, t[i + 1] AS w2, count(*) AS f FROM w WHERE i < len(t) GROUP BY ALL),
n3 AS (SELECT lang, t[i] AS w1, t[i + 1] AS w2, t[i + 2] AS w3, count(*) AS f FROM w WHERE i + 1 < len(t) GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(f) AS n FROM n1 GROUP BY lang),
c2 AS (SELECT p.lang, p.w1, p.w2, p.f AS a, x.f AS l, y.f AS r FROM n2 p JOIN n1 x ON p.lang = x.lang AND p.w1 = x.w1 JOIN n1 y ON p.lang = y.lang AND p.w2 = y.w1 WHERE p.f >= 10),
s2 AS (SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM c2),
c3 AS (
  SELECT p.lang, p.w1, p.w2, p.w3, p.f AS a, x.f AS l1, y.f AS r1, u.f AS l2, v.f AS r2 FROM n3 p
  JOIN n1 x ON p.lang = x.lang AND p.w1 = x.w1 JOIN n2 y ON p.lang = y.lang AND p.w2 = y.w1 AND p.w3 = y.w2
  JOIN n2 u ON p.lang = u.lang AND p.w1 = u.w1 AND p.w2 = u.w2 JOIN n1 v ON p.lang = v.lang AND p.w3 = v.w1),
s3 AS (SELECT *, (1000000::HUGEINT * a * a) // (l1::HUGEINT * r1) AS x1, (1000000::HUGEINT * a * a) // (l2::HUGEINT * r2) AS x2 FROM c3),
held AS (SELECT lang, w1, w2, max(a) AS f FROM (SELECT lang, w1, w2, a FROM s3 UNION ALL SELECT lang, w2, w3, a FROM s3) GROUP BY ALL),
final AS (
  SELECT s2.lang, s2.w1 || ' ' || s2.w2 AS phrase, a, l, r, score FROM s2 LEFT JOIN held h ON s2.lang = h.lang AND s2.w1 = h.w1 AND s2.w2 = h.w2 WHERE h.f IS NULL OR 100 * h.f < 50 * a
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, a, CASE WHEN x1 <= x2 THEN l1 ELSE l2 END, CASE WHEN x1 <= x2 THEN r1 ELSE r2 END, least(x1, x2) FROM s3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM final)
SELECT ranked.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
