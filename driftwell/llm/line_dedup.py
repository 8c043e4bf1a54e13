"""Line dedup by a fixed-depth template tree, as DataFrame operations only.

A line goes down the tree by its number of tokens and its leading tokens; tokens with a digit count as variable from the
start.  Inside a leaf a token that recurs at its place stays and every other one is generalised to a field, so the lines
of a leaf fall into templates.  Boilerplate, whose lines are dropped everywhere, is

* a line that recurs in enough different documents as it is, digits apart, and
* a template that recurs in enough documents of its leaf, and that keeps enough of the words below the leading ones.

What a leaf has in common is no evidence: its leading tokens count neither way, nor do fields.  And what is enough grows with
the leaf, so that a common opening of sentences doesn't become a template as the corpus grows.

Documents are different when their texts are: copies of a text are one document, and so are the lines that one document
repeats.  All counting is of distinct (key, text) first, then of keys, so that a line that a third of all documents have is
no large group anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm.scratch import Scratch


@dataclass(frozen=True)
class TemplateTree:
    """``depth`` leading tokens; a line recurs in ``documents`` different texts.

    A token of a leaf stays, and a template recurs, in so many texts, and in ``leaf_share`` of the leaf's.  A template keeps
    ``kept_share`` of the words below the leading ones, one at least.  Lines without such words recur as they are, and blank lines
    are nothing.
    """

    depth: int = 3
    documents: int = 5
    kept_share: float = 0.5
    leaf_share: float = 0.05


BLANK = r"[\x20\x09\x0B-\x0D]+"
VARIABLE = r"[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*"
FIELD = "<*>"
#: Three tokens or more.
LONG = r"(?:[^\x20\x09-\x0D]++[\x20\x09\x0B-\x0D]++){2}[^\x20\x09-\x0D]"


#: Columns that the operator adds.
ADDED = ("n_lines", "n_dropped", "emptied")


def _masked(line: Column) -> Column:
    """Tokens with a digit as fields, blanks folded; the dear replacements run on the lines that need them only."""
    fields = F.when(line.rlike("[0-9]") & line.rlike(LONG), F.regexp_replace(line, VARIABLE, FIELD)).otherwise(line)
    return F.transform(F.array(fields), lambda x: F.trim(F.when(x.rlike(r"[\x09\x0B-\x0D]|\x20\x20"), F.regexp_replace(x, BLANK, " ")).otherwise(x)))[0]


def _texts(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, texts): in how many different texts the keys occur."""
    return rows.groupBy(*keys, "class").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.count("*").alias("texts"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, class, row): every row packed, so that its columns meet none of the operator's, under its id and text hash."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return row.select(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64(F.col("row.text").cast("string")).alias("class"), "row")


def recurring_lines(scratch: Scratch, docs: DataFrame, cfg: TemplateTree) -> DataFrame:
    """(id, class, dropped): positions of the lines of each document that recur, or are instances of recurring templates."""
    lines = F.transform(F.split(F.col("row.text").cast("string"), "\n"), lambda x: _masked(x))
    each = _keyed(docs.select("doc_id", "text")).select("id", "class", F.posexplode(lines).alias("at", "line")).where("line <> ''")
    tokens = F.split("line", " ")
    # Masking is the dear part, so the lines are a table and read from there again.
    each = scratch.keep(each.withColumn("node", F.xxhash64(F.size(tokens), F.slice(tokens, 1, cfg.depth))).withColumn("whole", F.xxhash64("line")), "lines")
    # Tables of their own, here and below, so that a join that meets a hot key can be split at run time.
    same = scratch.keep(_texts(each, "whole").where(F.col("texts") >= cfg.documents).select("whole"), "same")
    hits = each.select("id", "class", "at", "whole").join(same.hint("merge"), "whole", "left_semi").select("id", "class", "at")

    busy = scratch.keep(_texts(each, "node").where(F.col("texts") >= cfg.documents).withColumnRenamed("texts", "leaf"), "nodes")
    inside = each.where(F.size(tokens) > cfg.depth).join(busy, "node")
    below = F.posexplode(F.filter(F.transform(F.slice(tokens, cfg.depth + 1, F.size(tokens)), lambda x, i: F.when(x != FIELD, F.xxhash64(i, x))), lambda x: x.isNotNull()))
    words = inside.select("id", "class", "at", "node", "leaf", below.alias("i", "token"))
    enough = F.col("texts") >= F.greatest(F.lit(cfg.documents), F.col("leaf") * cfg.leaf_share)
    stays = scratch.keep(_texts(words, "node", "leaf", "token").where(enough).select("node", "token"), "stays")
    placed = words.join(stays.withColumn("stays", F.lit(1)).hint("merge"), ["node", "token"], "left")
    # The words that stay, put together in any order, are the template.
    template = F.coalesce(F.bit_xor(F.when(F.col("stays") == 1, F.col("token"))), F.lit(0))
    kept = placed.groupBy("id", "class", "at", "node", "leaf").agg(F.count("*").alias("n"), F.count("stays").alias("kept"), template.alias("template"))
    kept = scratch.keep(kept.where((F.col("kept") > 0) & (F.col("kept") >= cfg.kept_share * F.col("n"))), "templates")
    recurring = scratch.keep(_texts(kept, "node", "leaf", "kept", "template").where(enough).select("node", "kept", "template"), "recurring")
    hits = hits.unionByName(kept.join(recurring.hint("merge"), ["node", "kept", "template"], "left_semi").select("id", "class", "at"))
    return scratch.keep(hits.groupBy("id", "class").agg(F.collect_set("at").alias("dropped")), "dropped")


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, cfg: TemplateTree = TemplateTree()) -> DataFrame:
    """``docs`` with recurring lines dropped from ``text``, and n_lines, n_dropped and emptied added.

    ``emptied`` is true where a document lost lines and has nothing but blanks left: its text is what is left all the same.
    A null text stays null and has no lines; an empty one is one blank line, and blank lines are never dropped.  Texts of any
    number of lines take time in proportion to it.  Rows that repeat a document are decided alike.  Columns of ``docs`` may
    have any names; the added ones are replaced.  An empty table gives an empty result.
    """
    scratch = Scratch(spark, "line-dedup")
    rest = [c for c in docs.columns if c not in ADDED]
    drops = recurring_lines(scratch, docs, cfg)
    # A merge join at any size: what is dropped grows with the corpus.
    joined = _keyed(docs).join(drops.hint("merge"), ["id", "class"], "left")
    out = joined.select("row", "dropped", F.split(F.col("row.text").cast("string"), "\n").alias("lines"))
    # One pass over the positions, however many go.
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")
    out = out.withColumn("left", F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.get("lines", i))))
    count = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")
    emptied = F.col("dropped").isNotNull() & ~F.exists("left", lambda x: F.trim(x) != "")
    columns = [(F.array_join("left", "\n") if c == "text" else F.col("row").getField(c)).alias(c) for c in rest]
    return out.select(*columns, count("lines").alias("n_lines"), (count("lines") - count("left")).alias("n_dropped"), emptied.alias("emptied"))


#: DuckDB twin of op1_line_dedup: templates as strings instead of hashes.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, class, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, md5(text) AS class, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
folded AS (
  SELECT doc_id, class, pos, trim(regexp_replace(CASE WHEN regexp_matches(line, '([^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]+){2}[^\x20\x09-\x0D]') THEN regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g') ELSE line END, '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS line FROM lines),
leaves AS (SELECT *, concat(len(w), ' ', array_to_string(w[1:3], ' ')) AS node FROM (SELECT doc_id, class, pos, string_split(line, ' ') AS w FROM folded WHERE line <> '')),
same AS (SELECT w FROM leaves GROUP BY w HAVING count(DISTINCT class) >= 5),
busy AS (SELECT node, count(DISTINCT class) AS leaf FROM leaves GROUP BY node HAVING count(DISTINCT class) >= 5),
tokens AS (
  SELECT * FROM (SELECT doc_id, pos, class, node, leaf, unnest(range(4, len(w) + 1)) AS place, unnest(w[4:]) AS token FROM leaves JOIN busy USING (node) WHERE len(w) > 3) WHERE token <> '<*>'),
stays AS (SELECT node, place, token FROM tokens GROUP BY node, leaf, place, token HAVING count(DISTINCT class) >= greatest(5, 0.05 * leaf)),
kept AS (
  SELECT doc_id, pos, class, node, leaf, string_agg(place || '=' || token, ' ' ORDER BY place) FILTER (s IS NOT NULL) AS template
  FROM tokens LEFT JOIN (SELECT *, 1 AS s FROM stays) USING (node, place, token)
  GROUP BY doc_id, pos, class, node, leaf HAVING count(s) > 0 AND count(s) >= 0.5 * count(*)),
recurring AS (SELECT node, template FROM kept GROUP BY node, leaf, template HAVING count(DISTINCT class) >= greatest(5, 0.05 * leaf)),
found AS (SELECT doc_id, class, pos FROM kept SEMI JOIN recurring USING (node, template) UNION SELECT doc_id, class, pos FROM leaves SEMI JOIN same USING (w)),
hits AS (SELECT doc_id, class, list(pos) AS dropped FROM found GROUP BY doc_id, class),
split AS (SELECT d.doc_id, text, string_split(text, chr(10)) AS l, coalesce(dropped, []) AS dropped FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id AND md5(d.text) = h.class),
final AS (SELECT *, list_filter(l, lambda x, i: NOT list_contains(dropped, i - 1)) AS kept_lines FROM split)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(l) - len(kept_lines), 0)::BIGINT AS n_dropped, sha256(array_to_string(kept_lines, chr(10))) AS kept_sha256 FROM final
"""
