"""Line dedup by a log-template tree, in DataFrame functions only.

A line's tokens are split at blanks and tokens with digits become ``<*>``.  The tree
has a fixed depth: number of tokens, then the leading three tokens.  Below a leaf the
lines divide into as many templates as they need.  At first a line keeps each token
that ``least_docs`` of the leaf's (document, line) pairs hold at its position; the
others are variable.  Then kept tokens are generalised: one stays only if it dominates
where it stands, that is, if it is what half of the leaf's lines hold there that have
the same last kept token before it, and half of those with the same next kept token
after it.  A field's values, however frequent each is, share what stands around them
and become variable, while the fixed words of several templates do not.  This is done
``LEVELS`` times, so that runs of up to twice as many fields that depend on one another
fall from both ends; the levels are a depth of the tree and the same for all data.  At
every level a line has one template, which counts if at least 70 % of its positions are
kept.  Lines of which some template, or the own text,
occurs in ``least_docs`` documents or more are dropped.

Only hashes of lines are shuffled: they are made in one scan, written as a table and
used to count and to drop.  A second scan fetches the tokens of lines in leaves that
hold several lines and enough documents, once for each different line.  Joins on lines
or leaves are plain equi-joins that AQE splits where a line is very frequent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, free, keyed, table

DEPTH, LEAST_DOCS, AGREE, DOMINANT, LEVELS = 3, 10, 0.7, 0.5, 3
#: Leaves of several lines are broadcast up to this many, so lines of other leaves are not shuffled; more are joined by a shuffle.
BROADCAST_LEAVES = 500_000


def masked(line):
    """A trimmed line with its variable fields masked."""
    t = F.trim(line)
    return F.when(t.rlike("[0-9]"), F.regexp_replace(t, "[^ 0-9]*[0-9][^ ]*", "<*>")).otherwise(t)


def _lines(rows: DataFrame) -> DataFrame:
    """rid, pos, m, and the line's keys h1, h2 and its leaf, of all lines that are not blank."""
    each = rows.select("rid", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).select("rid", "pos", masked(F.col("line")).alias("m")).filter("m <> ''")
    t = F.split("m", " ")
    return each.select("*", F.xxhash64("m").alias("h1"), F.xxhash64(F.lit("line"), "m").alias("h2"), F.xxhash64(F.size(t), F.slice(t, 1, DEPTH)).alias("leaf"))


LINE = ["leaf", "h1", "h2"]


def _few(df: DataFrame) -> DataFrame:
    """A cut table of one narrow row a key, broadcast up to a checked number."""
    df = cut(df)
    return F.broadcast(df) if df.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES else df


def _fallen(spread: DataFrame, side: str) -> DataFrame:
    """leaf, at, near, by, token: the kept tokens that do not dominate beside the kept token ``by`` at ``near``."""
    seen = spread.groupBy("leaf", "at", F.col(f"{side}.at").alias("near"), F.col(f"{side}.token").alias("by"), "token").agg(F.sum("docs").alias("n"), F.max("hit").alias("hit"))
    seen = seen.withColumn("near", F.coalesce("near", F.lit(-1))).withColumn("by", F.coalesce("by", F.lit("")))
    every = seen.groupBy("leaf", "at", "near", "by").agg(F.sum("n").alias("every"))
    return seen.filter("hit").join(every, ["leaf", "at", "near", "by"]).filter(F.col("n") < F.lit(DOMINANT) * F.col("every")).select("leaf", "at", "near", "by", "token")


def generalised(spread: DataFrame) -> DataFrame:
    """spread (LINE, docs, at, token, hit) with the hits that dominate between the kept tokens around them."""
    before = Window.partitionBy(*LINE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*LINE).orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    own = F.when(F.col("hit"), F.struct("at", "token"))
    around = table(spread.withColumn("left", F.last(own, True).over(before)).withColumn("right", F.first(own, True).over(after)))
    out = around
    for side in ("left", "right"):
        fallen = _few(_fallen(around, side)).withColumn(f"no_{side}", F.lit(True))
        out = out.withColumn("near", F.coalesce(f"{side}.at", F.lit(-1))).withColumn("by", F.coalesce(f"{side}.token", F.lit(""))).join(fallen, ["leaf", "at", "near", "by", "token"], "left")
    out = table(out.select(*LINE, "docs", "at", "token", (F.col("hit") & F.col("no_left").isNull() & F.col("no_right").isNull()).alias("hit")))
    free(around)
    return out


def _templates(spread: DataFrame, agree: float, level: int) -> DataFrame:
    """LINE, t1, t2: the template of each line that keeps enough of its positions."""
    key = lambda *salt: F.bit_xor(F.when(F.col("hit"), F.xxhash64(*salt, F.lit(level), "at", "token")))
    held = spread.groupBy(*LINE).agg(F.count_if("hit").alias("held"), F.count(F.lit(1)).alias("n"), key().alias("t1"), key(F.lit("template")).alias("t2"))
    return held.filter(F.col("held") >= F.lit(agree) * F.col("n")).select(*LINE, "t1", "t2")


def recurring(rows: DataFrame, lines: DataFrame, least_docs: int = LEAST_DOCS, agree: float = AGREE) -> DataFrame:
    """leaf, h1, h2 of the lines (a table of their keys) that are dropped."""
    counts = table(lines.select("rid", *LINE).distinct().groupBy(*LINE).agg(F.count(F.lit(1)).alias("docs")))
    leaves = counts.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs"), F.count(F.lit(1)).alias("variants"))
    asked = _few(leaves.filter((F.col("variants") > 1) & (F.col("leaf_docs") >= least_docs)).select("leaf"))
    variants = _lines(rows).join(asked, "leaf", "left_semi").groupBy(*LINE).agg(F.first("m").alias("m")).join(counts, LINE)
    words = table(variants.select(*LINE, "docs", F.posexplode(F.split("m", " ")).alias("at", "token")))
    kept = _few(words.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("n")).filter(F.col("n") >= least_docs).select("leaf", "at", "token"))
    spread = table(words.join(kept.withColumn("hit", F.lit(True)), ["leaf", "at", "token"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))))
    free(words)
    templates = [table(_templates(spread, agree, 0))]
    for level in range(1, LEVELS + 1):
        more = generalised(spread)
        free(spread)
        spread = more
        templates.append(table(_templates(spread, agree, level)))
    free(spread)
    every = reduce(DataFrame.union, templates)
    holders = lines.select("rid", *LINE).join(every, LINE).select("rid", "leaf", "t1", "t2").distinct()
    support = holders.groupBy("leaf", "t1", "t2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_docs)
    by_template = every.join(support, ["leaf", "t1", "t2"], "left_semi").select(*LINE)
    known = table(counts.filter(F.col("docs") >= least_docs).select(*LINE).union(by_template).distinct())
    free(counts, *templates)
    return known


def drop_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text without dropped lines), rid: one row for each row of docs.

    Lines end at a newline; blank lines are kept and count for no template.  A null
    text is one blank line and stays null; a text of very many lines costs time in
    proportion to them.  Null or repeated ids are documents of their own, and rows
    of equal text count each; a line repeated in a document counts for one document
    and is dropped each time.  Columns other than the two named are not read.  An empty
    table gives an empty result.
    """
    rows = keyed(docs, id_col, text=text_col).select("rid", "id", "text")
    lines = table(_lines(rows).select("rid", "pos", *LINE))
    gone = lines.join(recurring(rows, lines, least_docs), LINE, "left_semi").groupBy("rid").agg(F.collect_list("pos").alias("gone"))
    out = rows.join(gone, "rid", "left").withColumn("lines", F.split("text", "\n")).withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    return out.select(F.col("id").alias("doc_id"), F.coalesce(F.size("lines"), F.lit(1)).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), kept.alias("kept"), "rid")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM d),
m AS (SELECT doc_id, pos, line, regexp_replace(trim(line, ' '), '[^ 0-9]*[0-9][^ ]*', '<*>', 'g') AS m FROM e),
l AS (SELECT DISTINCT doc_id, m, string_split(m, ' ') AS t FROM m WHERE m <> ''),
k AS (SELECT *, row(len(t), t[1:3]) AS leaf FROM l),
c AS (SELECT leaf, m, t, count(*) AS docs FROM k GROUP BY ALL),
f AS (SELECT leaf, sum(docs) AS leaf_docs FROM c GROUP BY leaf HAVING count(*) > 1 AND sum(docs) >= 10),
s AS (SELECT c.leaf, m, docs, leaf_docs, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS token FROM c JOIN f ON c.leaf = f.leaf),
s0 AS MATERIALIZED (SELECT leaf, m, docs, pos, token, sum(docs) OVER (PARTITION BY leaf, pos, token) >= 10 AS hit FROM s),
@LEVELS@
i AS (@TEMPLATES@),
p AS (SELECT i.level, i.leaf, i.template FROM k JOIN i ON k.leaf = i.leaf AND k.m = i.m GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
r AS (SELECT m FROM c WHERE docs >= 10
      UNION
      SELECT i.m FROM i JOIN p ON i.level = p.level AND i.leaf = p.leaf AND i.template = p.template),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE r.m IS NOT NULL) AS n_dropped,
             string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE r.m IS NULL) AS kept
      FROM m LEFT JOIN r ON m.m = r.m GROUP BY doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM g
"""
_LEVEL = """w{n} AS (SELECT *, last_value(CASE WHEN hit THEN row(pos, token) END IGNORE NULLS) OVER (PARTITION BY leaf, m ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(CASE WHEN hit THEN row(pos, token) END IGNORE NULLS) OVER (PARTITION BY leaf, m ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM s{n}),
s{next} AS MATERIALIZED (SELECT leaf, m, docs, pos, token, hit AND 2 * sum(docs) OVER (PARTITION BY leaf, pos, before, token) >= sum(docs) OVER (PARTITION BY leaf, pos, before)
  AND 2 * sum(docs) OVER (PARTITION BY leaf, pos, after, token) >= sum(docs) OVER (PARTITION BY leaf, pos, after) AS hit FROM w{n}),"""
_TEMPLATE = "SELECT {n} AS level, leaf, m, list(CASE WHEN hit THEN token END ORDER BY pos) AS template FROM s{n} GROUP BY leaf, m HAVING count(*) FILTER (hit) >= 0.7::DOUBLE * count(*)"
ORACLE = ORACLE.replace("@LEVELS@", "\n".join(_LEVEL.format(n=n, next=n + 1) for n in range(LEVELS))).replace("@TEMPLATES@", " UNION ALL ".join(_TEMPLATE.format(n=n) for n in range(LEVELS + 1)))
QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLE_SQL = {"op4_line_dedup": ORACLE}
