"""Removal of lines that spread over many sites.

A line's spread is its number of distinct sites. It is sketched by HyperLogLog per line hash; sketches
of tasks merge by aggregation, so neither a line nor a site gathers its rows in one place. An estimate
clearly over or under the threshold decides; near it, the distinct sites are counted exactly. Lines
that occur less often than the threshold cannot reach it and need no sketch.

A line that reaches the threshold stays in the document with the smallest id that holds it and is
removed from all others, so no text is lost altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themata.llm.common import text_of
from themata.storage import materialise

MIN_SITES = 10
#: HyperLogLog has 2^LOG_BUCKETS registers: a standard error of 1.6 %.
LOG_BUCKETS = 12
#: Estimates within this share of the threshold are replaced by exact counts.
MARGIN = 0.15

# Fixed value: ASCII white space, which does not count at the ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """Two hashes of a line without white space at its ends; null for a blank line."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.hash(bare).alias("b")))


def _lines(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per distinct line of a row: ``columns`` and its key (a, b)."""
    keys = F.array_distinct(F.transform(F.split("text", "\n"), line_key))
    exploded = rows.select(*columns, F.explode(keys).alias("k")).where("k is not null")
    return exploded.select(*columns, "k.a", "k.b")


def widespread_lines(docs: DataFrame, site: str, min_sites: int = MIN_SITES) -> DataFrame:
    """Keys (a, b) of the lines on ``min_sites`` sites or more, with ``keeper``, the smallest doc_id.

    A null site is no site; a null doc_id keeps a line only if all of the line's doc_ids are null.
    """
    rows = docs.select(
        F.col("doc_id").alias("doc_id"), F.col(site).cast("string").alias("site"), text_of().alias("text")
    )
    often = _lines(rows, "doc_id").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper"))
    # A line counts once per document, so a line on enough sites occurs as often.
    often = often.where(F.col("n") >= min_sites).select("a", "b", "keeper")
    held = materialise(_lines(rows.where("site is not null"), "site").join(often, ["a", "b"]), "frequent-lines")
    sketched = held.groupBy("a", "b", "keeper").agg(F.hll_sketch_agg("site", F.lit(LOG_BUCKETS)).alias("sketch"))
    estimated = sketched.select("a", "b", "keeper", F.hll_sketch_estimate("sketch").alias("sites"))
    low, high = min_sites * (1 - MARGIN), min_sites * (1 + MARGIN)
    unsure = estimated.where(F.col("sites").between(low, high)).select("a", "b")
    exact = (
        held.join(unsure, ["a", "b"], "left_semi")
        .distinct()
        .groupBy("a", "b", "keeper")
        .agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    sure = estimated.where(F.col("sites") > high)
    return sure.select("a", "b", "keeper").unionByName(exact.select("a", "b", "keeper"))


def remove_widespread(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` (doc_id, text, a site column) without its widespread lines, and ``n_removed``.

    Lines are separated by newlines; blank lines are never removed. A removed line goes with its
    newline; a text of removed lines only becomes empty. Null text stays null. Repeated rows are
    cleaned alike. A column named ``n_removed`` is replaced; all others stay. An empty table gives
    no rows.
    """
    rows = docs.drop("n_removed")
    wide = materialise(widespread_lines(rows, site, min_sites), "widespread-lines")
    # The row stands in a column of its own, so no name of its columns can clash.
    keyed = rows.select(
        F.struct("*").alias("row"), F.xxhash64("text").alias("key"), F.col("doc_id").alias("id"), text_of().alias("text")
    )
    # Which lines go from which rows: without the texts, and only of rows that hold such lines.
    found = _lines(keyed.select("id", "key", "text"), "id", "key").join(wide, ["a", "b"])
    going = (
        found.where(~F.col("keeper").eqNullSafe(F.col("id")))
        .select(F.col("id").alias("of"), F.col("key").alias("of_key"), F.struct("a", "b").alias("k"))
        .groupBy("of", "of_key")
        .agg(F.collect_set("k").alias("gone"))
    )
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key"))
    joined = keyed.select("row", "key", "id").join(going, same, "left")
    text, gone = F.col("row.text"), F.col("gone")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda line: ~F.coalesce(F.array_contains(gone, line_key(line)), F.lit(False)))
    cleaned = F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))
    removed = F.when(gone.isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept)).cast("long")
    done = joined.select("row", cleaned.alias("cleaned"), removed.alias("removed"))
    columns = [F.col("cleaned").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in rows.columns]
    return done.select(*columns, F.col("removed").alias("n_removed"))


def oracle() -> str:
    """The same rows in SQL, with exact counts; for tables whose doc_ids are distinct."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH split AS (
  SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM split
), keyed AS (
  SELECT *, trim(line, {blanks}) AS bare FROM lines
), wide AS (
  SELECT bare, min(doc_id) AS keeper FROM keyed WHERE bare <> ''
  GROUP BY bare HAVING count(DISTINCT source) >= {MIN_SITES}
), marked AS (
  SELECT k.doc_id, k.line, k.place, (w.bare IS NOT NULL AND w.keeper <> k.doc_id) AS gone
  FROM keyed k LEFT JOIN wide w ON k.bare = w.bare
)
SELECT doc_id,
  coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text,
  count(*) FILTER (gone) AS n_removed
FROM marked GROUP BY doc_id
"""
