"""Line dedup: lines that many documents share stay in one of them only.

Lines are exploded with a key each (blanks stripped at both ends, A-Z lower-cased), keys are hashed
to 128 bits, the documents of each hash are counted, and the lines of hashes with enough documents
are dropped from all documents but the smallest doc_id. What is left of a document is put together
by position. Only hashes and positions are shuffled to find the lines; each text moves once, to
meet the positions it loses.

A line that a large share of all documents holds: documents are counted from partial counts, and
the join of lines with their counts is an inner join before a new exchange, which adaptive
execution splits where one key is large.

Definitions: a null or empty text is one empty line. Rows of one doc_id are one document, also
when their texts differ; a null doc_id is one document and comes after all others. Rows that are
equal lose the same lines. Very long texts: work per line is constant. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polynya.llm.base import written

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``id, twin, at, h1, h2`` of every line whose key is long enough.

    ``twin`` tells texts of one doc_id apart; ``h1, h2`` are the key's hash.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    exploded = docs.select(
        F.col("doc_id").alias("id"), F.xxhash64(text).alias("twin"), F.posexplode(lines_of(text)).alias("at", "line")
    )
    keys = exploded.select("id", "twin", "at", key_of(F.col("line")).alias("key"))
    return keys.where(F.char_length("key") >= min_chars).select(
        "id", "twin", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


def dropped_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``id, twin, gone`` of every text that loses lines; ``gone`` holds their positions from 0."""
    lines = written(keyed_lines(docs, min_chars), "lines")
    holders = lines.groupBy("h1", "h2").agg(
        F.count_distinct(F.struct("id")).alias("docs"), F.min("id").alias("keeper")
    )
    # A table of its own, so that the join starts from plain exchanges, which can be split.
    shared = written(holders.where(F.col("docs") >= min_docs).select("h1", "h2", "keeper"), "shared-lines")
    lost = lines.join(shared, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("id", "twin").agg(F.collect_set("at").alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``doc, n_lines, n_dropped`` of every row; ``doc`` is the row with its lines dropped from
    ``text``, so its columns may have any names.

    Keys shorter than ``min_chars`` code points, or in fewer than ``min_docs`` documents, stay.
    """
    gone = dropped_lines(docs, min_chars, min_docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    others = [F.col(c) for c in docs.columns if c != "text"]
    whole = docs.select(
        F.struct(*others).alias("row"), F.xxhash64(text).alias("_twin"), lines_of(text).alias("lines")
    )
    met = whole.join(
        gone.hint("shuffle_hash"),
        F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("_twin") == F.col("twin")),
        "left",
    )
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(
        F.array_except(places, F.coalesce("gone", F.array().cast("array<int>"))), lambda i: F.get("lines", i)
    )
    text = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(kept, "\n"))
    fields = [text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return met.select(
        F.struct(*fields).alias("doc"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op13_line_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: its lines, those it loses, and the digest of what is left."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("doc.text", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), e AS (
  SELECT r, doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM d
), k AS (
  SELECT r, doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM e
), s AS (
  SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT k.*, coalesce(s.keeper <> k.doc_id, false) AS gone FROM k LEFT JOIN s USING (key))
GROUP BY r, doc_id
"""
