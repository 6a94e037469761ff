"""Instrument text: corpora of files, banners, marker sections, records, headers, file names.

Every operator after ``corpus`` works on a line table (file key, ``pos``, ``line``), so the same
code serves a folder of files and a table that already holds the texts.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StructType

from polynya.functions.scalars import parse_number, regex_or_null
from polynya.operators.scale import null_safe_join

LINE_BREAK = r"\r\n|\r|\n"


def corpus(
    spark: SparkSession, root: str, include: str = ".*", exclude: str | None = None
) -> DataFrame:
    """Lines of the files under ``root`` whose path matches: (file, pos, line).

    Large files stay splittable: a split is read in order by one task, so the line number is
    the place within the split plus the number of lines in the splits before it.
    """
    raw = (
        spark.read.option("recursiveFileLookup", "true")
        .text(root)
        .select(
            F.url_decode(F.col("_metadata.file_path")).alias("file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.col("value").alias("line"),
        )
        .filter(F.col("file").rlike(include))
    )
    if exclude is not None:
        raw = raw.filter(~F.col("file").rlike(exclude))
    marked = raw.withColumn("_id", F.monotonically_increasing_id())
    splits = marked.groupBy("file", "_start").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines")
    )
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "file",
        "_start",
        (F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return null_safe_join(marked, offsets, ["file", "_start"]).select(
        "file", (F.col("_id") + F.col("_shift")).alias("pos"), "line"
    )


def text_lines(df: DataFrame, key: str | Sequence[str], text: str) -> DataFrame:
    """Split a text column into lines: (keys, pos, line)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.select(*keys, F.posexplode(F.split(text, LINE_BREAK)).alias("pos", "line"))


def skip_banner(lines: DataFrame, n: int) -> DataFrame:
    return lines.filter(F.col("pos") >= n)


def missing(column: Column, tokens: Sequence[str]) -> Column:
    return F.when(~column.isin(*tokens), column) if tokens else column


def parse_delimited(
    lines: DataFrame,
    schema: StructType,
    sep: str = ",",
    na: Sequence[str] = ("",),
    quote: str = '"',
    rest: str | None = None,
) -> DataFrame:
    """Delimited lines to typed columns. Fields are read as text, missing tokens blanked, cast.

    ``rest`` names a column for what follows the fields of the schema, null where nothing does.
    """
    as_text = ", ".join(f"`{f.name}` string" for f in schema.fields)
    fields = F.from_csv("line", as_text, {"sep": sep, "quote": quote, "mode": "PERMISSIVE"})
    keep = [c for c in lines.columns if c != "line"]
    field = rf"[^{re.escape(sep)}]*"
    if quote:
        field = rf"(?:{quote}(?:[^{quote}]|{quote}{quote})*{quote}|{field})"
    behind = regex_or_null(F.col("line"), rf"^(?:{field}{re.escape(sep)}){{{len(schema.fields)}}}(.*)$", 1)
    parsed = lines.select(*keep, fields.alias("_f"), *([behind.alias("_rest")] if rest else []))
    return parsed.select(
        *keep,
        *[
            missing(F.col("_f")[f.name], na).try_cast(f.dataType).alias(f.name)
            for f in schema.fields
        ],
        *([missing(F.col("_rest"), na).alias(rest)] if rest else []),
    )


def after_marker(
    lines: DataFrame, keys: Sequence[str], marker: str, skip: int = 0
) -> DataFrame:
    """Lines of each file after its first line matching ``marker`` (and ``skip`` more)."""
    found = (
        lines.filter(F.col("line").rlike(marker))
        .groupBy(*keys)
        .agg(F.min("pos").alias("_marker"))
    )
    joined = null_safe_join(lines, found, keys)
    return joined.filter(F.col("pos") > F.col("_marker") + skip).select(
        *keys, (F.col("pos") - F.col("_marker") - 1 - skip).alias("pos"), "line"
    )


def numeric_fields(
    lines: DataFrame, names: Sequence[str], sep: str = "\t", drop: Sequence[str] = ("line",)
) -> DataFrame:
    """Split the line and read the fields, by position, as numbers (null where not a number)."""
    parts = lines.withColumn("_p", F.split("line", sep))
    return parts.select(
        *[c for c in lines.columns if c not in drop],
        *[F.get("_p", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)],
    )


def two_line_records(
    lines: DataFrame, keys: Sequence[str], names: Sequence[str], sep: str = " +"
) -> DataFrame:
    """Glue lines 2k and 2k+1 into one record and name its fields by position.

    Names starting with ``temp`` are filler and dropped. An odd last line has no partner: its
    missing fields are null.
    """
    even = F.col("pos") % 2 == 0
    pairs = lines.groupBy(*keys, F.floor(F.col("pos") / 2).alias("record")).agg(
        F.max(F.when(even, F.col("line"))).alias("_a"),
        F.max(F.when(~even, F.col("line"))).alias("_b"),
    )
    fields = F.concat(
        F.split(F.coalesce("_a", F.lit("")), sep),
        F.coalesce(F.split("_b", sep), F.array().cast("array<string>")),
    )
    split = pairs.withColumn("_f", fields)
    return split.select(
        *keys,
        "record",
        *[
            F.get("_f", F.lit(i)).alias(n)
            for i, n in enumerate(names)
            if not n.startswith("temp")
        ],
    )


def labelled_header(
    lines: DataFrame, keys: Sequence[str], labels: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """``Label unit: value`` lines to one typed row per file.

    ``labels`` maps a column name to (label, type). The unit is optional. A value is one word,
    for a time two; text that does not read as the type is null.
    """
    head = F.substring_index("line", ": ", 1)
    tail = F.substring(F.col("line"), F.length(head) + F.lit(3), F.length("line"))
    known = [label for label, _ in labels.values()]
    unit = F.length(F.substring_index(head, " ", -1))
    label = F.when(head.isin(known), head).otherwise(F.left(head, F.length(head) - unit - 1))
    parsed = lines.select(*keys, label.alias("_label"), tail.alias("_value"))
    aggs = []
    for name, (text, kind) in labels.items():
        words = F.substring_index("_value", " ", 2 if kind.startswith("timestamp") else 1)
        value = F.max(F.when(F.col("_label") == text, words))
        aggs.append((value if kind == "string" else value.try_cast(kind)).alias(name))
    return parsed.filter(F.col("_label").isin(known)).groupBy(*keys).agg(*aggs)


def number_per_line(lines: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    return lines.select(*keys, F.col("pos").alias("row_index"), parse_number(F.col("line")).alias(out))


def name_layout(
    name: Column, token: str, with_token: Sequence[str], without: Sequence[str]
) -> dict[str, Column]:
    """Key columns from a ``_``-separated file name; the token decides which layout applies."""
    stem = F.regexp_replace(F.substring_index(name, "/", -1), r"\.[A-Za-z0-9]+$", "")
    parts = F.split(stem, "_")
    has = name.rlike(token)
    columns: dict[str, Column] = {}
    for field in dict.fromkeys([*with_token, *without]):
        a = F.get(parts, F.lit(with_token.index(field))) if field in with_token else F.lit(None)
        b = F.get(parts, F.lit(without.index(field))) if field in without else F.lit(None)
        columns[field] = F.when(has, a).otherwise(b).cast("string")
    return columns


def date_in_name(name: Column) -> Column:
    """Date in a file name: eight digits (ymd) or a letter A and year + day of year."""
    day_id = regex_or_null(name, r"A(\d{7})", 1)
    ymd = regex_or_null(name, r"(\d{8})", 1)
    return F.coalesce(
        F.try_to_date(day_id, "yyyyDDD"), F.try_to_date(ymd, "yyyyMMdd")
    )


def cast_in_name(name: Column) -> Column:
    return regex_or_null(name, r"(\d{3})\.", 1).try_cast("double")
