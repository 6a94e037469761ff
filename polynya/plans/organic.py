"""Overview of dissolved organic carbon from several sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polynya.functions.quantiles import group_quantiles
from polynya.operators.joins import natural_join
from polynya.operators.relational import keep_mixed, keep_repeated
from polynya.operators.scale import durable
from polynya.operators.statistics import anova_table, corr_matrix, group_moments, lm, pairs_of_means


def _rows(df: DataFrame, section: str, name, value) -> DataFrame:
    return df.select(F.lit(section).alias("section"), name.alias("name"), value.cast("double").alias("value"))


def overview(
    doc: DataFrame, cdom: DataFrame, sources: Sequence[str], wavelengths: Sequence[float], **kw
) -> DataFrame:
    """(section, name, value) from doc (jday, depth, doc, source) and cdom (jday, depth,
    wavelength, absorption): counts, medians overall and where sources share a depth,
    variance table, pair differences, correlations, and doc ~ absorption slopes."""
    known = doc.dropna(subset=["jday", "depth", "doc"])
    text = lambda c: F.col(c).cast("string")
    pair = lambda a, b: F.concat_ws("-", a, b)
    # One row per source; it feeds counts, variance table and pairs, so it is written once.
    moments = durable(group_moments(known, "source", "doc"))
    box = group_quantiles(known, ["source"], "doc", {"median": 0.5}, **kw)
    deep = group_quantiles(keep_mixed(known, ["depth"], "source"), ["source", "depth"], "doc", {"median": 0.5}, **kw)
    repeated = keep_repeated(known, ["depth"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    wide = F.col("wavelength").cast("int").isin([int(w) for w in wavelengths])
    joined = natural_join(known, cdom.filter(wide))
    slopes = lm(joined, ["source", "wavelength"], F.col("absorption"), F.col("doc"))
    parts = [
        _rows(moments, "n", text("source"), F.col("n")),
        _rows(box, "median", text("source"), F.col("median")),
        _rows(deep, "median_by_depth", pair("source", F.col("depth").cast("int").cast("string")), F.col("median")),
        _rows(repeated, "repeated_depths", text("source"), F.col("n")),
        _rows(anova_table(moments, "source"), "meansq", text("term"), F.col("meansq")),
        _rows(pairs_of_means(moments, "source"), "difference", pair("group2", "group1"), F.col("estimate")),
        _rows(corr_matrix(known, ["jday", "depth"], "source", "doc", sources), "correlation", pair("a", "b"), F.col("r")),
        _rows(slopes, "slope", pair("source", F.col("wavelength").cast("int").cast("string")), F.col("slope")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
