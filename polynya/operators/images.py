"""Pixel tables (image_id, row, col, v): crop, threshold, background, stretch, binarise, clean."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from polynya.functions.quantiles import add_group_quantiles
from polynya.operators.scale import null_safe_join, with_group

IMAGE = ["image_id"]
SHORT = 8  # radius up to which a window is read pixel by pixel


def crop_flip(
    pixels: DataFrame, distance: DataFrame, positions: DataFrame, reach: float = 250.0
) -> DataFrame:
    """Flip rows and columns, keep rows within ``reach``, attach the negated positions.

    ``distance`` has row and distance, ``positions`` row, col, x, y; both describe the camera.
    """
    sized = with_group(pixels, IMAGE, {"_r": F.max("row"), "_c": F.max("col")})
    flipped = sized.select(
        "image_id", (F.col("_r") - F.col("row")).alias("row"), (F.col("_c") - F.col("col")).alias("col"), "v"
    )
    near = distance.filter(F.abs("distance") <= reach).select("row", "distance")
    placed = positions.select("row", "col", (-F.col("x")).alias("x"), (-F.col("y")).alias("y"))
    return flipped.join(near, "row").join(placed, ["row", "col"])


def threshold(pixels: DataFrame, level: float = 175.0) -> DataFrame:
    """1 below the level, 0 at or above it."""
    return pixels.withColumn("ice", F.when(F.col("v") < level, 1).otherwise(0))


def ice_share(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*IMAGE).agg(F.avg("ice").alias("share"), F.count(F.lit(1)).alias("n"))


def _sliding(pixels: DataFrame, along: str, across: str, radius: int, f) -> DataFrame:
    """Minimum or maximum over ``radius`` pixels either way along one axis; missing pixels have no say.

    Lines are cut into tiles; pixels near a tile's edge also visit the neighbouring tile, so a
    task holds one tile with its margins however long the line is. In a tile, blocks as long as the
    window are scanned forwards and backwards: a window is the end of one block and the start of
    the next, so the work does not depend on the radius. Short windows are read pixel by pixel,
    which costs less than the scans' sorts.
    """
    width, side = max(4 * radius, 1024), 2 * radius + 1
    tile = lambda c: F.floor(c / width)
    block = lambda c: F.floor(c / side)
    line = [*IMAGE, across, "_tile"]
    visits = pixels.withColumn(
        "_tile", F.explode(F.sequence(tile(F.col(along) - radius), tile(F.col(along) + radius)))
    )
    if radius <= SHORT:
        w = Window.partitionBy(*line).orderBy(along).rangeBetween(-radius, radius)
        return visits.withColumn("v", f("v").over(w)).filter(F.col("_tile") == tile(F.col(along))).drop("_tile")
    visits = visits.repartition(*line)
    best = F.least if f is F.min else F.greatest
    so_far = lambda order: f("v").over(
        Window.partitionBy(*line, block(F.col(along))).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    # The scan at the last pixel within the radius, if that pixel lies in the block at the window's end.
    reached = lambda order: Window.partitionBy(*line).orderBy(order).rangeBetween(Window.unboundedPreceding, radius)
    up, down = F.col(along).asc(), F.col(along).desc()
    scanned = visits.withColumns({"_to": so_far(up), "_from": so_far(down)})
    cell = lambda c: F.struct(F.col(along).alias("at"), F.col(c).alias("v"))
    met = scanned.withColumns(
        {"_right": F.last(cell("_to")).over(reached(up)), "_left": F.last(cell("_from")).over(reached(down))}
    )
    part = lambda c, edge: F.when(block(F.col(f"{c}.at")) == block(edge), F.col(f"{c}.v"))
    value = best(part("_right", F.col(along) + radius), part("_left", F.col(along) - radius))
    kept = met.filter(F.col("_tile") == tile(F.col(along)))
    return kept.withColumn("v", value).drop("_tile", "_to", "_from", "_right", "_left")


def opening(pixels: DataFrame, radius: int) -> DataFrame:
    """Morphological opening with a square of side 2·radius + 1 (row pass, then column pass)."""
    low = _sliding(_sliding(pixels, "col", "row", radius, F.min), "row", "col", radius, F.min)
    return _sliding(_sliding(low, "col", "row", radius, F.max), "row", "col", radius, F.max)


def remove_background(pixels: DataFrame, radius: int = 300) -> DataFrame:
    background = opening(pixels, radius).withColumnRenamed("v", "_b")
    joined = pixels.join(background, [*IMAGE, "row", "col"])
    return joined.withColumn("v", F.col("v") - F.col("_b")).drop("_b")


def stretch(pixels: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Contrast stretch to the low and high quantiles of each image, clipped to 0…1.

    The quantiles count the distinct levels of one picture."""
    limits = add_group_quantiles(pixels, IMAGE, "v", {"_lo": low, "_hi": high}, small=True)
    scaled = F.try_divide(F.col("v") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return limits.withColumn("v", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))).drop("_lo", "_hi")


def otsu_levels(pixels: DataFrame) -> DataFrame:
    """Per image the level (0…1) with the largest between-class variance; plateaus averaged.

    Works on 256 bins per image, so only counts are ordered.
    """
    bins = pixels.filter(F.col("v").isNotNull()).groupBy(
        *IMAGE, F.floor(F.col("v") * 255 + 0.5).alias("k")
    ).agg(F.count(F.lit(1)).alias("c"))
    totals = bins.groupBy(*IMAGE).agg(F.sum("c").alias("_n"), F.sum(F.col("c") * F.col("k")).alias("_s"))
    every = totals.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(255).cast("bigint"))))
    filled = every.join(bins, [*IMAGE, "k"], "left")
    upto = Window.partitionBy(*IMAGE).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    c = F.coalesce("c", F.lit(0))
    walked = filled.withColumns({"_w": F.sum(c).over(upto), "_m": F.sum(c * F.col("k")).over(upto)})
    w, m, n, s = (F.col(x).cast("double") for x in ("_w", "_m", "_n", "_s"))
    gap = s * w - m * n
    variance = F.try_divide(gap * gap, w * (n - w))
    scored = walked.withColumn("_var", variance)
    top = with_group(scored, IMAGE, {"_top": F.max("_var")})
    return top.filter(F.col("_var") == F.col("_top")).groupBy(*IMAGE).agg(
        (F.avg("k") / 255).alias("level")
    )


def binarise(pixels: DataFrame) -> DataFrame:
    levels = otsu_levels(pixels)
    joined = null_safe_join(pixels, levels, IMAGE, "left")
    return joined.withColumn("bw", F.when(F.col("v") > F.col("level"), 1).otherwise(0))


def remove_small(pixels: DataFrame, size: int = 5, side: int = 128) -> DataFrame:
    """Clear set pixels (bw = 1) whose 8-connected component has fewer than ``size`` pixels.

    From any pixel of a component with ``size`` pixels, as many are reached in size − 1 steps. So
    each tile is labelled with a margin of size − 1 pixels, and what it holds of a component
    decides for the tile's own pixels. One shuffle; a task holds one tile at a time.
    """
    margin = size - 1
    side = max(side, 4 * size)
    own = lambda c: F.floor(F.col(c) / side).cast("int")
    visited = lambda c: F.sequence(
        F.floor((F.col(c) - margin) / side).cast("int"), F.floor((F.col(c) + margin) / side).cast("int")
    )
    is_set = F.coalesce(F.col("bw") == 1, F.lit(False))
    seen = pixels
    for axis, tile in (("row", "_tile_row"), ("col", "_tile_col")):
        seen = seen.withColumn(tile, F.explode(F.when(is_set, visited(axis)).otherwise(F.array(own(axis)))))
    names = pixels.columns
    tile = ["_tile_key", "_tile_row", "_tile_col"]
    dealt = seen.withColumn("_tile_key", F.xxhash64(*IMAGE, "_tile_row", "_tile_col"))
    dealt = dealt.repartition(*tile).sortWithinPartitions(*tile)
    bw = pixels.schema["bw"].dataType.simpleString()

    def cleaned(rows: pa.Table, number: np.ndarray) -> list[pa.RecordBatch]:
        value = lambda c: rows.column(c).to_numpy().astype(np.int64)
        row = value("row") - value("_tile_row") * side + margin
        col = value("col") - value("_tile_col") * side + margin
        is_set = pc.fill_null(pc.equal(rows.column("bw"), 1), False).to_numpy()
        cells = np.stack([number, row, col])[:, is_set]
        large = np.zeros(len(number), bool)
        large[is_set] = component_sizes(*cells, side + 2 * margin) >= size
        inner = (row >= margin) & (row < side + margin) & (col >= margin) & (col < side + margin)
        flags = pa.array(large.astype(np.int32)).cast(rows.schema.field("bw").type)
        out = rows.set_column(rows.schema.names.index("bw"), "bw", flags)
        return out.select(names).filter(pa.array(inner)).to_batches()

    def work(batches):
        held = None
        for b in batches:
            rows = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
            at = np.stack([rows.column(c).to_numpy() for c in tile])
            number = np.cumsum(np.append(0, (at[:, 1:] != at[:, :-1]).any(axis=0))) if rows.num_rows else at[0]
            cut = int(np.searchsorted(number, number[-1])) if rows.num_rows else 0
            if cut:
                yield from cleaned(rows.slice(0, cut), number[:cut])
            held = rows.slice(cut)
        if held is not None and held.num_rows:
            yield from cleaned(held, np.zeros(held.num_rows, np.int64))

    schema = ", ".join(f"`{f.name}` {bw if f.name == 'bw' else f.dataType.simpleString()}" for f in pixels.schema)
    return dealt.mapInArrow(work, schema)


def component_sizes(tile: np.ndarray, row: np.ndarray, col: np.ndarray, side: int) -> np.ndarray:
    """For each cell the number of cells in its 8-connected component of the same tile.

    Rows and columns lie in 0…side − 1. Neighbours are looked up among the sorted cells; of two
    neighbours' roots the higher is hung on the lower until all neighbours share one.
    """
    wide = side + 2
    cells, at = np.unique((tile * wide + row + 1) * wide + col + 1, return_inverse=True)
    ends = []
    for step in (1, wide - 1, wide, wide + 1):
        place = np.minimum(np.searchsorted(cells, cells + step), max(len(cells) - 1, 0))
        met = np.flatnonzero(cells[place] == cells + step) if len(cells) else place
        ends.append(np.stack([met, place[met]]))
    a, b = np.concatenate(ends, axis=1)
    root = np.arange(len(cells))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    return np.bincount(root, minlength=len(cells))[root][at]


def grey_histogram(pixels: DataFrame, width: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    from polynya.operators.aggregates import histogram

    return histogram(pixels.filter(F.col("v") > 0), F.col("v"), width, keys)
