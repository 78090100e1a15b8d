"""Image operators: one row an image in, one row (or row a view) out (IMG01-IMG22).

An image row holds path, h, w, c and data (bytes, row-major, RGB).  A kernel
sees one image, so operators are Arrow maps without a shuffle; a row whose
bytes do not fit its size gives NULLs, never an error.  The pixel-relational
versions below express the same on (image, row, col, value) rows in built-in
functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import pixels

IMAGE = "path string, h int, w int, c int, data binary"


def decoded(spark, folder: str, keep_unreadable: bool = False) -> DataFrame:
    """SRC10, SRC11: image rows of a folder, decoded by the built-in source.

    Gray is repeated, alpha dropped, channels are in RGB order.  Unreadable
    files are left out or, with ``keep_unreadable``, have only a path, so that
    ``unreadable`` can count them.
    """
    raw = spark.read.format("image").option("dropInvalid", not keep_unreadable).option("recursiveFileLookup", True).load(folder)
    rows = raw.select(F.col("image.origin").alias("path"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("c"), F.col("image.data").alias("data"))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                if not r["data"] or r["h"] < 1:
                    out.append({"path": r["path"]})
                    continue
                a = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"], r["c"])
                a = pixels.as_rgb(a[:, :, [2, 1, 0]] if r["c"] >= 3 else a)
                out.append({"path": r["path"], "h": r["h"], "w": r["w"], "c": 3, "data": a.tobytes()})
            if out:
                yield from pa.Table.from_pylist(out, schema=pa.schema([("path", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("c", pa.int32()), ("data", pa.binary())])).to_batches()

    return rows.mapInArrow(turn, IMAGE)


def unreadable(images: DataFrame) -> DataFrame:
    """SRC11: (n, n_unreadable) of image rows."""
    return images.agg(F.count("*").alias("n"), F.count_if(F.col("data").isNull()).alias("n_unreadable"))


def _image(r: dict) -> np.ndarray | None:
    h, w, c, data = r["h"], r["w"], r["c"], r["data"]
    if not h or not w or not c or data is None or len(data) != h * w * c:
        return None
    return pixels.as_rgb(np.frombuffer(data, np.uint8).reshape(h, w, c))


def mapped(images: DataFrame, kernel, schema: str) -> DataFrame:
    """path with the columns that ``kernel(image)`` returns as a dict (NULLs for unusable rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                a = _image(r)
                rows.append({"path": r["path"]} | (kernel(a) if a is not None else {}))
            if rows:
                yield from pa.Table.from_pylist(rows, schema=want).to_batches()

    full = f"path string, {schema}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    want = to_arrow_schema(StructType.fromDDL(full))
    return images.select("path", "h", "w", "c", "data").mapInArrow(run, full)


def preprocessed(images: DataFrame, side: int = pixels.SIDE, least: int = pixels.LEAST_AREA) -> DataFrame:
    """IMG13, SNK07, SNK08: the enhanced, masked image and its mask (0 or 255), with their base64 forms added by ``with_base64``."""

    def kernel(a: np.ndarray) -> dict:
        s = pixels.pipeline(a, side, least)
        return {"side": side, "masked": s["masked"].tobytes(), "mask": (s["mask"].astype(np.uint8) * 255).tobytes()}

    return mapped(images, kernel, "side int, masked binary, mask binary")


def with_base64(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({f"{c}_base64": F.base64(c) for c in cols})


def feature_table(images: DataFrame, side: int = pixels.SIDE, least: int = pixels.LEAST_AREA) -> DataFrame:
    """IMG17, IMG18: path, label (the parent folder) and the 50 features of the preprocessed image."""

    def kernel(a: np.ndarray) -> dict:
        s = pixels.pipeline(a, side, least)
        return {"features": pixels.features(s["masked"], s["mask"]).tolist()}

    out = mapped(images, kernel, "features array<double>")
    return out.select("path", F.element_at(F.split("path", "/"), -2).alias("label"), "features")


def hashes(images: DataFrame) -> DataFrame:
    """IMG19: path and the 16-digit difference hash."""
    return mapped(images, lambda a: {"dhash": f"{pixels.dhash(np.rint(pixels.gray(a))):016x}"}, "dhash string")


def signatures(images: DataFrame, least: int = 40) -> DataFrame:
    """IMG20: path and lesion signature; NULLs where too little is diseased."""

    def kernel(a: np.ndarray) -> dict:
        s = pixels.lesion_signature(a, least)
        return {} if s is None else dict(zip(("coverage", "lum", "rough", "brown"), s.tolist()))

    return mapped(images, kernel, "coverage double, lum double, rough double, brown double")


def scored_views(images: DataFrame, score, classes: list[str], n: int = 8, side: int = 224) -> DataFrame:
    """IMG21, ML06: mean class probabilities over ``n`` views; ``score(list of views)`` gives an (n, classes) array."""

    def kernel(a: np.ndarray) -> dict:
        p = np.asarray(score(pixels.crops(a, n, side)), np.float64)
        return {"scores": [{"cls": c, "p": float(x)} for c, x in zip(classes, p.mean(0))], "uncertainty": float(p.std(0).max())}

    return mapped(images, kernel, "scores array<struct<cls: string, p: double>>, uncertainty double")


# ---- pixel-relational versions


def pixel_rows(df: DataFrame, key: str, values: Column, width: int) -> DataFrame:
    """key, row, col, v of row-major arrays."""
    at = F.posexplode(values).alias("i", "v")
    return df.select(key, at).select(key, F.floor(F.col("i") / width).cast("int").alias("row"), (F.col("i") % width).cast("int").alias("col"), "v")


def convolved(px: DataFrame, key: str, weights: dict[tuple[int, int], float]) -> DataFrame:
    """IMG03: sum of weight x neighbour; neighbours beyond the edge count 0.

    Each pixel is sent to the places it reaches (a bounded fan-out of one row)
    and summed there: one aggregation, no self-join.
    """
    taps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(w)).alias("k")) for (dy, dx), w in weights.items()])
    size = px.groupBy(key).agg(F.max("row").alias("_h"), F.max("col").alias("_w"))
    sent = px.select(key, "row", "col", "v", F.explode(taps).alias("t")).select(key, (F.col("row") - F.col("t.dy")).alias("row"), (F.col("col") - F.col("t.dx")).alias("col"), (F.col("v") * F.col("t.k")).alias("v"))
    summed = sent.groupBy(key, "row", "col").agg(F.sum("v").alias("v"))
    return summed.join(size, key).where("row BETWEEN 0 AND _h AND col BETWEEN 0 AND _w").select(key, "row", "col", "v")


def gaussian_weights(sigma: float = pixels.BLUR_SIGMA) -> dict[tuple[int, int], float]:
    r = int(np.ceil(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    return {(y - r, x - r): float(k[y] * k[x]) for y in range(2 * r + 1) for x in range(2 * r + 1)}


def stretched(px: DataFrame, key: str) -> DataFrame:
    """IMG06: values to the unit range of their image."""
    w = Window.partitionBy(key)
    low, high = F.min("v").over(w), F.max("v").over(w)
    return px.select(key, "row", "col", F.when(high > low, (F.col("v") - low) / (high - low)).otherwise(F.col("v")).alias("v"))


def hsv_columns(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """IMG04 as expressions on bytes."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    hue = F.when(span == 0, 0.0).when(top == r, F.pmod((g - b) / span, F.lit(6.0))).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4) / 6
    return hue, F.when(top > 0, span / top).otherwise(0.0), top / 255


def rgb_columns(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """IMG05 as expressions: red, green and blue in [0, 1]; a hue of a whole turn lies in no sector."""
    six, chroma = h * 6, v * s
    near = chroma * (1 - F.abs(F.pmod(six, F.lit(2.0)) - 1))
    k = F.floor(six)
    pick = lambda full, part: F.when(k.isin(*full), chroma).when(k.isin(*part), near).otherwise(0.0) + v - chroma
    return pick((0, 5), (1, 4)), pick((1, 2), (0, 3)), pick((3, 4), (2, 5))


def cooccurrence(px: DataFrame, key: str, levels: int = 64) -> DataFrame:
    """IMG15: texture values of each image from (key, row, col, v); the four offsets by one equi-join on places."""
    top = F.max("v").over(Window.partitionBy(key))
    q = px.select(key, "row", "col", F.when(top == 0, 0).otherwise(F.least(F.lit(levels - 1), F.floor(F.col("v") / top * (levels - 1)))).cast("int").alias("q"))
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 1), (1, 0), (1, -1))])
    a = q.select(key, F.col("q").alias("i"), F.explode(offsets).alias("o"), "row", "col").select(key, "i", (F.col("row") + F.col("o.dy")).alias("row"), (F.col("col") + F.col("o.dx")).alias("col"))
    met = a.join(q.withColumnRenamed("q", "j"), [key, "row", "col"]).select(key, "i", "j")
    n = met.unionByName(met.select(key, F.col("j").alias("i"), F.col("i").alias("j"))).groupBy(key, "i", "j").agg(F.count("*").alias("n"))
    p = n.select(key, "i", "j", (F.col("n") / F.sum("n").over(Window.partitionBy(key))).alias("p"))
    mean = F.sum(F.col("i") * F.col("p")).over(Window.partitionBy(key))
    d = p.withColumn("m", mean)
    var = F.sum((F.col("i") - F.col("m")) ** 2 * F.col("p"))
    cov = F.sum((F.col("i") - F.col("m")) * (F.col("j") - F.col("m")) * F.col("p"))
    return d.groupBy(key).agg(
        F.sum((F.col("i") - F.col("j")) ** 2 * F.col("p")).alias("contrast"), F.when(var > 1e-12, cov / var).otherwise(0.0).alias("correlation"),
        F.sum(F.col("p") ** 2).alias("energy"), F.sum(F.col("p") / (1 + F.abs(F.col("i") - F.col("j")))).alias("homogeneity"),
    )


def gradient(px: DataFrame, key: str) -> DataFrame:
    """IMG20: forward-difference magnitude; the edge repeats."""
    right = F.lead("v").over(Window.partitionBy(key, "row").orderBy("col"))
    below = F.lead("v").over(Window.partitionBy(key, "col").orderBy("row"))
    return px.select(key, "row", "col", F.hypot(F.coalesce(right, "v") - F.col("v"), F.coalesce(below, "v") - F.col("v")).alias("g"))
