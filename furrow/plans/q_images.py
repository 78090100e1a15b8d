"""Queries on image kernels; 8 x 8 images made of the embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from furrow.functions import pixels
from furrow.operators import filters, image
from furrow.plans.registry import query
from furrow.sources.tables import table

# A 64-entry embedding as 64 bytes.
def _px():
    return F.transform("embedding", lambda e: F.floor(F.least(F.greatest(e.cast("double") * 320 + 128, F.lit(0.0)), F.lit(255.0))).cast("double"))


_G = """g AS (SELECT vec_id, (k - 1) // 8 AS "row", (k - 1) % 8 AS col, floor(least(greatest(CAST(embedding[k] AS DOUBLE) * 320 + 128, 0), 255)) AS v FROM embeddings, range(1, 65) r(k))"""
_M = f"{_G}, mk AS (SELECT * FROM g WHERE v >= 128)"


def _pixels(spark, d):
    return image.pixel_rows(table(spark, d, "embeddings"), "vec_id", _px(), 8)


def _images(spark, d):
    """Image rows: gray 8 x 8, as three equal channels by the kernels."""

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            e = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 64).astype(np.float64)
            px = np.floor(np.clip(e * 320 + 128, 0, 255)).astype(np.uint8)
            n = len(px)
            yield pa.RecordBatch.from_arrays([pa.array([f"/grid/{i}.png" for i in b.column(0).to_pylist()]), *(pa.array([x] * n, pa.int32()) for x in (8, 8, 1)), pa.array([r.tobytes() for r in px], pa.binary())], names=["path", "h", "w", "c", "data"])

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInArrow(pack, image.IMAGE)


# Colour: the three channels of a pixel are entries 21 apart, and strong enough to cross the bands.
def _tap(i: int) -> str:
    return f"floor(least(greatest(CAST(embedding[(k - 1 + {i}) % 64 + 1] AS DOUBLE) * 900 + 128, 0), 255))"


CHANNELS = f"""px AS (SELECT vec_id, (k - 1) // 8 AS "row", (k - 1) % 8 AS col, {_tap(0)} AS r, {_tap(21)} AS g, {_tap(42)} AS b FROM embeddings, range(1, 65) r(k))"""


def colour_images(spark, d):
    """Image rows: colour 8 x 8."""

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            e = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 64).astype(np.float64)
            one = np.floor(np.clip(e * 900 + 128, 0, 255)).astype(np.uint8)
            px = np.stack([np.roll(one, -i, axis=1) for i in (0, 21, 42)], axis=2)
            n = len(px)
            yield pa.RecordBatch.from_arrays([pa.array([f"/grid/{i}.png" for i in b.column(0).to_pylist()]), *(pa.array([x] * n, pa.int32()) for x in (8, 8, 3)), pa.array([r.tobytes() for r in px], pa.binary())], names=["path", "h", "w", "c", "data"])

    # A kernel takes far longer than a row's bytes tell, so the rows are spread before.
    return table(spark, d, "embeddings").select("vec_id", "embedding").repartition(spark.sparkContext.defaultParallelism).mapInArrow(pack, image.IMAGE)


def _keyed(df):
    return df.withColumn("vec_id", F.regexp_extract("path", r"(\d+)\.png$", 1).cast("bigint")).drop("path")


@query(f"""WITH {_G} SELECT vec_id, "row", col, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE v END, 6) AS v FROM (SELECT *, min(v) OVER (PARTITION BY vec_id) AS lo, max(v) OVER (PARTITION BY vec_id) AS hi FROM g)""")
def img06_stretched(spark, d):
    return image.stretched(_pixels(spark, d), "vec_id").withColumn("v", F.round("v", 6))


_K1 = "(SELECT k, exp(-(k * k) / 4.5) / sum(exp(-(k * k) / 4.5)) OVER () AS w FROM range(-5, 6) r(k))"


@query(f"""WITH {_G}, y AS (SELECT g.vec_id, g."row" - a.k AS "row", g.col, sum(g.v * a.w) AS v FROM g, {_K1} a GROUP BY 1, 2, 3), x AS (SELECT y.vec_id, y."row", y.col - b.k AS col, sum(y.v * b.w) AS v FROM y, {_K1} b GROUP BY 1, 2, 3)
SELECT vec_id, CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, round(v, 5) AS v FROM x WHERE "row" BETWEEN 0 AND 7 AND col BETWEEN 0 AND 7""")
def img03_blurred(spark, d):
    return image.convolved(_pixels(spark, d), "vec_id", image.gaussian_weights()).withColumn("v", F.round("v", 5))


@query("""SELECT vec_id, round(CASE WHEN mx = mn THEN 0 WHEN mx = r THEN ((g - b) / (mx - mn) - 6 * floor((g - b) / (mx - mn) / 6)) WHEN mx = g THEN (b - r) / (mx - mn) + 2 ELSE (r - g) / (mx - mn) + 4 END / 6, 6) AS h,
 round(CASE WHEN mx > 0 THEN (mx - mn) / mx ELSE 0 END, 6) AS s, round(mx / 255, 6) AS v FROM (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM (SELECT vec_id, floor(abs(CAST(embedding[1] AS DOUBLE)) * 320) AS r, floor(abs(CAST(embedding[2] AS DOUBLE)) * 320) AS g, floor(abs(CAST(embedding[3] AS DOUBLE)) * 320) AS b FROM embeddings))""")
def img04_hsv(spark, d):
    channel = lambda i: F.floor(F.abs(F.get("embedding", F.lit(i)).cast("double")) * 320).cast("double")
    rgb = table(spark, d, "embeddings").select("vec_id", *[channel(i).alias(c) for i, c in enumerate("rgb")])
    h, s, v = image.hsv_columns(F.col("r"), F.col("g"), F.col("b"))
    return rgb.select("vec_id", F.round(h, 6).alias("h"), F.round(s, 6).alias("s"), F.round(v, 6).alias("v"))


@query("""SELECT vec_id, h BETWEEN 0.05 AND 0.45 AND s >= 0.15 AND v >= 0.10 AS leaf, (v > 0.60 AND s < 0.20) OR (v > 0.30 AND v < 0.75 AND s < 0.32 AND r > b) AS spot
 FROM (SELECT vec_id, (CAST(embedding[1] AS DOUBLE) + 0.5) AS h, abs(CAST(embedding[2] AS DOUBLE)) * 2 AS s, abs(CAST(embedding[3] AS DOUBLE)) * 4 AS v, CAST(embedding[4] AS DOUBLE) AS r, CAST(embedding[5] AS DOUBLE) AS b FROM embeddings)""")
def flt06_flt07_bands(spark, d):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    x = table(spark, d, "embeddings").select("vec_id", (e(0) + 0.5).alias("h"), (F.abs(e(1)) * 2).alias("s"), (F.abs(e(2)) * 4).alias("v"), e(3).alias("r"), e(4).alias("b"))
    return x.select("vec_id", filters.in_leaf_band(F.col("h"), F.col("s"), F.col("v")).alias("leaf"), filters.lesion(F.col("r"), F.col("b"), F.col("s"), F.col("v")).alias("spot"))


_GLCM = f"""{_G}, q AS (SELECT vec_id, "row", col, CASE WHEN mx = 0 THEN 0 ELSE least(63, floor(v / mx * 63)) END AS q FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS mx FROM g)),
o AS (SELECT * FROM (VALUES (0, 1), (1, 1), (1, 0), (1, -1)) t(dr, dc)), pr AS (SELECT a.vec_id, a.q AS i, b.q AS j FROM q a, o, q b WHERE a.vec_id = b.vec_id AND b."row" = a."row" + dr AND b.col = a.col + dc),
n AS (SELECT vec_id, i, j, count(*) AS n FROM (SELECT * FROM pr UNION ALL SELECT vec_id, j, i FROM pr) GROUP BY 1, 2, 3), p AS (SELECT vec_id, i, j, n / sum(n) OVER (PARTITION BY vec_id) AS p FROM n), m AS (SELECT *, sum(i * p) OVER (PARTITION BY vec_id) AS mu FROM p)
SELECT vec_id, round(sum((i - j) * (i - j) * p), 5) AS contrast, round(CASE WHEN sum((i - mu) * (i - mu) * p) > 1e-12 THEN sum((i - mu) * (j - mu) * p) / sum((i - mu) * (i - mu) * p) ELSE 0 END, 5) AS correlation, round(sum(p * p), 5) AS energy, round(sum(p / (1 + abs(i - j))), 5) AS homogeneity FROM m GROUP BY vec_id"""
_TEXTURE = ["contrast", "correlation", "energy", "homogeneity"]


@query("WITH " + _GLCM)
def img15_texture(spark, d):
    return image.cooccurrence(_pixels(spark, d), "vec_id").withColumns({c: F.round(c, 5) for c in _TEXTURE})


@query("WITH " + _GLCM)
def img15_texture_kernel(spark, d):
    out = image.mapped(_images(spark, d), lambda a: dict(zip(_TEXTURE, pixels.texture(a[:, :, 0].astype(float)).tolist())), ", ".join(f"{c} double" for c in _TEXTURE))
    return _keyed(out.withColumns({c: F.round(c, 5) for c in _TEXTURE}))


@query(f"""WITH {_G}, r AS (SELECT *, coalesce(lead(v) OVER (PARTITION BY vec_id, "row" ORDER BY col), v) - v AS dx, coalesce(lead(v) OVER (PARTITION BY vec_id, col ORDER BY "row"), v) - v AS dy FROM g) SELECT vec_id, round(avg(sqrt(dx * dx + dy * dy)), 5) AS rough FROM r GROUP BY vec_id""")
def img20_roughness(spark, d):
    return image.gradient(_pixels(spark, d), "vec_id").groupBy("vec_id").agg(F.round(F.avg("g"), 5).alias("rough"))


_COMP = f"""{_M}, e AS (SELECT a.vec_id, a."row" * 8 + a.col AS a, b."row" * 8 + b.col AS b FROM mk a JOIN mk b ON a.vec_id = b.vec_id AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1),
reach(vec_id, a, b) AS (SELECT vec_id, a, b FROM e UNION SELECT r.vec_id, r.a, e.b FROM reach r JOIN e ON r.vec_id = e.vec_id AND r.b = e.a), c AS (SELECT vec_id, a, min(b) AS root FROM reach GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_COMP} SELECT vec_id, count(DISTINCT root) AS n_parts, max(n) AS largest FROM (SELECT vec_id, root, count(*) OVER (PARTITION BY vec_id, root) AS n FROM c) GROUP BY vec_id")
def img08_components(spark, d):
    def kernel(a):
        _, sizes = pixels.label(a[:, :, 0] >= 128)
        return {"n_parts": len(sizes), "largest": int(sizes.max()) if len(sizes) else None}

    return _keyed(image.mapped(_images(spark, d), kernel, "n_parts bigint, largest bigint")).where("n_parts > 0")


@query(f"WITH RECURSIVE {_COMP} SELECT vec_id, count(*) AS kept FROM (SELECT vec_id, root, count(*) OVER (PARTITION BY vec_id, root) AS n FROM c) WHERE n >= 5 GROUP BY vec_id")
def img09_area_open(spark, d):
    kernel = lambda a: {"kept": int(pixels.area_open(a[:, :, 0] >= 128, 5).sum())}
    return _keyed(image.mapped(_images(spark, d), kernel, "kept bigint")).where("kept > 0")


@query(f"""WITH RECURSIVE {_G}, bg AS (SELECT vec_id, "row", col FROM g WHERE v < 128), f(vec_id, "row", col) AS (SELECT vec_id, "row", col FROM bg WHERE "row" IN (0, 7) OR col IN (0, 7)
 UNION SELECT b.vec_id, b."row", b.col FROM f JOIN bg b ON f.vec_id = b.vec_id AND abs(f."row" - b."row") + abs(f.col - b.col) = 1) SELECT e.vec_id, 64 - count(f.col) AS filled FROM embeddings e LEFT JOIN f ON f.vec_id = e.vec_id GROUP BY e.vec_id""")
def img10_filled(spark, d):
    return _keyed(image.mapped(_images(spark, d), lambda a: {"filled": int(pixels.fill_holes(a[:, :, 0] >= 128).sum())}, "filled bigint"))


_DISK = "(SELECT y, x FROM range(-1, 2) a(y), range(-1, 2) b(x) WHERE y * y + x * x <= 1)"


@query(f"""WITH {_M}, dil AS (SELECT DISTINCT vec_id, "row" + y AS "row", col + x AS col FROM mk, {_DISK} WHERE "row" + y BETWEEN 0 AND 7 AND col + x BETWEEN 0 AND 7), ero AS (SELECT vec_id, "row" + y AS "row", col + x AS col FROM dil, {_DISK} GROUP BY 1, 2, 3 HAVING count(*) = 5)
SELECT vec_id, count(*) AS closed FROM ero WHERE "row" BETWEEN 0 AND 7 AND col BETWEEN 0 AND 7 GROUP BY vec_id""")
def img11_closed(spark, d):
    kernel = lambda a: {"closed": int(pixels.close(a[:, :, 0] >= 128, 1).sum())}
    return _keyed(image.mapped(_images(spark, d), kernel, "closed bigint")).where("closed > 0")


@query(f"""WITH {_G}, w AS (SELECT c, k, greatest(0, least((k + 1) * 8 / 9, c + 1) - greatest(k * 8 / 9, c)) * 9 / 8 AS s FROM range(0, 8) a(c), range(0, 9) b(k)),
sm AS (SELECT g.vec_id, g."row", w.k, round_even(round(sum(g.v * w.s), 9), 0) AS v FROM g JOIN w ON g.col = w.c GROUP BY 1, 2, 3), b AS (SELECT vec_id, "row", k, (lead(v) OVER (PARTITION BY vec_id, "row" ORDER BY k) > v)::INT AS bit FROM sm),
x AS (SELECT vec_id, string_agg(bit::VARCHAR, '' ORDER BY "row", k) AS bits FROM b WHERE k < 8 GROUP BY 1)
SELECT vec_id, bits FROM x""")
def img19_dhash(spark, d):
    kernel = lambda a: {"bits": f"{pixels.dhash(a[:, :, 0]):064b}"}
    return _keyed(image.mapped(_images(spark, d), kernel, "bits string"))


# The whole pipeline on a canvas of 16 x 16, from the raw colours to the mask, pixel by pixel.
_SIDE, _LEAST = 16, 20
_HSV = """CASE WHEN top = low THEN 0 WHEN top = r THEN ((g - b) / (top - low) - 6 * floor((g - b) / (top - low) / 6)) WHEN top = g THEN (b - r) / (top - low) + 2 ELSE (r - g) / (top - low) + 4 END / 6 AS h,
 CASE WHEN top > 0 THEN (top - low) / top ELSE 0 END AS s, top AS v"""


def _hsv_of(source: str, keep: str = "") -> str:
    return f"""SELECT vec_id, "row", col, {keep} {_HSV} FROM (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low FROM (SELECT vec_id, "row", col, {keep} r / 255 AS r, g / 255 AS g, b / 255 AS b FROM {source}))"""


def _labels(name: str, pixels_: str, reach: str) -> str:
    """Components of a set of pixels: the least place spreads between neighbours."""
    near = f"e_{name} AS MATERIALIZED (SELECT a.vec_id, a.pt AS a, b.pt AS b FROM {pixels_} a JOIN {pixels_} b ON a.vec_id = b.vec_id AND a.pt <> b.pt AND {reach})"
    return f"""{near}, {name}(vec_id, pt, root) USING KEY (vec_id, pt) AS (SELECT vec_id, pt, pt FROM {pixels_}
 UNION SELECT e.vec_id, e.b, min(c.root) FROM {name} c JOIN e_{name} e ON e.vec_id = c.vec_id AND e.a = c.pt JOIN recurring.{name} r ON r.vec_id = e.vec_id AND r.pt = e.b WHERE c.root < r.root GROUP BY e.vec_id, e.b)"""


_EIGHT = 'abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1'
_FOUR = 'abs(a."row" - b."row") + abs(a.col - b.col) = 1'
_ROUND = "(SELECT y, x FROM range(-3, 4) a(y), range(-3, 4) b(x) WHERE y * y + x * x <= 9)"
_PIPELINE = f"""{CHANNELS}, tw AS (SELECT o, k, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, k, greatest(0, 1 - abs(k + 0.5 - (o + 0.5) * 8 / {_SIDE})) AS w FROM range(0, {_SIDE}) a(o), range(0, 8) b(k)) WHERE w > 0),
ch AS (SELECT vec_id, "row", col, unnest([1, 2, 3]) AS c, unnest([r, g, b]) AS v FROM px),
z1 AS (SELECT vec_id, c, o AS "row", col, sum(v * w) AS v FROM ch JOIN tw ON "row" = k GROUP BY ALL), z2 AS (SELECT vec_id, c, "row", o AS col, round_even(sum(v * w), 0) AS v FROM z1 JOIN tw ON col = k GROUP BY ALL),
y1 AS (SELECT z2.vec_id, c, "row" - k AS "row", col, sum(v * w) AS v FROM z2, {_K1} t WHERE "row" - k BETWEEN 0 AND {_SIDE - 1} GROUP BY ALL), y2 AS (SELECT y1.vec_id, c, "row", col - k AS col, round_even(sum(v * w), 0) AS v FROM y1, {_K1} t WHERE col - k BETWEEN 0 AND {_SIDE - 1} GROUP BY ALL),
fl AS MATERIALIZED (SELECT vec_id, "row", col, max(v) FILTER (c = 1) AS r, max(v) FILTER (c = 2) AS g, max(v) FILTER (c = 3) AS b FROM y2 GROUP BY ALL), h1 AS ({_hsv_of('fl')}),
st AS (SELECT vec_id, "row", col, h * 6 AS six, s, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE v END AS v FROM (SELECT *, min(v) OVER (PARTITION BY vec_id) AS lo, max(v) OVER (PARTITION BY vec_id) AS hi FROM h1)),
sx AS (SELECT vec_id, "row", col, CAST(floor(six) AS INT) AS k, v * s AS f, v * s * (1 - abs(six - 2 * floor(six / 2) - 1)) AS n, v - v * s AS m FROM st),
en AS MATERIALIZED (SELECT vec_id, "row", col, round_even((CASE WHEN k IN (0, 5) THEN f WHEN k IN (1, 4) THEN n ELSE 0 END + m) * 255, 0) AS r, round_even((CASE WHEN k IN (1, 2) THEN f WHEN k IN (0, 3) THEN n ELSE 0 END + m) * 255, 0) AS g, round_even((CASE WHEN k IN (3, 4) THEN f WHEN k IN (2, 5) THEN n ELSE 0 END + m) * 255, 0) AS b FROM sx),
h2 AS ({_hsv_of('en')}), m0 AS MATERIALIZED (SELECT vec_id, "row", col, "row" * {_SIDE} + col AS pt FROM h2 WHERE h BETWEEN 0.05 AND 0.45 AND s >= 0.15 AND v >= 0.10),
{_labels('c0', 'm0', _EIGHT)}, m1 AS MATERIALIZED (SELECT vec_id, pt FROM c0 JOIN (SELECT vec_id, root FROM c0 GROUP BY 1, 2 HAVING count(*) >= {_LEAST}) USING (vec_id, root)),
bg AS MATERIALIZED (SELECT vec_id, "row", col, "row" * {_SIDE} + col AS pt FROM en WHERE (vec_id, "row" * {_SIDE} + col) NOT IN (SELECT (vec_id, pt) FROM m1)), {_labels('cb', 'bg', _FOUR)},
sea AS MATERIALIZED (SELECT DISTINCT vec_id, root FROM cb WHERE pt // {_SIDE} IN (0, {_SIDE - 1}) OR pt % {_SIDE} IN (0, {_SIDE - 1})), m2 AS MATERIALIZED (SELECT vec_id, "row", col FROM en WHERE (vec_id, "row" * {_SIDE} + col) NOT IN (SELECT (vec_id, pt) FROM cb JOIN sea USING (vec_id, root))),
dl AS MATERIALIZED (SELECT DISTINCT vec_id, "row" + y AS "row", col + x AS col FROM m2, {_ROUND} WHERE "row" + y BETWEEN 0 AND {_SIDE - 1} AND col + x BETWEEN 0 AND {_SIDE - 1}),
mk AS MATERIALIZED (SELECT vec_id, "row" + y AS "row", col + x AS col, ("row" + y) * {_SIDE} + col + x AS pt FROM dl, {_ROUND} WHERE "row" + y BETWEEN 0 AND {_SIDE - 1} AND col + x BETWEEN 0 AND {_SIDE - 1} GROUP BY ALL HAVING count(*) = 29),
im AS MATERIALIZED (SELECT en.vec_id, en."row", en.col, r, g, b, mk.pt IS NOT NULL AS inside FROM en LEFT JOIN mk ON mk.vec_id = en.vec_id AND mk."row" = en."row" AND mk.col = en.col)"""


@query(f"WITH RECURSIVE {_PIPELINE} SELECT vec_id, count(*) FILTER (inside) AS n_mask, coalesce(sum(r) FILTER (inside), 0)::BIGINT AS r, coalesce(sum(g) FILTER (inside), 0)::BIGINT AS g, coalesce(sum(b) FILTER (inside), 0)::BIGINT AS b FROM im GROUP BY 1")
def img13_pipeline(spark, d):
    """IMG01-IMG13, SNK07, SNK08: mask and masked image in their base64 forms, read back and summed."""
    out = image.with_base64(image.preprocessed(colour_images(spark, d), _SIDE, _LEAST), "masked", "mask").select("path", F.unbase64("masked_base64").alias("data"), F.unbase64("mask_base64").alias("mask"))
    images = out.select("path", F.lit(_SIDE).alias("h"), F.lit(_SIDE).alias("w"), F.lit(3).alias("c"), "data").join(out.select("path", "mask"), "path")
    sums = image.mapped(images, lambda a: dict(zip("rgb", a.astype(int).sum((0, 1)).tolist())), "r bigint, g bigint, b bigint")
    n = out.select("path", F.length(F.replace(F.hex("mask"), F.lit("00"), F.lit(""))).alias("ff")).select("path", (F.col("ff") / 2).cast("bigint").alias("n_mask"))
    return _keyed(sums.join(n, "path"))


_SHAPE = f"""big AS (SELECT vec_id, root FROM cm GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, root) = 1), p AS (SELECT cm.vec_id, cm.pt // {{side}} AS y, cm.pt % {{side}} AS x FROM cm JOIN big USING (vec_id, root)),
w AS (SELECT p.vec_id, p.y, p.x, count(*) AS k FROM p JOIN p q ON q.vec_id = p.vec_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY ALL),
rim AS MATERIALIZED (SELECT vec_id, y, x FROM w WHERE k < 9), pq AS (SELECT a.vec_id, a.y AS y1, a.x AS x1, b.y AS y2, b.x AS x2 FROM rim a JOIN rim b ON a.vec_id = b.vec_id AND (a.y <> b.y OR a.x <> b.x)),
side AS (SELECT vec_id, y1, x1, y2, x2 FROM pq JOIN rim r USING (vec_id) GROUP BY ALL HAVING min((x2 - x1) * (r.y - y1) - (y2 - y1) * (r.x - x1)) >= 0
 AND count(*) FILTER ((x2 - x1) * (r.y - y1) = (y2 - y1) * (r.x - x1) AND ((x2 - x1) * (r.x - x1) + (y2 - y1) * (r.y - y1) < 0 OR (x2 - x1) * (r.x - x1) + (y2 - y1) * (r.y - y1) > (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) = 0),
hull AS (SELECT vec_id, abs(sum(x1 * y2 - y1 * x2)) / 2 AS hull FROM side GROUP BY 1),
t AS (SELECT vec_id, count(*) AS area, count(*) FILTER (k < 9) AS perimeter, avg(x) AS cx, avg(y) AS cy, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS cxy, count(*) / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1)) AS extent FROM w GROUP BY 1),
ex AS (SELECT *, 4 * sqrt(greatest(0, (vx + vy) / 2 + sqrt((vx - vy) * (vx - vy) / 4 + cxy * cxy))) AS major, 4 * sqrt(greatest(0, (vx + vy) / 2 - sqrt((vx - vy) * (vx - vy) / 4 + cxy * cxy))) AS minor FROM t),
sh AS (SELECT ex.*, CASE WHEN major > 0 THEN sqrt(greatest(0, 1 - (minor / major) * (minor / major))) ELSE 0 END AS ecc, CASE WHEN area >= 3 THEN least(1, area / greatest(coalesce(hull, 0), 1)) ELSE 1 END AS solidity FROM ex LEFT JOIN hull USING (vec_id))"""


@query(f"""WITH RECURSIVE {_PIPELINE}, {_labels('cm', 'mk', _EIGHT)}, {_SHAPE.format(side=_SIDE)},
ms AS MATERIALIZED (SELECT * FROM im WHERE inside), hv AS ({_hsv_of('ms')}), nb AS (SELECT vec_id, unnest([0, 16, 24]) AS base, unnest([16, 8, 4]) AS n, unnest([h, s, v]) AS x FROM hv),
hb AS (SELECT vec_id, base + least(n - 1, CAST(floor(x * n) AS INT)) AS i, count(*) AS k FROM nb WHERE x BETWEEN 0 AND 1 GROUP BY ALL), ht AS (SELECT vec_id, i, k / sum(k) OVER (PARTITION BY vec_id, CASE WHEN i < 16 THEN 0 WHEN i < 24 THEN 1 ELSE 2 END) AS f FROM hb),
mo AS (SELECT vec_id, c, v, avg(v) OVER q AS mu, stddev_pop(v) OVER q AS sd FROM (SELECT vec_id, unnest([0, 1, 2]) AS c, unnest([r, g, b]) AS v FROM ms) WINDOW q AS (PARTITION BY vec_id, c)),
m3 AS (SELECT vec_id, 28 + 3 * c AS i, any_value(mu) AS mu, any_value(sd) AS sd, CASE WHEN any_value(sd) > 0 THEN avg((v - mu) * (v - mu) * (v - mu)) / (any_value(sd) * any_value(sd) * any_value(sd)) ELSE 0 END AS sk FROM mo GROUP BY vec_id, c),
g AS (SELECT vec_id, "row", col, CASE WHEN inside THEN 0.2989::DOUBLE * r + 0.5870::DOUBLE * g + 0.1140::DOUBLE * b ELSE 0 END AS v FROM im WHERE vec_id IN (SELECT vec_id FROM ms)), tx AS (WITH {_GLCM[len(_G) + 2:].replace(", 5) AS", ", 12) AS")}),
f AS (SELECT vec_id, i, f FROM ht UNION ALL SELECT vec_id, unnest([i, i + 1, i + 2]), unnest([mu, sd, sk]) FROM m3 UNION ALL SELECT vec_id, unnest([37, 38, 39, 40]), unnest([contrast, correlation, energy, homogeneity]) FROM tx
 UNION ALL SELECT vec_id, unnest([41, 42, 43, 44, 45, 46, 47, 48, 49]), unnest([area, perimeter, cx, cy, major, minor, ecc, solidity, extent]::DOUBLE[]) FROM sh)
SELECT vec_id, i::INT AS i, round(f, 4) AS value FROM f WHERE round(f, 4) <> 0""")
def img17_features(spark, d):
    """IMG17, IMG18: the entries of the feature vectors that are not zero."""
    out = _keyed(image.feature_table(colour_images(spark, d), _SIDE, _LEAST).select("path", F.posexplode("features").alias("i", "value")))
    return out.select("vec_id", "i", F.round("value", 4).alias("value")).where("value != 0")


@query(f"""WITH RECURSIVE {_G}, mk AS MATERIALIZED (SELECT vec_id, "row", col, "row" * 8 + col AS pt FROM g WHERE v >= 128), {_labels('cm', 'mk', _EIGHT)}, {_SHAPE.format(side=8)}
SELECT vec_id, area::DOUBLE AS area, perimeter::DOUBLE AS perimeter, round(cx, 5) AS centroid_x, round(cy, 5) AS centroid_y, round(major, 5) AS major, round(minor, 5) AS minor, round(ecc, 5) AS eccentricity, round(solidity, 5) AS solidity, round(extent, 5) AS extent FROM sh""")
def img16_shape(spark, d):
    kernel = lambda a: {k: float(v) for k, v in zip(pixels.SHAPE, pixels.shape(a[:, :, 0] >= 128))}
    out = image.mapped(_images(spark, d), kernel, ", ".join(f"{c} double" for c in pixels.SHAPE)).where("area > 0")
    return _keyed(out.select("path", *[F.round(c, 5).alias(c) for c in pixels.SHAPE]))


@query()
def img17_features_full(spark, d):
    """The features at the operators' own canvas and areas."""
    return _keyed(image.feature_table(colour_images(spark, d)).select("path", F.transform("features", lambda v: F.round(v, 5)).alias("features")))


@query(f"""WITH {CHANNELS}, hv AS ({_hsv_of('px')}), x AS (SELECT px.*, s, v, round_even(round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 6), 0) AS y, v > 0.30 AND v < 0.75 AND s < 0.32 AND r > b AS dull FROM px JOIN hv USING (vec_id, "row", col)),
d AS (SELECT *, dull OR (v > 0.60 AND s < 0.20) AS spot, coalesce(lead(y) OVER (PARTITION BY vec_id, "row" ORDER BY col), y) - y AS dx, coalesce(lead(y) OVER (PARTITION BY vec_id, col ORDER BY "row"), y) - y AS dy FROM x),
a AS (SELECT vec_id, count(*) FILTER (spot) AS n, round(count(*) FILTER (spot) / 64, 5) AS coverage, round(avg(v) FILTER (spot), 5) AS lum, round(avg(sqrt(dx * dx + dy * dy)) FILTER (spot), 5) AS rough, round(count(*) FILTER (dull) / count(*) FILTER (spot), 5) AS brown FROM d GROUP BY 1)
SELECT vec_id, CASE WHEN n >= 4 THEN coverage END AS coverage, CASE WHEN n >= 4 THEN lum END AS lum, CASE WHEN n >= 4 THEN rough END AS rough, CASE WHEN n >= 4 THEN brown END AS brown FROM a""")
def img20_signatures(spark, d):
    return _keyed(image.signatures(colour_images(spark, d), 4).withColumns({c: F.round(c, 5) for c in ("coverage", "lum", "rough", "brown")}))


@query(f"""WITH {_G}, y AS (SELECT o, k, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, k, greatest(0, 1 - abs((k + 0.5 - (o + 0.5) * 1.6) / 1.6)) AS w FROM range(0, 5) a(o), range(0, 8) b(k))),
x AS (SELECT o, k, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, k, greatest(0, 1 - abs(k + 0.5 - (o + 0.5) * 8 / 11)) AS w FROM range(0, 11) a(o), range(0, 8) b(k)))
SELECT vec_id, y.o::INT AS "row", x.o::INT AS col, round(sum(v * y.w * x.w) + 1e-7, 4) AS v FROM g JOIN y ON g."row" = y.k JOIN x ON g.col = x.k GROUP BY ALL""")
def img02_resized(spark, d):
    """Smaller in one direction (the filter widens) and larger in the other."""
    kernel = lambda a: {"v": pixels.resize(a[:, :, 0].astype(float), 5, 11).ravel().tolist()}
    px = image.pixel_rows(_keyed(image.mapped(_images(spark, d), kernel, "v array<double>")), "vec_id", F.col("v"), 11)
    return px.withColumn("v", F.round(F.col("v") + 1e-7, 4))


@query("""WITH e AS (SELECT vec_id, [CAST(q AS DOUBLE) * (CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 300 END) + (CASE WHEN vec_id % 2 = 0 THEN 0.5 ELSE 100 END) FOR q IN embedding] AS x FROM embeddings)
SELECT vec_id, list_sum([CASE WHEN list_min(x) >= 0 AND list_max(x) <= 1 THEN round_even(z * 255, 0) ELSE least(255, greatest(0, round_even(z, 0))) END FOR z IN x])::BIGINT AS total FROM e""")
def img01_bytes(spark, d):
    """Floats within [0, 1] are scaled, others clipped; one rule an image."""
    @F.pandas_udf("bigint")
    def total(ids: pd.Series, x: pd.Series) -> pd.Series:
        unit = lambda i, v: np.asarray(v, np.float64) * (1 if i % 2 == 0 else 300) + (0.5 if i % 2 == 0 else 100)
        return pd.Series([int(pixels.to_uint8(unit(i, v)).astype(int).sum()) for i, v in zip(ids, x)], dtype="int64")

    return table(spark, d, "embeddings").select("vec_id", total("vec_id", "embedding").alias("total"))


def _channel_score(views):
    """Softmax of the mean brightness of the upper half, the lower half and the whole."""
    z = np.array([[v[: len(v) // 2].mean(), v[len(v) // 2 :].mean(), v.mean()] for v in views]) / 64
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@query()
def img21_scored_views(spark, d):
    out = image.scored_views(_images(spark, d), _channel_score, ["a", "b", "c"], 8, 32)
    return _keyed(out.select("path", F.round("uncertainty", 6).alias("uncertainty"), F.round(F.element_at("scores", 1)["p"], 6).alias("p_first")))
