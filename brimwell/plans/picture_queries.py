"""Registered queries of the colouring, tile, filter and decoder operators, with the SQL that says the same.

Embeddings stand in for frames of 8 x 8 pixels and, by label, for trials; parts for regions; labels with the lengths of their documents for scores.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coloring, decoders, files, images, tiles
from .queries import table
from .recording_queries import PIXEL, _P, _frames

MAP = [(0.0, 0.0, 0.5), (0.2, 0.9, 0.4), (1.0, 1.0, 0.0)]


def _colors(frames):
    p = frames.select("frame", F.posexplode("pixels").alias("i", "c"))
    return p.select("frame", F.col("i").cast("long").alias("i"), *[F.col(f"c.{c}").cast("long").alias(c) for c in coloring.CHANNELS])


def _rois(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("roi"), (F.col("p_partkey") % 8).alias("y0"), (F.col("p_size") % 8).cast("long").alias("x0"), (F.col("p_size") / 25.0).alias("radius"), (F.col("p_partkey") % 2).cast("int").alias("is_cell"))


def _mask(spark, sf_dir, size):
    return coloring.mask(coloring.disk_pixels(_rois(spark, sf_dir).where(F.col("radius") == size / 25.0), 8, 8), 8, 8)


def median_filtered(spark, sf_dir):
    d = images.median_filtered(_frames(spark, sf_dir), 8, chunk=100).select("frame", F.posexplode("pixels").alias("i", "v"))
    return d.select("frame", F.col("i").cast("long").alias("i"), F.col("v").cast("long").alias("v"))


def grouped_max(spark, sf_dir):
    return images.grouped(_frames(spark, sf_dir), 8, (3, 3, 2), "max")


def grouped_median(spark, sf_dir):
    return images.grouped(_frames(spark, sf_dir), 8, (3, 3, 2), "median")


def reduced_blocks(spark, sf_dir):
    """A user's function: the range of a block."""
    return images.reduced(_frames(spark, sf_dir), 8, (3, 3, 2), lambda blocks, axis: blocks.max(axis) - blocks.min(axis))


def cell_diameters(spark, sf_dir):
    return images.cell_diameters(_rois(spark, sf_dir).withColumn("radius", F.col("radius") * 5)).select("roi", F.round("diameter", 6).alias("diameter"), F.col("is_cell").cast("long").alias("is_cell"))


def grey_frames(spark, sf_dir):
    return _colors(coloring.grey_to_rgb(_frames(spark, sf_dir)))


def white_background(spark, sf_dir):
    return _colors(coloring.background(_frames(spark, sf_dir), "white"))


def colorized_frames(spark, sf_dir):
    return _colors(coloring.colorized(_frames(spark, sf_dir), coloring.color_map(MAP, 16)))


def disk_pixels(spark, sf_dir):
    return coloring.disk_pixels(_rois(spark, sf_dir), 8, 8)


def colored_regions(spark, sf_dir):
    return _colors(coloring.only_regions(coloring.grey_to_rgb(_frames(spark, sf_dir)), _mask(spark, sf_dir, 30)))


def blended_frames(spark, sf_dir):
    f = _frames(spark, sf_dir)
    return _colors(coloring.blended(coloring.grey_to_rgb(f), coloring.background(f, "white"), 0.3))


def merged_frames_in_order(spark, sf_dir):
    f = _frames(spark, sf_dir)
    white, black = coloring.background(f, "white"), coloring.background(f, "black")
    return _colors(coloring.merged(coloring.grey_to_rgb(f), [(white, _mask(spark, sf_dir, 30)), (black, _mask(spark, sf_dir, 7))]))


def tile_grid(spark, sf_dir):
    shapes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stack"), (F.col("p_size") + 10).alias("frames"), (F.col("p_size") * 3).alias("height"), (F.col("p_partkey") % 40 + 1).alias("width"))
    return tiles.tile_grid(shapes, (16, 20, 20), (8, 12, 12))


def stitched_tiles(spark, sf_dir):
    """Tiles of 150 frames; each tile's outcome is its pixels times one more than its number."""
    f = _frames(spark, sf_dir)
    shape = f.agg(F.count("*").alias("frames")).select("frames", F.lit(8).alias("height"), F.lit(8).alias("width"))
    parts = tiles.tile_parts(f, tiles.tile_grid(shape, (150, 8, 8), (90, 8, 8)), 8)
    out = tiles.stitched(tiles.tile_outcomes(parts, lambda tile, number: tile * (number + 1)), shape)
    p = out.select("frame", F.posexplode("pixels").alias("i", "value"))
    return p.select("frame", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("long").alias("x"), "value")


def training_pairs(spark, sf_dir):
    return tiles.training_pairs(_frames(spark, sf_dir)).select("pair", F.col("input")[0].cast("long").alias("input"), F.col("target")[0].cast("long").alias("target"), "place")


def _tensor(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("trial"), (F.col("vec_id") % 20).alias("frame"), F.col("embedding")[0].cast("double").alias("value"))


def tensor_to_matrix(spark, sf_dir):
    return decoders.to_matrix(_tensor(spark, sf_dir), 20)


def matrix_to_tensor(spark, sf_dir):
    return decoders.to_tensor(decoders.to_matrix(_tensor(spark, sf_dir), 20), 25)


def _features(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("session"), F.col("c_custkey").alias("trial"), (F.col("c_custkey") % 3).alias("stimulus"))
    at = {"trial_start": 0.0, "cs_start": 1.0, "cs_end": 4.0, "ucs_start": 6.0, "ucs_end": 7.0, "trial_end": 12.0}
    return decoders.trial_features(c.withColumns({k: F.lit(v) for k, v in at.items()}), 24, ("session",))


def trial_features(spark, sf_dir):
    return _features(spark, sf_dir).select("session", "trial", "feature", "frame", F.col("value").cast("long").alias("value"))


def collapsed_features(spark, sf_dir):
    return decoders.collapsed_features(_features(spark, sf_dir), [0, 2, 6], ("session",)).select("session", "trial", "frame", "label")


def random_split(spark, sf_dir):
    return decoders.random_split(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")


def _trials(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trial"), F.col("label").alias("type"))


def grouped_split(spark, sf_dir):
    return decoders.grouped_split(_trials(spark, sf_dir))


def interleaved_trials(spark, sf_dir):
    return decoders.interleaved(_trials(spark, sf_dir))


def shuffled_frames(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").alias("neuron"))
    return decoders.shuffled_frames(d.withColumn("old", F.col("frame")), by=("neuron",))


def _scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select((F.col("doc_id") % 3).alias("split"), F.col("quality").alias("label"), "score")


def score_curves(spark, sf_dir):
    d = decoders.curves(_scores(spark, sf_dir), "label", "score", "split")
    return d.select("split", "threshold", "tp", "fp", "fn", *[F.round(c, 8).alias(c) for c in ("tpr", "fpr", "precision", "recall")])


def score_areas(spark, sf_dir):
    d = decoders.areas(_scores(spark, sf_dir), "label", "score", "split")
    return d.select("split", F.round("roc_auc", 8).alias("roc_auc"), F.round("average_precision", 8).alias("average_precision"))


def split_regression_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice", (F.col("l_quantity") * 1500).alias("p"))
    m = decoders.split_regression_metrics(d, "l_returnflag", "l_linestatus", "l_extendedprice", "p")
    return m.select("l_returnflag", F.round("r2", 8).alias("r2"), F.round("mae", 4).alias("mae"), F.round(F.col("mse") / 1e6, 4).alias("mse"))


def split_class_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select((F.col("doc_id") % 3).alias("split"), "quality", "toxic")
    m = decoders.split_class_metrics(d, "split", "quality", "toxic")
    return m.select("split", *[F.round(c, 8).alias(c) for c in ("accuracy", "balanced_accuracy", "precision", "recall", "f1")])


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.regexp_extract("url", "//([^/]+)/", 1).alias("folder"), "url")


def found_files(spark, sf_dir):
    return files.found(_paths(spark, sf_dir), "url", ending="#top").select("url")


def naturally_sorted(spark, sf_dir):
    return files.naturally_sorted(_paths(spark, sf_dir).distinct(), "folder", "url").select("folder", "url", "place", "is_first")


def newest_files(spark, sf_dir):
    return files.newest(_paths(spark, sf_dir), "folder", "url")


def folder_stages(spark, sf_dir):
    return files.stages(_paths(spark, sf_dir), "folder", "url", [("tops", r"#top$", 3), ("queries", r"\?page=", 2), ("any", ".", 1)])


def recording_catalogue(spark, sf_dir):
    """Names of single frames from parts: a session for each size, two channels, planes and frames by number."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("session"), F.explode(F.array(F.lit(1), F.lit(2))).alias("c"), (F.floor(F.col("p_partkey") / 20) % 3 + 1).alias("plane"), (F.floor(F.col("p_partkey") / 60) + 1).alias("n"))
    pad = lambda c, k: F.lpad(F.col(c).cast("string"), k, "0")
    name = F.concat(F.lit("rec_Cycle"), pad("n", 5), F.lit("_Ch"), F.col("c").cast("string"), F.lit("_"), pad("plane", 6), F.lit(".ome.tif"))
    return files.catalogue(p.select("session", name.alias("path")), "path", ("session",))


def decoded_names(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select("s_suppkey", F.transform(F.split("s_name", ""), lambda c: F.ascii(c)).alias("codes"))
    return d.select("s_suppkey", files.decoded("codes").alias("name"))


QUERIES = {f.__name__: f for f in (median_filtered, grouped_max, grouped_median, reduced_blocks, cell_diameters, grey_frames, white_background, colorized_frames, disk_pixels, colored_regions, blended_frames, merged_frames_in_order, tile_grid, stitched_tiles, training_pairs, tensor_to_matrix, matrix_to_tensor, trial_features, collapsed_features, random_split, grouped_split, interleaved_trials, shuffled_frames, score_curves, score_areas, split_regression_metrics, split_class_metrics, found_files, naturally_sorted, newest_files, folder_stages, recording_catalogue, decoded_names)}

_GREY = f"WITH {_P}, g AS (SELECT frame, i, CAST(floor((v - (SELECT min(v) FROM p)) / CAST((SELECT max(v) - min(v) FROM p) AS DOUBLE) * 255) AS BIGINT) AS c FROM p)"
_DISKS = """d AS (SELECT DISTINCT p_partkey AS roi, p_size AS size, CAST(greatest(0, least(7, p_partkey % 8 + dy)) AS BIGINT) AS y, CAST(greatest(0, least(7, p_size % 8 + dx)) AS BIGINT) AS x
 FROM part, range(-2, 3) a(dy), range(-2, 3) b(dx) WHERE dy * dy + dx * dx <= (p_size / 25.0::DOUBLE) * (p_size / 25.0::DOUBLE))"""
_BLOCK = "frame // 3 AS frame, i // 8 // 3 AS y, i % 8 // 2 AS x"
_MAPPED = coloring.color_map(MAP, 16)
_INT = lambda c: "[" + ", ".join(str(int(x[c] * 255)) for x in _MAPPED) + "]"
_RANKED = "r AS (SELECT vec_id AS trial, label AS type, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || vec_id), vec_id) AS rank FROM embeddings), n AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM embeddings GROUP BY label))"
_FEATURES = """t AS (SELECT c_nationkey AS session, c_custkey AS trial, c_custkey % 3 AS s, f AS frame, f * 12.0::DOUBLE / 24 AS t FROM customer, range(24) r(f)),
x AS (SELECT c_nationkey AS session, count(*) FILTER (c_custkey % 3 = 0) > 0 AS plus FROM customer GROUP BY 1),
f AS (SELECT session, trial, frame, unnest(range(7)) AS feature, unnest([s = 0 AND t <= 3, s <> 0 AND t <= 3, s = 0 AND t > 3 AND t <= 5, s <> 0 AND plus AND t > 3 AND t <= 5, s = 0, s <> 0, s = 0 AND t > 5 AND t <= 6]) AS v FROM t JOIN x USING (session))"""
_SCORES = "s AS (SELECT doc_id % 3 AS split, quality AS label, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id))"
_CURVES = f"""{_SCORES}, g AS (SELECT split, score AS threshold, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY 1, 2),
c AS (SELECT split, threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, CAST(sum(p) OVER (PARTITION BY split) AS BIGINT) AS ps, CAST(sum(n) OVER (PARTITION BY split) AS BIGINT) AS ns FROM g WINDOW w AS (PARTITION BY split ORDER BY threshold DESC)),
q AS (SELECT split, threshold, tp, fp, ps - tp AS fn, tp / ps AS tpr, fp / ns AS fpr, tp / (tp + fp) AS "precision", tp / ps AS recall FROM c)"""
_PATHS = "WITH f AS (SELECT regexp_extract(url, '//([^/]+)/', 1) AS folder, url FROM pages)"


def _tiles(n, size, gap, first):
    """SQL for [a0, a1) and the owned part of the tiles of one axis."""
    last, begin = "k = many - 1", f"CASE WHEN k = many - 1 THEN greatest(0, n - {size}) ELSE k * {gap} END"
    end, cut = f"CASE WHEN {last} THEN n ELSE k * {gap} + {size} END", (size - gap) // 2
    return f"(SELECT stack, many, k, {begin} AS a0, {end} AS a1, CASE WHEN k = 0 THEN 0 ELSE {begin} + {cut} END AS o0, CASE WHEN {last} THEN n ELSE k * {gap} + {size} - {cut} END AS o1 FROM (SELECT p_partkey AS stack, {n} AS n, unnest(range(many)) AS k, many FROM (SELECT *, greatest(1, CAST(ceil(({n} - {size} + {gap}) / {gap}) AS BIGINT)) AS many FROM part))) {first}"


_AXIS = lambda a: f"CAST({a}.a0 AS BIGINT) AS {a}0, CAST({a}.a1 AS BIGINT) AS {a}1, CAST({a}.o0 AS BIGINT) AS own_{a}0, CAST({a}.o1 AS BIGINT) AS own_{a}1"
ORACLE_SQL = {
    "median_filtered": f"""WITH {_P}, n AS (SELECT max(frame) AS last FROM p) SELECT a.frame, a.i, CAST(median(b.v) AS BIGINT) AS v FROM p a, n, range(-1, 2) z(dz), range(-1, 2) r(dy), range(-1, 2) c(dx)
JOIN p b ON b.frame = greatest(0, least(last, a.frame + dz)) AND b.i = greatest(0, least(7, a.i // 8 + dy)) * 8 + greatest(0, least(7, a.i % 8 + dx)) GROUP BY 1, 2""",
    "grouped_max": f"WITH {_P} SELECT {_BLOCK}, CASE WHEN count(*) < 18 THEN greatest(max(v), 0) ELSE max(v) END AS value FROM p GROUP BY ALL",
    "grouped_median": f"WITH {_P} SELECT {_BLOCK}, CAST(trunc(list_median(list_concat(list(v), list_transform(range(18 - count(*)), lambda k: 0::BIGINT)))) AS BIGINT) AS value FROM p GROUP BY ALL",
    "reduced_blocks": f"WITH {_P} SELECT {_BLOCK}, CASE WHEN count(*) < 18 THEN greatest(max(v), 0) - least(min(v), 0) ELSE max(v) - min(v) END AS value FROM p GROUP BY ALL",
    "cell_diameters": "SELECT p_partkey AS roi, round(2 * p_size / 25.0::DOUBLE * 5, 6) AS diameter, CAST(CASE WHEN 2 * (p_size / 25.0::DOUBLE * 5) < 10 THEN 0 ELSE p_partkey % 2 END AS BIGINT) AS is_cell FROM part",
    "grey_frames": f"{_GREY} SELECT frame, i, c AS r, c AS g, c AS b FROM g",
    "white_background": f"WITH {_P} SELECT frame, i, 255::BIGINT AS r, 255::BIGINT AS g, 255::BIGINT AS b FROM p",
    "colorized_frames": f"WITH {_P}, k AS (SELECT frame, i, CAST(least(15, floor((v - (SELECT min(v) FROM p)) / CAST((SELECT max(v) - min(v) FROM p) AS DOUBLE) * 16)) AS INT) + 1 AS k FROM p) SELECT frame, i, CAST({_INT(0)}[k] AS BIGINT) AS r, CAST({_INT(1)}[k] AS BIGINT) AS g, CAST({_INT(2)}[k] AS BIGINT) AS b FROM k",
    "disk_pixels": f"WITH {_DISKS} SELECT roi, y, x FROM d",
    "colored_regions": f"{_GREY}, {_DISKS} SELECT frame, i, m * c AS r, m * c AS g, m * c AS b FROM (SELECT *, CASE WHEN i IN (SELECT y * 8 + x FROM d WHERE size = 30) THEN 1 ELSE 0 END AS m FROM g)",
    "blended_frames": f"{_GREY}, o AS (SELECT frame, i, CAST(round_even((1 - 0.3::DOUBLE) * c + 0.3::DOUBLE * 255, 0) AS BIGINT) AS o FROM g) SELECT frame, i, o AS r, o AS g, o AS b FROM o",
    "merged_frames_in_order": f"{_GREY}, {_DISKS}, o AS (SELECT frame, i, CASE WHEN i IN (SELECT y * 8 + x FROM d WHERE size = 7) THEN 0 WHEN i IN (SELECT y * 8 + x FROM d WHERE size = 30) THEN 255 ELSE c END AS o FROM g) SELECT frame, i, o AS r, o AS g, o AS b FROM o",
    "tile_grid": f"""SELECT s.stack, CAST((y.k * x.many + x.k) * s.many + s.k AS BIGINT) AS tile, {_AXIS("s")}, {_AXIS("y")}, {_AXIS("x")}
FROM {_tiles("p_size + 10", 16, 8, "s")} JOIN {_tiles("p_size * 3", 20, 12, "y")} ON s.stack = y.stack JOIN {_tiles("p_partkey % 40 + 1", 20, 12, "x")} ON s.stack = x.stack""",
    "stitched_tiles": f"""WITH {_P}, n AS (SELECT count(*) AS n, CAST(ceil((count(*) - 60) / 90) AS BIGINT) AS many FROM embeddings), t AS (SELECT k, CASE WHEN k = 0 THEN 0 WHEN k = many - 1 THEN n - 150 + 30 ELSE k * 90 + 30 END AS a, CASE WHEN k = many - 1 THEN n ELSE k * 90 + 120 END AS b FROM n, range(1000) r(k) WHERE k < many),
o AS (SELECT frame, i, arg_max(v * (k + 1) * sqrt(1.0::DOUBLE / (k + 1)), k) AS v FROM p JOIN t ON frame >= a AND frame < b GROUP BY 1, 2)
SELECT frame, i // 8 AS y, i % 8 AS x, CAST(floor((v - (SELECT min(v) FROM o)) / (SELECT max(v) - min(v) FROM o) * 65535) AS BIGINT) AS value FROM o""",
    "training_pairs": f"WITH {_P} SELECT a.frame // 2 AS pair, a.v AS input, b.v AS target, md5('0:' || (a.frame // 2)) AS place FROM p a JOIN p b ON b.frame = a.frame + 1 WHERE a.i = 0 AND b.i = 0 AND a.frame % 2 = 0",
    "tensor_to_matrix": "SELECT vec_id AS frame, CAST(embedding[1] AS DOUBLE) AS value FROM embeddings",
    "matrix_to_tensor": "SELECT vec_id // 25 AS trial, vec_id % 25 AS frame, CAST(embedding[1] AS DOUBLE) AS value FROM embeddings",
    "trial_features": f"WITH {_FEATURES} SELECT session, trial, CAST(feature AS INT) AS feature, frame, CAST(v AS BIGINT) AS value FROM f",
    "collapsed_features": f"WITH {_FEATURES} SELECT session, trial, frame, CAST(sum(CASE feature WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 3 END * v::INT) AS BIGINT) AS label FROM f WHERE feature IN (0, 2, 6) GROUP BY 1, 2, 3",
    "random_split": "SELECT vec_id, CASE WHEN CAST('0x' || substring(md5('0:' || vec_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.8 THEN 'train' ELSE 'test' END AS split FROM embeddings",
    "grouped_split": f"WITH {_RANKED} SELECT trial, type, rank - 1 AS \"group\", CASE WHEN rank <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r, n WHERE rank <= n",
    "interleaved_trials": f"WITH {_RANKED} SELECT trial, type, row_number() OVER (ORDER BY rank, type) - 1 AS place FROM r, n WHERE rank <= n",
    "shuffled_frames": "WITH e AS (SELECT vec_id AS frame, label AS neuron, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS a, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || label || ':' || vec_id), vec_id) AS b FROM embeddings) SELECT y.frame AS frame, x.neuron AS neuron, x.frame AS old FROM e x JOIN e y ON x.neuron = y.neuron AND x.a = y.b",
    "score_curves": f'WITH {_CURVES} SELECT split, threshold, tp, fp, fn, round(tpr, 8) AS tpr, round(fpr, 8) AS fpr, round("precision", 8) AS "precision", round(recall, 8) AS recall FROM q',
    "score_areas": f"""WITH {_CURVES}, z AS (SELECT split, (fpr - coalesce(lag(fpr) OVER w, 0)) * (tpr + coalesce(lag(tpr) OVER w, 0)) / 2 AS a, (recall - coalesce(lag(recall) OVER w, 0)) * "precision" AS b FROM q WINDOW w AS (PARTITION BY split ORDER BY threshold DESC))
SELECT split, round(sum(a), 8) AS roc_auc, round(sum(b), 8) AS average_precision FROM z GROUP BY 1""",
    "split_regression_metrics": "SELECT l_returnflag, round(avg(1 - mse / v), 8) AS r2, round(avg(mae), 4) AS mae, round(avg(mse) / 1e6, 4) AS mse FROM (SELECT l_returnflag, l_linestatus, avg(abs(l_extendedprice - l_quantity * 1500)) AS mae, avg((l_extendedprice - l_quantity * 1500) ** 2) AS mse, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "split_class_metrics": """WITH c AS (SELECT doc_id % 3 AS split, k, count(*) FILTER (quality = k) AS of, count(*) FILTER (toxic = k) AS said, count(*) FILTER (quality = k AND toxic = k) AS tp FROM labels, (SELECT DISTINCT quality AS k FROM labels) GROUP BY 1, 2)
SELECT split, round(sum(tp) / sum(of), 8) AS accuracy, round(avg(tp / of), 8) AS balanced_accuracy, round(avg(CASE WHEN said > 0 THEN tp / said ELSE 0 END), 8) AS "precision", round(avg(tp / of), 8) AS recall, round(avg(2 * tp / (of + said)), 8) AS f1 FROM c WHERE of > 0 GROUP BY 1""",
    "found_files": "SELECT url FROM pages WHERE url LIKE '%#top'",
    "naturally_sorted": f"""{_PATHS}, k AS (SELECT DISTINCT folder, url, list_transform(regexp_extract_all(url, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN lpad(x, 20, '0') ELSE x END) AS key FROM f)
SELECT folder, url, row_number() OVER w - 1 AS place, row_number() OVER w = 1 AS is_first FROM k WINDOW w AS (PARTITION BY folder ORDER BY key, url)""",
    "newest_files": f"{_PATHS} SELECT folder, max(url) AS url FROM f GROUP BY 1",
    "folder_stages": f"{_PATHS} SELECT folder, CASE WHEN count(*) FILTER (url LIKE '%#top') >= 3 THEN 'tops' WHEN count(*) FILTER (url LIKE '%?page=%') >= 2 THEN 'queries' ELSE 'any' END AS stage FROM f GROUP BY 1",
    "recording_catalogue": """WITH q AS (SELECT p_partkey % 20 AS session, (p_partkey // 20) % 3 + 1 AS plane, p_partkey // 60 + 1 AS n FROM part),
c AS (SELECT session, 2 * count(*) FILTER (n = 1) AS cycle, 2 * count(*) FILTER (plane = 1) AS ome FROM q GROUP BY 1)
SELECT session, 2::BIGINT AS channels, CASE WHEN cycle > 1 THEN cycle // 2 ELSE 1 END AS planes, CASE WHEN cycle > 1 THEN ome // 2 ELSE cycle // 2 END AS frames FROM c""",
    "decoded_names": "SELECT s_suppkey, s_name AS name FROM supplier",
}
