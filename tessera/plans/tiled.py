"""Queries of whole volumes cut into tiles, of averages under all poses, and of subsets bred over the records. Loops that SQL cannot say: tests hold them
against untiled and plain versions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import rotation as K
from ..operators import breeding, cells, flooding, levelset, likelihood
from ..operators import voxel as V
from .base import register, table
from .catalog import SHAPE, tomogram
from .iterate import settle

QUERIES, SQL, _query = register()
#: The 24 turns of a cube onto itself.
TURNS = K.angle_grid(np.pi / 2)


@_query()
def tiled_watershed(spark, d):
    """Labels of a smoothed tomogram's voxels, flooded tile by tile from its high local maxima."""
    smooth = settle(V.smooth(tomogram(spark, d), SHAPE, 1.0, rounded=6))
    peaks = V.above_threshold(V.extrema(smooth, SHAPE), 3.0)
    seeds = peaks.select("vol_id", "x", "y", "z", (1 + F.col("z") + SHAPE[2] * (F.col("y") + SHAPE[1] * F.col("x"))).cast("long").alias("seed"))
    found = flooding.watershed(smooth.join(seeds, ["vol_id", "x", "y", "z"], "left"), SHAPE, tile=16)
    return found.drop("vol_id")


@_query()
def tiled_level_set(spark, d):
    """The level set of a smoothed tomogram, cube by cube."""
    smooth = settle(V.smooth(tomogram(spark, d), SHAPE, 1.0, rounded=6))
    found = levelset.level_set(smooth, SHAPE, tile=16)
    return found.select("x", "y", "z", (F.round("phi", 5) + 0.0).alias("phi"))


@_query()
def tiled_segments(spark, d):
    """Bright components of a tomogram's level set of at least eight voxels, with their sizes and greatest depths."""
    smooth = settle(V.smooth(tomogram(spark, d), SHAPE, 1.0, rounded=6))
    parts = levelset.segments(smooth, SHAPE, tile=16, least=8)
    return parts.groupBy("region").agg(F.count("*").alias("voxels"), F.round(F.max("phi"), 5).alias("depth"))


def _cubes(spark, d):
    """Records of 4 voxels a side, under masks that leave out the highest frequency of one axis for every other record."""
    e = table(spark, d, "embeddings")
    wedge = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.when((p % 4 == 0) & (F.col("vec_id") % 2 == 1), 0.0).otherwise(1.0))
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), wedge.alias("m"))


@_query()
def likelihood_averages(spark, d):
    """Classes by maximum likelihood over half turns and all translations: shares, voxels, the fit's rounds and its scales."""
    model, history, _ = likelihood.averages(_cubes(spark, d), "vec_id", (4, 4, 4), TURNS[:4], 4, rounds=4)
    rows = [(k, len(history), round(float(s), 5), round(float(model.sigma2), 5), round(float(model.xi), 4), [round(float(x), 4) for x in a.ravel()]) for k, (s, a) in enumerate(zip(model.alpha, model.a))]
    return spark.createDataFrame(rows, "k int, rounds int, alpha double, sigma2 double, xi double, v array<double>").select("k", "rounds", "alpha", "sigma2", "xi", F.posexplode("v").alias("pos", "val"))


@_query()
def likelihood_poses(spark, d):
    """Each record's likeliest class and pose after two rounds of maximum likelihood, and its share of the likelihood."""
    _, _, found = likelihood.averages(_cubes(spark, d), "vec_id", (4, 4, 4), TURNS[:4], 3, rounds=2)
    at = [F.round(F.col(c)[i], 5).alias(f"{c}{i}") for c in ("angle", "loc") for i in range(3)]
    return found.select("vec_id", "k", *at, F.round("share", 4).alias("share"))


@_query()
def bred_selection(spark, d):
    """Each class's best subset of all of its records after four generations, and its score."""
    return breeding.evolve(table(spark, d, "embeddings"), "label", "vec_id", "embedding", (4, 4, 4), population=12, generations=4)


@_query()
def voronoi_exact(spark, d):
    """The exact share of the box of 97 x 89 x 83 that is nearest to each supplier's point."""
    s = table(spark, d, "supplier")
    at = s.select("s_suppkey", *((F.col("s_suppkey") * a % m).cast("double").alias(c) for c, a, m in (("x", 37, 97), ("y", 101, 89), ("z", 53, 83))))
    found = cells.voronoi_cells(at, "s_suppkey", ["x", "y", "z"], [0.0, 0.0, 0.0], [97.0, 89.0, 83.0])
    return found.withColumn("weight", F.round("weight", 8))
