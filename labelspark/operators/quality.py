"""Image statistics and quality classes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.functions import geometry as G

_STATS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("laplacian_variance", "mean", "std")])


def laplacian_variance(image: np.ndarray) -> float:
    """Population variance of the 4-neighbour Laplacian, mirrored at the border without its edge."""
    padded = np.pad(image, 1, mode="reflect")
    edges = padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:] - 4 * image
    return float(edges.var())


@F.pandas_udf(_STATS)
def pixel_stats(pixels: pd.Series, width: pd.Series) -> pd.DataFrame:
    """Blur and exposure statistics of gray images given as flat arrays."""
    rows = []
    for flat, columns in zip(pixels, width, strict=True):
        image = np.asarray(flat, dtype=np.float64).reshape(-1, int(columns))
        rows.append((laplacian_variance(image), float(image.mean()), float(image.std())))
    return pd.DataFrame(rows, columns=["laplacian_variance", "mean", "std"])


def classify(images: DataFrame, corners: Column | None = None, area: Column | None = None) -> DataFrame:
    """Adds blur, glare, perspective, resolution and the recommended action."""
    if corners is None:
        perspective = F.lit("none")
    else:
        perspective = G.perspective_class(corners, area)
    classed = images.withColumns(
        {
            "blur": G.blur_class(F.col("laplacian_variance")), "brightness": G.brightness_class(F.col("mean")),
            "glare": G.glare_class(F.col("mean"), F.col("std")), "perspective": perspective,
            "resolution": G.resolution_class(F.col("image_w"), F.col("image_h")),
        }
    )
    return classed.withColumn(
        "recommended_action",
        G.recommended_action(F.col("blur"), F.col("resolution"), F.col("perspective"), F.col("brightness")),
    )
