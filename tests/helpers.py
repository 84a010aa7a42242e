"""Small rasters as DataFrames."""

import numpy as np
import pandas as pd

BANDS = ("blue", "green", "red", "nir", "swir2")


def raster(spark, bands: dict, scene="s", valid=None):
    """2-D arrays by band name to a pixels table."""
    h, w = next(iter(bands.values())).shape
    r, c = np.indices((h, w))
    frame = {"scene_id": scene, "r": r.ravel().astype("int32"), "c": c.ravel().astype("int32")}
    frame |= {k: np.asarray(v, dtype=float).ravel() for k, v in bands.items()}
    frame["valid"] = np.ones(h * w, bool) if valid is None else valid.ravel()
    return spark.createDataFrame(pd.DataFrame(frame))


def scene_row(spark, h, w, scene="s", box=None, key="scene_id"):
    west, south, east, north = box or (None,) * 4
    return spark.createDataFrame([(scene, w, h, west, south, east, north)],
                                 f"{key} string, width int, height int, west double, south double, east double, north double")


def half_water(n=64):
    water, veg = (0.28, 0.30, 0.12, 0.05, 0.02), (0.06, 0.14, 0.07, 0.55, 0.20)
    top = (np.arange(n) < n // 2)[:, None] & np.ones((n, n), bool)
    return {b: np.where(top, water[i], veg[i]) for i, b in enumerate(BANDS)}


def grid(df, value, shape):
    out = np.full(shape, np.nan)
    for row in df.select("r", "c", value).collect():
        out[row.r, row.c] = row[value]
    return out
