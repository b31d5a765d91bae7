"""Chips to patch vectors with a pluggable encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# An encoder takes (batch, channels, px, px) and returns (batch, grid, grid, dims).
Encoder = Callable[..., np.ndarray]


def patch_means(patch: int) -> Callable[[], Encoder]:
    """Default encoder, needing no weights: mean per channel and patch, NaN skipped."""

    def load() -> Encoder:
        def encode(chips: np.ndarray, places: pd.DataFrame | None = None) -> np.ndarray:
            b, c, h, w = chips.shape
            blocks = chips.reshape(b, c, h // patch, patch, w // patch, patch)
            seen = ~np.isnan(blocks)
            total = np.where(seen, blocks, 0).sum(axis=(3, 5), dtype="float64")
            count = seen.sum(axis=(3, 5))
            mean = np.divide(total, count, out=np.full(total.shape, np.nan), where=count > 0)
            return mean.transpose(0, 2, 3, 1)

        return encode

    return load


def standardised(
    load: Callable[[], Encoder], means: list[float], stds: list[float]
) -> Callable[[], Encoder]:
    """The same encoder on channels brought to mean 0 and std 1, padding included."""
    shape = (1, -1, 1, 1)

    def load_scaled() -> Encoder:
        encoder = load()
        mean = np.asarray(means, dtype="float32").reshape(shape)
        std = np.asarray(stds, dtype="float32").reshape(shape)
        return lambda chips, *more: encoder((chips - mean) / std, *more)

    return load_scaled


def encode_chips(
    chips: DataFrame, load: Callable[[], Encoder], channels: int, px: int, batch: int = 8,
    extra: list[str] | None = None, keys: list[str] | None = None,
) -> DataFrame:
    """(keys..., row_off, col_off, grid, patches): `load` runs once per task, chips go in batches.

    `extra` names columns (latitude, longitude, year...) an encoder wants beside the pixels,
    given as a second argument. Rows stream through, so a task holds one batch of chips and
    the encoder.
    """
    extra, names = list(extra or []), [*(keys or []), "row_off", "col_off"]
    given = list(dict.fromkeys([*names, "data", *extra]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                data = np.stack([np.asarray(d, dtype="float32") for d in part["data"]])
                data = data.reshape(len(part), channels, px, px)
                out = encoder(data, part[extra]) if extra else encoder(data)
                grid = out.shape[1]
                yield pd.DataFrame(
                    {
                        **{n: part[n].to_numpy() for n in names},
                        "grid": grid,
                        "patches": [
                            list(v.reshape(grid * grid, -1).astype("float32")) for v in out
                        ],
                    }
                )

    patches = T.ArrayType(T.ArrayType(T.FloatType()))
    schema = T.StructType([chips.schema[n] for n in names]).add("grid", T.IntegerType()).add("patches", patches)
    return chips.select(*given).mapInPandas(run, schema)
