"""Hooks for user functions over frames and files."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pixelweave.schemas import frame_keys


def map_frames(df: DataFrame, func: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a 2-D array function to every frame of every plane.

    A frame is one group, so scale is across frames; func returns an array of
    the same shape.
    """
    keys = frame_keys(df)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf.h.iloc[0]), int(pdf.w.iloc[0])
        image = np.zeros((h, w))
        image[pdf.y.to_numpy(), pdf.x.to_numpy()] = pdf.value.to_numpy()
        result = np.asarray(func(image), dtype=float)
        out = pdf.copy()
        out["value"] = result[pdf.y.to_numpy(), pdf.x.to_numpy()]
        return out

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def run_steps(df: DataFrame, steps: list[tuple[Callable[..., DataFrame], dict]]) -> DataFrame:
    """Chain (operator, keyword arguments) steps into one plan over all files."""
    return reduce(lambda d, s: d.transform(s[0], **s[1]), steps, df)


def process_files(df: DataFrame, func: Callable[[str, bytes], object]) -> DataFrame:
    """Run func(path, content) per row of a binaryFile frame; a failure becomes a status row."""
    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content):
                try:
                    rows.append((path, "ok", str(func(path, content)), ""))
                except Exception as e:  # the status column carries it on
                    rows.append((path, "error", "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "status", "result", "error"])

    return df.select("path", "content").mapInPandas(run, "path string, status string, result string, error string")
