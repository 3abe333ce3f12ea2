"""Extension points: detectors as table functions, models as vectorised functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_batches

THREAT = "file_id long, type string, severity string, confidence double"


def run_plugin(files: DataFrame, detect: Callable[[str, int], list[dict]], messages: bool = False) -> DataFrame:
    """A plugin (content, file_id) -> threats over (file_id, content) (X3); a file on which it fails gives an error row.

    With ``messages`` there is a column ``message``: the plugin's own, or what went wrong.  Files reach Python in batches of
    bounded bytes, however many rows a partition has.
    """

    columns = ["file_id", "type", "severity", "confidence"] + (["message"] if messages else [])

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for file_id, content in zip(part["file_id"], part["content"], strict=True):
                try:
                    rows += [(file_id, t["type"], t["severity"], float(t.get("confidence", 0.5)), t.get("message")) for t in detect(content or "", file_id)]
                except Exception as error:  # noqa: BLE001  a plugin is foreign code
                    rows.append((file_id, "ANALYSIS_ERROR", "LOW", 0.0, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["file_id", "type", "severity", "confidence", "message"])[columns]

    return small_batches(files).select("file_id", "content").mapInPandas(step, THREAT + (", message string" if messages else ""))


def model_column(model: Callable[[pd.DataFrame], pd.Series], columns: list[str]):
    """A local model's score as a column (X4), clamped to 0..1; what isn't finite counts as 0."""

    @F.pandas_udf("double")
    def score(frame: pd.DataFrame) -> pd.Series:
        out = model(frame).astype(float)
        return out.where(out.abs() < float("inf"), 0.0).fillna(0.0).clip(0.0, 1.0)

    return score(F.struct(*columns))
