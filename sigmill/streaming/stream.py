"""Structured Streaming: tumbling matrices, fold-in of new rows, peak detection with state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import missing as m
from ..operators.factorize import fold_in


def tumbling_matrix(events: DataFrame, ts: str, name: str, value: str, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, name, total, n) by time window; the same plan for batch and stream. late: the watermark of a stream."""
    rows = events.select(F.col(ts).cast("timestamp").alias("_ts"), F.col(name).alias("name"), m.value(value).alias("_v"))
    rows = rows.withWatermark("_ts", late) if late else rows
    return rows.groupBy(F.window("_ts", width).alias("_w"), "name").agg(F.sum("_v").alias("total"), F.count("_v").alias("n")).select(F.col("_w.start").alias("start"), "name", "total", "n")


def weights_of_new_rows(stream: DataFrame, h: np.ndarray) -> DataFrame:
    """(id, w) of rows (id, x) as they come, for a fixed H; stateless, so it runs on any trigger."""
    return fold_in(stream, h)


def write_fold_in(stream: DataFrame, h: np.ndarray, path: str, checkpoint: str):
    """Start writing new rows' weights as Parquet, one batch once."""
    return weights_of_new_rows(stream, h).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streaming_peaks(stream: DataFrame, key: str, order: str, value: str, lag: int = 30, threshold: float = 5.0, influence: float = 0.0) -> DataFrame:
    """(key, order, value, signal): the state of a series is its last lag filtered values."""
    kinds = dict(stream.dtypes)

    def step(keys, frames, state):
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for o, v in zip(rows[order], rows[value].fillna(0.0)):
            s = 0
            if len(held) >= lag:
                mean, dev = float(np.mean(held)), float(np.std(held, ddof=1)) if lag > 1 else 0.0
                if abs(v - mean) > threshold * dev:
                    s = 1 if v > mean else -1
            held = (held + [influence * v + (1 - influence) * held[-1] if s else float(v)])[-lag:]
            out.append((keys[0], o, float(v), s))
        state.update((held,))
        yield pd.DataFrame(out, columns=[key, order, value, "signal"])

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} double, signal int"
    return stream.select(key, order, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(step, schema, "held array<double>", "append", "NoTimeout")
