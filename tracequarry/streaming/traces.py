"""Scratchpads whose steps arrive as a stream: each trace keeps its environment and checkpoints as state."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scratchpad import Scratchpad

STEP = "trace_id string, step_index int, raw_text string, step_type string, value string, passed boolean"


def run_steps(steps: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """Rows of executed steps from ``steps(trace_id, step_index, step)``; with a timeout, idle traces are forgotten.

    Steps of one micro-batch are put in order of ``step_index``; a trace's state is written by this engine alone.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pad = pickle.loads(state.get[0]) if state.exists else Scratchpad()
        rows = pd.concat(list(batches)).sort_values("step_index")
        done = []
        for text in rows["step"]:
            if text and text.strip():
                pad, row = pad.advance(text.strip())
                done.append(row)
        state.update((pickle.dumps(pad),))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([{"trace_id": key[0], **{k: r[k] for k in ("step_index", "raw_text", "step_type", "value", "passed")}} for r in done], columns=["trace_id", "step_index", "raw_text", "step_type", "value", "passed"])

    return steps.groupBy("trace_id").applyInPandasWithState(advance, STEP, "pad binary", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)
