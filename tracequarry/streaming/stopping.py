"""Stopping rules over tokens that arrive as a stream: the tail of each generation is a ring of its latest tokens in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.answers import BOXED
from ..operators.stopping import Rule


def box_is_closed(tail: str) -> bool:
    """Whether the last box of a tail is balanced."""
    _, mark, rest = tail.rpartition(BOXED)
    depth = 1 if mark else 0
    for letter in rest if mark else "":
        depth += (letter == "{") - (letter == "}")
        if not depth:
            return True
    return False


def shown(tail: str, rule: Rule, arm: str | None = None) -> str | None:
    """The closure that a tail shows, in the order of ``operators.stopping.closure``."""
    for closer in rule.closers:
        if closer in tail:
            return closer
    if rule.balanced and box_is_closed(tail):
        return "boxed"
    return next((c for c in reversed(rule.by_arm.get(arm, ())) if c in tail), None)


def stop_stream(tokens: DataFrame, key: list[str], rule: Rule, *, arm_col: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """(key, pos, reason) as soon as a generation stops, from a stream of (key, pos, token); ``arm_col`` must be part of the key.

    Tokens of a key arrive in order over micro-batches and are put in order within one.  A key's state is a list of the latest tokens with a schema of its own.
    With ``ttl_ms`` it is dropped so long after its last change, so generations that end without a closure do not stay; Spark then runs batches
    for the timeouts alone, and a trigger that ends with the data never ends.
    """
    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*key, "pos"]) + ", reason string"
    arm_at = key.index(arm_col) if arm_col else None

    def advance(of: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ring, number, stopped = state.get if state.exists else ([], 0, False)
        if stopped:
            return
        tail, reason = list(ring), None
        batch = pd.concat(list(rows)).sort_values("pos", kind="stable")
        for pos, token in zip(batch["pos"], batch["token"]):
            number += 1
            tail = [*tail, token if isinstance(token, str) else ""][-rule.window :]
            reason = shown("".join(tail), rule, of[arm_at] if arm_col else None) if number >= rule.least else None
            if reason is not None:
                yield pd.DataFrame({**{k: [v] for k, v in zip(key, of)}, "pos": [pos], "reason": [reason]})
                break
        state.update(([] if reason else tail, number, reason is not None))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return tokens.groupBy(*key).applyInPandasWithState(advance, schema, "ring array<string>, number long, stopped boolean", "append", timeout)
