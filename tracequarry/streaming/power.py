"""Energy of runs while their readings arrive: the trapezoid rule with the last reading of each run as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_energy(samples: DataFrame, idle_mw: int = 6750) -> DataFrame:
    """(run_id, n, joules) of each run that a batch touches, as of that batch, from a stream of (run_id, t in microseconds, mw).

    Readings of a batch are put in order of time; one older than the run's last of an earlier batch is an error, as its area would be wrong.  The area is kept as a whole
    number in decimal digits, so nothing is rounded before the end.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last_t, last_p, area = state.get if state.exists else (0, 0, 0, "0")
        twice = int(area)
        rows = pd.concat(list(batches)).sort_values(["t", "mw"], kind="stable")
        for t, mw in zip(rows["t"].tolist(), rows["mw"].tolist()):
            p = max(mw - idle_mw, 0)
            if n:
                if t < last_t:
                    raise ValueError(f"run {key[0]}: a reading at {t} behind one at {last_t}")
                twice += (p + last_p) * (t - last_t)
            n, last_t, last_p = n + 1, t, p
        state.update((n, last_t, last_p, str(twice)))
        yield pd.DataFrame({"run_id": [key[0]], "n": [n], "joules": [twice / 2e9]})

    return samples.groupBy("run_id").applyInPandasWithState(advance, "run_id long, n long, joules double", "n long, last_t long, last_p long, area string", "update", GroupStateTimeout.NoTimeout)
