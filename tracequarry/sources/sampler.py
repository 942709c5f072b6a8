"""A power sampler as a streaming source: readings are replayed by row number, so many a batch, and a restart goes on where the checkpoint says."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "run_id long, t long, mw long"


class _Replay(SimpleDataSourceStreamReader):
    """Offsets are row numbers of the recorded readings, in the order of the files; a batch takes ``max_rows`` of them at most.

    A sampler is one device read by one process, so rows pass through the driver as they would from the meter; ``max_rows`` bounds them.
    """

    def __init__(self, path: str, max_rows: int):
        self.path, self.max_rows = path, max_rows

    def initialOffset(self) -> dict:
        return {"row": 0}

    def _rows(self, begin: int, end: int) -> list[tuple]:
        import pyarrow.dataset as ds

        found = ds.dataset(self.path, format="parquet")
        out, at = [], 0
        for piece in found.get_fragments():
            for group in piece.split_by_row_group():
                n = group.count_rows()
                if at + n > begin and at < end:
                    table = group.to_table(columns=["user_id", "ts", "value"]).slice(max(0, begin - at), min(n, end - at) - max(0, begin - at))
                    micros = table["ts"].cast("timestamp[us]").cast("int64").to_pylist()
                    out += [(u, t, int(v * 1000 // 1)) for u, t, v in zip(table["user_id"].to_pylist(), micros, table["value"].to_pylist())]
                at += n
                if at >= end:
                    return out
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._rows(start["row"], start["row"] + self.max_rows)
        return iter(rows), {"row": start["row"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start["row"], end["row"]))

    def commit(self, end: dict) -> None:
        pass


class PowerReplay(DataSource):
    """``spark.readStream.format("power_replay").option("path", events).option("maxRowsPerBatch", n)``."""

    @classmethod
    def name(cls) -> str:
        return "power_replay"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> _Replay:
        return _Replay(self.options["path"], int(self.options.get("maxRowsPerBatch", 10_000)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PowerReplay)
