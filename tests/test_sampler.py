"""Readings replayed as a stream: bounded batches, a restart from the checkpoint, energies as in batch."""

from pyspark.sql import functions as F

from tracequarry.operators import energy
from tracequarry.sources import sampler
from tracequarry.sources.fixtures import power_samples
from tracequarry.streaming.power import running_energy

SF = "/root/testdata/sf0.001"


def test_offsets_replay_the_table(spark):
    reader = sampler._Replay(f"{SF}/events.parquet", 300)
    rows, at, batches = [], reader.initialOffset(), 0
    while True:
        found, end = reader.read(at)
        found = list(found)
        assert found == list(reader.readBetweenOffsets(at, end)) and len(found) <= 300
        if not found:
            break
        rows, at, batches = rows + found, end, batches + 1
    want = [tuple(r) for r in power_samples(spark, SF).select("run_id", "t", "mw").collect()]
    assert sorted(rows) == sorted(want) and batches == -(-len(want) // 300) and reader.read(at)[1] == at


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    sampler.register(spark)
    seen = []

    def once(batches: int):
        """Run some batches, then stop, as a lost driver would; the next run goes on from the checkpoint."""
        stream = spark.readStream.format("power_replay").option("path", f"{SF}/events.parquet").option("maxRowsPerBatch", "400").load()
        sink = lambda df, k: seen.append((k, df.collect()))
        run = running_energy(stream).writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).start()
        before = len(seen)
        for _ in range(600):
            if len(seen) - before >= batches or run.exception():
                break
            run.awaitTermination(0.2)
        run.stop()
        assert not run.exception()

    once(1)
    once(2)
    last = {}
    for _, rows in seen:
        for r in rows:
            last[r.run_id] = (r.n, r.joules)
    assert [k for k, _ in seen] == sorted(k for k, _ in seen) and len({k for k, _ in seen}) >= 3
    want = {r.run_id: (r.n, r.joules) for r in energy.trapezoid(power_samples(spark, SF)).collect()}
    assert set(last) == set(want) and all(last[k][0] == n and abs(last[k][1] - j) < 1e-6 * max(1, j) for k, (n, j) in want.items())
