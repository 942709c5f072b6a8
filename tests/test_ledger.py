"""Receipts in batches: each stored once, summaries from partial sums, nothing from a batch that was not finished."""

import time

import pytest
from pyspark.sql import functions as F

from tracequarry.operators import metrics
from tracequarry.plans.catalogue import QUERIES
from tracequarry.sources.fixtures import receipts as receipts_view
from tracequarry.streaming.ledger import Ledger

SF = "/root/testdata/sf0.001"
COLUMNS = ["problem_id", "arm", "budget", "is_correct", "truncated", "tokens_emitted", "mj"]


@pytest.fixture(scope="module")
def receipts(spark):
    return receipts_view(spark, SF).select(*COLUMNS).where("problem_id < 600").cache()


def bag(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_replayed_batches_equal_one_summary(spark, receipts, tmp_path):
    """Five files in five micro-batches; the last repeats the second, and a first run stops behind three."""
    for k in range(5):
        part = receipts.where(F.pmod("problem_id", F.lit(4)) == (k if k < 4 else 1))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ledger, seen = Ledger(spark, str(tmp_path / "ledger"), receipts.schema), []
        source = spark.readStream.schema(receipts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        assert ledger.run(source, str(tmp_path / "checkpoint"), every=2, report=lambda s: seen.append(bag(s))).awaitTermination(100)
        assert len(seen) == (k % 2)
    assert ledger.batches() == [0, 1, 2, 3, 4]
    assert bag(ledger.rows()) == bag(receipts)
    assert bag(ledger.refresh()) == bag(metrics.cell_summary(receipts))


def test_only_buckets_whose_filter_hits_are_read(spark, receipts, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"), receipts.schema)
    assert bag(ledger.refresh()) == [] and ledger.rows().count() == 0
    for k in range(4):
        read = ledger.append(receipts.where(F.pmod("problem_id", F.lit(4)) == k), k)
        assert len(read) <= 3 * max(1, k)  # of 32 buckets a batch, by chance
    again = receipts.where("problem_id % 4 = 2").limit(3)
    new = receipts.limit(20).withColumn("problem_id", F.col("problem_id") + 10**9)
    read = ledger.append(again.unionByName(new), 7)
    assert 2 in {b for b, _ in read} and len(read) <= 8
    assert {b for b, _ in ledger.may_hold(again, [0, 1, 2, 3])} == {2}
    assert ledger.append(again.unionByName(new), 7) is None
    ledger.append(new, 8)
    assert ledger.rows().count() == receipts.count() + 20
    assert bag(ledger.refresh()) == bag(metrics.cell_summary(ledger.rows()))
    # A refresh with nothing new, and one behind a single further batch.
    assert bag(ledger.refresh()) == bag(metrics.cell_summary(ledger.rows()))
    ledger.append(receipts.limit(5).withColumn("problem_id", F.col("problem_id") - 10**9), 9)
    assert bag(ledger.refresh()) == bag(metrics.cell_summary(ledger.rows()))


def test_crash_between_rows_and_log_adds_nothing(spark, receipts, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path / "ledger"), receipts.schema)
    ledger.append(receipts.where("problem_id % 2 = 0"), 0)
    before = bag(ledger.rows())
    with monkeypatch.context() as broken:
        broken.setattr(Ledger, "_enter", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ledger.append(receipts, 1)
    assert bag(ledger.rows()) == before and ledger.batches() == [0]
    assert bag(ledger.refresh()) == bag(metrics.cell_summary(receipts.where("problem_id % 2 = 0")))
    ledger.append(receipts, 1)  # the batch is run again
    assert bag(ledger.rows()) == bag(receipts) and bag(ledger.refresh()) == bag(metrics.cell_summary(receipts))


def test_null_keys_and_empty_batches(spark, receipts, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"), receipts.schema)
    assert ledger.append(receipts.limit(0), 0) == []
    odd = receipts.limit(2).withColumn("arm", F.lit(None).cast("string"))
    ledger.append(odd.unionByName(odd), 1)
    ledger.append(odd, 2)
    assert ledger.rows().count() == 6 and ledger.refresh().select(F.sum("n")).first()[0] == 6


def test_batches_of_many_keys_ask_no_filter(spark, receipts, tmp_path, monkeypatch):
    """Beyond a size each filter is hit by chance, so keys of all earlier rows are joined at once; nothing is stored twice."""
    monkeypatch.setattr("tracequarry.streaming.ledger.MANY", 5000)
    monkeypatch.setattr(Ledger, "may_hold", lambda *_: pytest.fail("asked"))
    ledger = Ledger(spark, str(tmp_path / "ledger"), receipts.schema)
    odd = receipts.limit(2).withColumn("arm", F.lit(None).cast("string"))
    assert ledger.append(receipts.where("problem_id % 2 = 0").unionByName(odd), 0) == []
    assert len(ledger.append(receipts.unionByName(odd), 1)) == 32
    assert bag(ledger.rows()) == bag(receipts.unionByName(odd).unionByName(odd))
    monkeypatch.undo()
    assert len(ledger.append(receipts.where("problem_id < 40"), 2)) > 0 and ledger.rows().count() == receipts.count() + 4


def files_of_shuffles(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = manager.getAllFiles()
    return {str(found.apply(i).getName()) for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_shuffled_files_go_with_their_query(spark, receipts, tmp_path, monkeypatch):
    """A batch of many keys, dealt out in five rounds, leaves no shuffled files, and the session's setting as it was."""
    monkeypatch.setattr("tracequarry.streaming.ledger.MANY", 1000)
    monkeypatch.setattr("tracequarry.streaming.ledger.ROWS_A_ROUND", 3000)
    ledger = Ledger(spark, str(tmp_path / "ledger"), receipts.schema)
    receipts.count()
    before, name = files_of_shuffles(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    ledger.append(receipts, 0)
    for _ in range(50):  # they are deleted a moment later
        if files_of_shuffles(spark) <= before:
            break
        time.sleep(0.2)
    assert files_of_shuffles(spark) <= before and spark.conf.get(name, None) == was
    assert len(ledger.append(receipts.unionByName(receipts.withColumn("budget", F.col("budget") + 1)), 1)) == 32
    assert ledger.rows().count() == 2 * receipts.count() and ledger.rows().dropDuplicates(ledger.key).count() == 2 * receipts.count()


def test_rows_of_a_problem_are_dealt_out_together(spark, receipts, tmp_path):
    """Filters are marked by problem, not by row, and a batch's rows are shuffled once, with or without old keys."""
    ledger = Ledger(spark, str(tmp_path / "ledger"), receipts.schema)
    ledger.append(receipts, 0)
    stored = spark.read.parquet(str(tmp_path / "ledger/rows/batch=0"))
    assert stored.groupBy("problem_id").agg(F.count_distinct("bucket").alias("n")).where("n > 1").count() == 0
    assert spark.read.parquet(str(tmp_path / "ledger/filters/batch=0")).count() <= 2 * 600
    rows = stored.select(*COLUMNS, "bucket")
    for old in (None, rows):
        plan = ledger._fresh(rows, old, 32)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1


def test_odd_keys_of_many_rows(spark, receipts, tmp_path, monkeypatch):
    """Null problems and arms, equal rows among them, in rounds: all are stored each time, and keys once."""
    monkeypatch.setattr("tracequarry.streaming.ledger.MANY", 1000)
    monkeypatch.setattr("tracequarry.streaming.ledger.ROWS_A_ROUND", 2000)
    ledger = Ledger(spark, str(tmp_path / "ledger"), receipts.schema)
    some = receipts.where("problem_id < 100")
    lost = some.limit(70).withColumn("problem_id", F.lit(None).cast("long"))
    odd = lost.unionByName(lost).unionByName(some.where("problem_id < 3").withColumn("arm", F.lit(None).cast("string")))
    n = odd.count()
    for k in range(2):
        ledger.append(some.unionByName(some).unionByName(odd).repartition(3), k)
        assert ledger.rows().count() == some.count() + (k + 1) * n
    ledger.append(odd.unionByName(some.limit(5)), 2)  # a small batch
    assert bag(ledger.rows()) == bag(some.unionByName(odd).unionByName(odd).unionByName(odd))
    assert bag(ledger.refresh()) == bag(metrics.cell_summary(ledger.rows()))


def test_receipts_stream_keeps_no_batch_as_it_arrived(spark, monkeypatch):
    """When a batch is stored, its folder holds the files of that batch alone."""
    seen, append, at = [], Ledger.append, "/root/testdata/sf0.001"
    monkeypatch.setattr(Ledger, "append", lambda self, batch, k: (seen.append((batch.count(), spark.read.parquet(self.path.replace("/ledger", "/in")).count())), append(self, batch, k))[1])
    assert len(QUERIES["receipts_stream"](spark, at).collect()) == 24
    assert len(seen) == 5 and all(own == all_ for own, all_ in seen)
