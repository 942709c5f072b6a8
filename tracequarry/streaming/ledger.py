"""Receipts that arrive in batches: stored once each, with a log of what is whole and summaries that cost the new rows only.

A batch is a folder of its own, named by its id, so a batch that is run again writes over its own rows and nobody else's.  Only when rows, key
filter and partial sums are written is the batch entered in the log; readers take what the log names, so a crash before that adds nothing.  The
lead of a key is what of it is no cell: the problem.  A batch's rows are dealt into buckets by lead, so rows of a problem stay beside each other
and are small in shuffles and files.  Each bucket has a filter of its leads (a Bloom filter, one row for 64 bits); these tell which buckets of which
earlier batches may hold one of the new leads; only their keys are read.  A batch of so many rows that by chance alone each bucket's filter would
be hit asks no filter; its leads are joined with those of all earlier batches.  A batch's rows are shuffled once, some buckets after the others, and
shuffled files go when their query is done, so a large batch asks no more room for them than a small one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import cells_of, summarised
from ..operators.receipts import KEY
from ..session import swept

#: Buckets of a batch, bits of a filter for each lead, the words of 64 bits that a lead marks and its bits in each, and the least bits of a filter.
#: Far less than one of 9000 foreign leads hits a filter.
BUCKETS, BITS_A_LEAD, WORDS, BITS, LEAST_BITS = 32, 32, 2, 4, 1 << 10
#: Rows of a batch beyond which filters would be hit by chance in about every bucket.
MANY = 1 << 20
#: Rows that a task gets when a batch is dealt out, and rows that are dealt out at a time, about; a batch has as many rounds at most as buckets.
ROWS_A_PART, ROWS_A_ROUND = 1 << 19, 1 << 26
CELL = ("arm", "budget")


class Ledger:
    """A folder of receipts: ``rows``, ``filters``, ``sums`` and ``totals``, each by batch id, and the ``log``."""

    def __init__(self, spark: SparkSession, path: str, schema, key=tuple(KEY), cell=CELL):
        self.spark, self.path, self.key, self.cell = spark, path.rstrip("/"), list(key), list(cell)
        self.schema, self.lead = schema, [k for k in self.key if k not in self.cell] or self.key

    # -- the log ------------------------------------------------------------------------------------------------
    def _fs(self, path: str):
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(sc._jsc.hadoopConfiguration()), at

    def batches(self) -> list[int]:
        """Ids of the batches in the log, ascending."""
        fs, at = self._fs(f"{self.path}/log")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()) if fs.exists(at) else []

    def _enter(self, batch_id: int) -> None:
        """An empty file with the batch's id as its name: written under another name and renamed, which is one step."""
        fs, tried = self._fs(f"{self.path}/log/.{uuid.uuid4().hex}")
        fs.create(tried, True).close()
        fs.rename(tried, self._fs(f"{self.path}/log/{batch_id}")[1])

    def _folders(self, kind: str, batches: list[int]) -> list[str]:
        return [f"{self.path}/{kind}/batch={b}" for b in batches]

    def _read(self, kind: str, paths: list[str], schema) -> DataFrame:
        """The rows of the folders ``paths`` of a kind, with the ``batch`` (and ``bucket``) that their names tell."""
        ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        whole = f"{ddl}, batch long" + ", bucket long" * (kind == "rows")
        if not paths:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", f"{self.path}/{kind}").parquet(*paths)

    def rows(self) -> DataFrame:
        """All receipts of whole batches."""
        return self._read("rows", self._folders("rows", self.batches()), self.schema).drop("batch", "bucket")

    # -- filters ------------------------------------------------------------------------------------------------
    def _marks(self, bits: Column) -> Column:
        """The words (``word``, ``bits``) that a row's lead marks in a filter of ``bits`` bits (a power of two)."""

        def mark(k: int) -> Column:
            h = F.xxhash64(F.lit(4 + k), *self.lead)
            one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
            own = one(0)
            for i in range(1, BITS):
                own = own.bitwiseOR(one(i))
            return F.struct(F.shiftright(h, 6 * BITS).bitwiseAND((bits / 64).cast("long") - 1).alias("word"), own.alias("bits"))

        return F.array(*map(mark, range(WORDS)))

    def _bucket(self, buckets: int = BUCKETS) -> Column:
        """A lead's bucket; one of a multiple of BUCKETS has rows of one bucket only."""
        return F.pmod(F.xxhash64(F.lit(2), *self.lead), F.lit(buckets).cast("long"))

    def _filter(self, stored: DataFrame) -> DataFrame:
        """(bucket, size, word, bits): a row for each 64 bits that are not all zero."""
        leads = stored.dropna(subset=self.lead).select("bucket", *self.lead).distinct()
        size = max(LEAST_BITS, 1 << max(0, (leads.count() * BITS_A_LEAD // BUCKETS - 1).bit_length()))
        marks = leads.select("bucket", F.explode(self._marks(F.lit(size))).alias("m"))
        words = marks.groupBy("bucket", "m.word").agg(F.bit_or("m.bits").alias("bits"))
        return words.select("bucket", F.lit(size).cast("long").alias("size"), "word", "bits")

    def may_hold(self, keys: DataFrame, batches: list[int]) -> list[tuple[int, int]]:
        """The (batch, bucket) of ``batches`` whose filter has all marks of some key's lead."""
        filters = self._read("filters", self._folders("filters", batches), "bucket long, size long, word long, bits long")
        sizes = [r["size"] for r in filters.select("size").distinct().collect()]  # powers of two: a few
        if not sizes:
            return []
        asked = keys.dropna(subset=self.key).select(*self.lead).distinct().withColumn("_id", F.xxhash64(F.lit(3), *self.lead)).withColumn("bucket", self._bucket())
        asked = asked.withColumn("size", F.explode(F.array(*(F.lit(s).cast("long") for s in sizes))))
        asked = asked.select("_id", "bucket", "size", F.explode(self._marks(F.col("size"))).alias("m")).select("_id", "bucket", "size", "m.word", F.col("m.bits").alias("own"))
        hit = asked.join(filters, ["bucket", "size", "word"]).where(F.col("bits").bitwiseAND(F.col("own")) == F.col("own"))
        full = hit.groupBy("_id", "size", "bucket", "batch").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= WORDS)
        return sorted((r["batch"], r["bucket"]) for r in full.select("batch", "bucket").distinct().collect())

    def holds(self, keys: DataFrame, batches: list[int]) -> list[tuple[int, int]]:
        """The (batch, bucket) of ``batches`` with a row of some key's lead."""
        if not batches:
            return []
        stored = self._read("rows", self._folders("rows", batches), self.schema).select("batch", "bucket", *self.lead).distinct()
        met = stored.join(keys.dropna(subset=self.key).select(*self.lead).distinct(), self.lead).select("batch", "bucket").distinct()
        return sorted((r["batch"], r["bucket"]) for r in met.collect())

    # -- writing ------------------------------------------------------------------------------------------------
    def append(self, batch: DataFrame, batch_id: int) -> list[tuple[int, int]] | None:
        """Store the receipts of ``batch`` whose key no earlier batch has; null keys never meet and are all stored.

        Returns the (batch, bucket) whose rows were read for that, or None if the log has the batch already.
        """
        logged = self.batches()
        if batch_id in logged:
            return None
        with swept(self.spark, batch.sparkSession):
            size = batch.count()
            many = size > MANY
            if not many:
                batch = batch.persist()
            held = (self.holds if many else self.may_hold)(batch, logged)
            rows = batch.select(*self.schema.names, self._bucket().alias("bucket"))
            self._write(rows.where(" OR ".join(f"{k} IS NULL" for k in self.key)), "rows", batch_id, "bucket")
            known = lambda some: self._read("rows", [f"{self.path}/rows/batch={b}/bucket={c}" for b, c in some], self.schema)
            n_old = known(held).count() if held else 0
            a_bucket = size // BUCKETS + n_old // max(1, len({c for _, c in held}))
            rounds = min(BUCKETS, -(-(size + n_old) // ROWS_A_ROUND))
            for r in range(rounds):
                own = [(b, c) for b, c in held if c % rounds == r]
                fresh = self._fresh(rows.where(F.col("bucket") % rounds == r), known(own) if own else None, BUCKETS * (1 + a_bucket // ROWS_A_PART))
                self._write(fresh, "rows", batch_id, "bucket", mode="append")
            stored = self._read("rows", self._folders("rows", [batch_id]), self.schema)
            self._write(self._filter(stored), "filters", batch_id)
            self._write(cells_of(stored, self.cell), "sums", batch_id)
            self._enter(batch_id)
            if not many:
                batch.unpersist()
        return held

    def _fresh(self, rows: DataFrame, old: DataFrame | None, parts: int) -> DataFrame:
        """One of ``rows`` for each key, if it has no null and is not in ``old``: both are dealt out once, by lead, and grouped where they are."""
        rows = rows.withColumn("_old", F.lit(False))
        if old is not None:
            rows = rows.unionByName(old.select(*self.key, "bucket", F.lit(True).alias("_old")), allowMissingColumns=True)
        dealt = rows.dropna(subset=self.key).withColumn("_part", self._bucket(parts).cast("int")).repartitionById(parts, "_part")
        others = [F.first(c).alias(c) for c in self.schema.names if c not in self.key]
        once = dealt.groupBy(*self.key, "bucket", "_part").agg(F.bool_or("_old").alias("_old"), *others)
        return once.where(~F.col("_old")).select(*self.schema.names, "bucket")

    def _write(self, df: DataFrame, kind: str, batch_id: int, *by: str, mode: str = "overwrite") -> None:
        df.write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(f"{self.path}/{kind}/batch={batch_id}")

    # -- reports ------------------------------------------------------------------------------------------------
    def _sums(self, kind: str, batches: list[int]) -> DataFrame:
        kinds = {f.name: f.dataType.simpleString() for f in self.schema.fields}
        ddl = ", ".join(f"{c} {kinds[c]}" for c in self.cell) + ", n long, correct long, truncated long, mj long, tokens long"
        return self._read(kind, self._folders(kind, batches), ddl).drop("batch")

    def refresh(self) -> DataFrame:
        """The summary of all stored receipts: the last totals and the sums of the batches since, which become the next totals."""
        logged = self.batches()
        fs, at = self._fs(f"{self.path}/totals")
        made = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at) if s.getPath().getName().startswith("batch=") and fs.exists(self._fs(f"{s.getPath()}/_SUCCESS")[1])) if fs.exists(at) else []
        last = [b for b in made if b in logged][-1:]
        since = [b for b in logged if not last or b > last[0]]
        merged = self._sums("totals", last).unionByName(self._sums("sums", since))
        merged = merged.groupBy(*self.cell).agg(*(F.sum(c).alias(c) for c in ("n", "correct", "truncated", "mj", "tokens")))
        if since:
            self._write(merged, "totals", since[-1])
            merged = self._sums("totals", since[-1:])
        return summarised(merged, self.cell)

    def run(self, stream: DataFrame, checkpoint: str, every: int = 5, report=None):
        """Store a stream's batches; behind each ``every``-th the report function gets the refreshed summary."""

        def write(batch: DataFrame, batch_id: int) -> None:
            self.append(batch, batch_id)
            if report is not None and (batch_id + 1) % every == 0:
                report(self.refresh())

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
