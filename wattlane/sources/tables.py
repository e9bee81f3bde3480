"""Time-partitioned Parquet tables, idempotent appends and versioned state tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import add_seconds
from ..operators.policy import expired
from ..schemas import KEYS, TIME_COLUMNS

KEPT_VERSIONS = 3


class TableStore:
    """Tables below one folder.

    History tables are partitioned by the date of their time column and by batch, so a
    time range prunes whole folders and row groups, and a batch that runs again replaces
    its own rows.  State tables (totals, marks, open windows) are rewritten as a new
    version per batch.
    """

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark = spark
        self.base = base.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _folders(self, name: str, prefix: str) -> list[str]:
        """Values of the ``prefix=value`` folders of a table."""
        if not self._exists(self.path(name)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path(name)))]
        return sorted(n[len(prefix) + 1:] for n in names if n.startswith(f"{prefix}="))

    def scan(self, name: str, start=None, end=None) -> DataFrame:
        """Rows of a history table in [start, end]; also filters the date folders."""
        df = self.spark.read.parquet(self.path(name))
        time = TIME_COLUMNS[name]
        if start is not None:
            low = F.lit(start).cast("timestamp")
            df = df.where((F.col("date") >= F.to_date(low)) & (F.col(time) >= low))
        if end is not None:
            high = F.lit(end).cast("timestamp")
            df = df.where((F.col("date") <= F.to_date(high)) & (F.col(time) <= high))
        return df

    def append(self, name: str, rows: DataFrame, batch: int | None = None) -> None:
        """Append, one folder per date and batch, sorted for row-group skipping by device and time.

        A batch that is written again replaces what it wrote before.
        """
        time = TIME_COLUMNS[name]
        dated = rows.withColumn("date", F.to_date(time)).withColumn("batch", F.lit(batch or 0).cast("long"))
        order = ["date"] + [c for c in ("device_id", time) if c in rows.columns]
        writer = dated.sortWithinPartitions(*order).write.partitionBy("date", "batch")
        if batch is None:
            writer.mode("append").parquet(self.path(name))
        else:
            writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path(name))

    def held(self, name: str, rows: DataFrame, batch: int | None = None, among: DataFrame | None = None) -> DataFrame | None:
        """The stored rows that may have the keys of ``rows``: those of its range of times.

        The range is read from ``among`` where that is cheaper: rows that have all the times of ``rows``.

        Dates prune folders, and times prune files by their statistics, as each batch is a
        file of its own with a narrow range; so a batch reads what came at its times,
        however full the day is. With ``batch``, only rows of earlier batches count.
        """
        time = TIME_COLUMNS[name]
        low, high, dates = (rows if among is None else among).agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time)), F.collect_set(F.to_date(time))).first()
        folders = [p for p in (f"{self.path(name)}/date={d}" for d in sorted(dates)) if self._exists(p)]  # days of a batch
        if not folders:
            return None
        stored = self.spark.read.option("basePath", self.path(name)).parquet(*folders).where(
            F.col(time).between(F.timestamp_micros(F.lit(low)), F.timestamp_micros(F.lit(high))))
        return stored if batch is None else stored.where(F.col("batch") < batch)

    def unseen(self, name: str, rows: DataFrame, batch: int | None = None, keys: Sequence[str] | None = None,
               among: DataFrame | None = None) -> DataFrame:
        """The rows whose key is not stored yet (by an earlier batch).

        The key has the table's time, or a hash of it, so a copy has the same time.
        """
        keys = list(keys or KEYS[name])
        stored = self.held(name, rows, batch, among)
        return rows if stored is None else rows.join(stored.select(*keys), keys, "left_anti").select(*rows.columns)

    def append_new(self, name: str, rows: DataFrame, keys: Sequence[str] | None = None, batch: int | None = None,
                   among: DataFrame | None = None) -> None:
        """Append the rows whose key is not stored yet; a replayed batch adds nothing."""
        self.append(name, self.unseen(name, rows, batch, keys, among), batch)

    def prune(self, name: str, as_of: str, days: float, may_go: DataFrame | None = None) -> list[str]:
        """Retention; returns the dates that changed. With ``may_go``, only rows with its keys go.

        A date without rows to keep is dropped whole.  A date that keeps some rows is
        written beside the table and then swapped in; a swap that was interrupted is
        finished by the next call.  Other dates are not touched.
        """
        if days <= 0 or not self._exists(self.path(name)):
            return []
        self._finish_swap(name)
        states = ("sent", "discarded") if name == "alert_outbox" and may_go is None else ()
        last = F.to_date(add_seconds(F.lit(as_of).cast("timestamp"), -days * 86400))

        def aged(df: DataFrame) -> DataFrame:
            old = expired(as_of, days, TIME_COLUMNS[name], states)
            if may_go is not None:
                df = df.join(may_go.distinct().withColumn("_go", F.lit(True)), may_go.columns, "left")
                old = old & F.col("_go").isNotNull()
            return df.withColumn("_old", old).drop("_go")

        rows = aged(self.spark.read.parquet(self.path(name)).where(F.col("date") <= last))
        per_date = rows.groupBy("date").agg(F.count_if("_old").alias("out"), F.count_if(~F.col("_old")).alias("kept"))
        changed = sorted((str(r["date"]), r["kept"]) for r in per_date.where("out > 0").collect())  # days
        for date, kept in changed:
            left = aged(self.spark.read.parquet(f"{self.path(name)}/date={date}")).where("NOT _old").drop("_old")
            self._replace(name, date, left if kept else None)
        return [date for date, _ in changed]

    def rewrite(self, name: str, before: str, merge=None) -> list[str]:
        """Write each date before ``before`` that has several batches as one (the newest of them)."""
        if not self._exists(self.path(name)):
            return []
        self._finish_swap(name)
        dates = []
        for date in (d for d in self._folders(name, "date") if d < before):
            batches = [int(b) for b in self._folders(f"{name}/date={date}", "batch")]
            if len(batches) < 2:
                continue
            rows = self.spark.read.parquet(f"{self.path(name)}/date={date}").drop("batch")
            order = [c for c in ("device_id", TIME_COLUMNS[name]) if c in rows.columns]
            rows = (merge(rows) if merge else rows).repartition("device_id" if "device_id" in rows.columns else TIME_COLUMNS[name])
            self._replace(name, date, rows.sortWithinPartitions(*order).withColumn("batch", F.lit(max(batches)).cast("long")))
            dates.append(date)
        return dates

    def _replace(self, name: str, date: str, rows: DataFrame | None) -> None:
        if rows is not None:
            rows.write.mode("overwrite").partitionBy("batch").parquet(f"{self.path(name)}__keep/date={date}")
        self._fs.delete(self._path(f"{self.path(name)}/date={date}"), True)
        self._finish_swap(name)

    def stage(self, name: str, version: int, rows: DataFrame, by: str) -> DataFrame:
        """Write the rows of a batch once, in columns and by kind, and read them again."""
        path = f"{self.path(name)}/version={version}"
        rows.write.mode("overwrite").partitionBy(by).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def unstage(self, name: str, version: int) -> None:
        self._fs.delete(self._path(f"{self.path(name)}/version={version}"), True)

    def _finish_swap(self, name: str) -> None:
        staged = f"{self.path(name)}__keep"
        for date in self._folders(f"{name}__keep", "date"):
            source, target = f"{staged}/date={date}", f"{self.path(name)}/date={date}"
            if self._exists(f"{source}/_SUCCESS") and not self._exists(target):
                self._fs.rename(self._path(source), self._path(target))

    def state(self, name: str, version: int, schema: str) -> DataFrame:
        """State before ``version``: the newest complete older version, or an empty table."""
        older = sorted((int(v) for v in self._folders(name, "version") if int(v) < version), reverse=True)
        for v in older:
            if self._exists(f"{self.path(name)}/version={v}/_SUCCESS"):
                return self.spark.read.schema(schema).parquet(f"{self.path(name)}/version={v}")
        return self.spark.createDataFrame([], schema)

    def save_state(self, name: str, version: int, rows: DataFrame) -> None:
        """Write one version; writing it again replaces it.  The last few versions are kept."""
        rows.write.mode("overwrite").parquet(f"{self.path(name)}/version={version}")
        for v in self._folders(name, "version"):
            if int(v) <= version - KEPT_VERSIONS:
                self._fs.delete(self._path(f"{self.path(name)}/version={v}"), True)
