"""Persistent collections of rows by id: bucketed Parquet tables of a base and of later changes, merged when read and compacted now and then."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.operators.vectors import top_k

#: Marks rows of a change that take an id away.
GONE = "_gone"


class Collection:
    """Rows by id under `root/name`. An upsert writes its own rows as one more folder, whatever the collection holds; a read
    takes the last base and the changes after it, the latest row of each id. After `compact_after` changes a new base is
    written; folders older than the base before it are deleted then, so that readers of the last generation can finish.

    All folders of a generation are tables bucketed by the id into the same number of buckets, so that a read meets the rows of
    a bucket with the later changes of that bucket and moves nothing, and a lookup by id opens one bucket of each. A new base has
    a bucket for every `bucket_rows` rows, and `buckets` at least.

    Folders count once complete, so readers never see half of one. Chunks that a new indexing run no longer makes stay, unless
    whole documents are replaced (replace_by): then the change also lists the ids that go. Ids are not null (an error). Tables are
    registered in the session's catalog by the tag of their folder when they are first read; the folders are all that lasts.
    """

    def __init__(self, spark: SparkSession, root: str, name: str = "documents", key: str = "id", compact_after: int = 8, buckets: int = 8, bucket_rows: int = 1_000_000):
        self.spark, self.path, self.key, self.compact_after = spark, f"{root.rstrip('/')}/{name}", key, compact_after
        self.buckets, self.bucket_rows = buckets, bucket_rows

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, *below: str) -> bool:
        fs, _ = self._fs()
        return fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *below])))

    def versions(self) -> list[str]:
        """Names of the complete folders, oldest first: number, base or delta, buckets, a tag."""
        fs, path = self._fs()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(n for n in names if self._exists(n, "rows", "_SUCCESS"))

    def current(self) -> list[str]:
        """The last base and the changes after it."""
        found = self.versions()
        bases = [i for i, n in enumerate(found) if "-base-" in n]
        return found[bases[-1] :] if bases else []

    def version_rows(self, name: str) -> DataFrame:
        """What one folder holds, with the ids that it takes away (GONE)."""
        table, path = f"corpusflow_{name.split('-')[-1]}", f"{self.path}/{name}/rows"
        if not self.spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) INTO {name.split('-')[2]} BUCKETS LOCATION '{path}'")
        return self.spark.table(table)

    def read(self) -> DataFrame | None:
        """The latest row of each id: each folder's rows less the ids of later ones, bucket by bucket."""
        parts = [self.version_rows(n) for n in self.current()]
        if not parts:
            return None
        left = []
        for at, part in enumerate(parts):
            for later in parts[at + 1 :]:
                part = part.join(later.select(self.key).hint("shuffle_hash"), self.key, "left_anti")
            left.append(part.where(f"not {GONE}").drop(GONE))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), left)

    def _write(self, rows: DataFrame, kind: str, buckets: int) -> None:
        """rows with a version; of several of one id the last version is written."""
        found = self.versions()
        number, tag = int(found[-1].split("-")[0]) + 1 if found else 0, uuid.uuid4().hex[:12]
        rows = rows if GONE in rows.columns else rows.withColumn(GONE, F.lit(False))
        known = F.when(F.col(self.key).isNotNull(), F.col(self.key)).otherwise(F.raise_error(F.lit(f"{self.key} is null")).cast(dict(rows.dtypes)[self.key]))
        last = Window.partitionBy(self.key).orderBy(GONE, F.desc("version"))
        once = rows.withColumn(self.key, known).repartition(buckets, self.key).withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
        name = f"{number:08d}-{kind}-{buckets}-{tag}"
        once.write.format("parquet").bucketBy(buckets, self.key).option("path", f"{self.path}/{name}/rows").saveAsTable(f"corpusflow_{tag}")

    def add(self, rows: DataFrame, replace_by: str | None = None) -> None:
        """Insert rows, or replace those of the same id; of several new rows of one id the last version wins. With replace_by, ids of
        the same value of that column that the new rows do not have go."""
        rows = rows if "version" in rows.columns else rows.withColumn("version", F.lit(0))
        now = self.current()
        if not now:
            self._write(rows, "base", self.buckets)
            return
        if replace_by:
            owned = self.read().select(self.key, replace_by).join(rows.select(replace_by).distinct(), replace_by, "left_semi")
            rows = rows.unionByName(owned.select(self.key, F.lit(True).alias(GONE)), allowMissingColumns=True).withColumn(GONE, F.coalesce(GONE, F.lit(False)))
        self._write(rows, "delta", int(now[0].split("-")[2]))
        if len(now) >= self.compact_after:
            self.compact()

    def compact(self) -> None:
        """Write what the collection holds as a new base, and delete what stands before the base until now."""
        before = self.current()
        if len(before) < 2:
            return
        rows = self.read()
        self._write(rows, "base", max(self.buckets, -(-rows.count() // self.bucket_rows)))
        fs, _ = self._fs()
        for name in self.versions():
            if name < before[0]:
                self.spark.sql(f"DROP TABLE IF EXISTS corpusflow_{name.split('-')[-1]}")
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def count(self) -> int:
        rows = self.read()
        return rows.count() if rows is not None else 0

    def get(self, key) -> DataFrame:
        """The row of an id (none if unknown): one bucket of each folder is opened, and the filter reaches its scan."""
        return self.read().where(F.col(self.key) == F.lit(key))

    def document_chunks(self, name: str) -> DataFrame:
        """A document's chunks by id, as strings sort."""
        return self.read().where(F.col("document_name") == name).orderBy(self.key)

    def search(self, vector: list[float], k: int, where=None) -> DataFrame:
        """The k nearest rows, exactly: all rows that pass are compared. `vector_index` finds them among few."""
        return top_k(self.read(), vector, k, where, vec_id=self.key)
