"""A versioned table root: load, fold in a batch, delete a source, clear.

A table is kept in buckets by a hash of its key. Every change stages new versions of the buckets it touches, and they
become visible together by one small manifest with a number in its name. The newest manifest counts, so a batch is
seen whole or not at all, a writer that ends halfway leaves the version before, and a lost executor at worst
repeats a stage. The manifest before is kept for readers; what neither of the two names is removed.
"""

from __future__ import annotations

import json
from functools import partial
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators.ingest import Batch
from lodeworks.operators.lineage import delete_source
from lodeworks.schema import SCHEMAS, Graph, empty, violations
from lodeworks.session import at_once

_KEYS = {"coverage_rules": "rule_id"}


class Store:
    """Tables below ``root`` (any path that Spark can write). One writer at a time.

    ``buckets`` is the number of parts of a table, taken when the store is first written; a large store wants more,
    so that a batch touches a small part of it.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 8):
        self.spark, self.root = spark, root.rstrip("/")
        names = self._manifests()
        self.buckets = self._read(names[-1])["buckets"] if names else buckets

    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(_KEYS.get(table, "id")), F.lit(self.buckets)).cast("int")

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _manifests(self) -> list[str]:
        """Names of the whole manifests, oldest first."""
        fs, place = self._fs(), self._path("manifests")
        if not fs.exists(place):
            return []
        return sorted(n for f in fs.listStatus(place) if (n := f.getPath().getName()).startswith("manifest-"))

    def _read(self, manifest: str) -> dict:
        rows = self.spark.read.text(f"{self.root}/manifests/{manifest}", wholetext=True).collect()
        return json.loads(rows[0].value)

    def _versions(self) -> dict[str, dict[str, str]]:
        """Table -> bucket -> version, of the newest manifest."""
        names = self._manifests()
        return self._read(names[-1])["tables"] if names else {}

    def _table(self, table: str, held: dict[str, str]) -> DataFrame:
        """The rows of some buckets of a table."""
        if not held:
            return empty(self.spark, table)
        return self.spark.read.schema(SCHEMAS[table]).parquet(*[f"{self.root}/{table}/{v}/b={b}" for b, v in sorted(held.items())])

    def load(self) -> Graph:
        """The current version; tables never written are empty."""
        versions = self._versions()
        return Graph(**{t: self._table(t, versions.get(t, {})) for t in SCHEMAS})

    def save(self, graph: Graph, tables: list[str] | None = None) -> Graph:
        """Stage the named tables whole (all by default), then switch to them."""
        versions = self._versions()
        versions |= at_once({name: partial(self._stage, name, graph.tables()[name]) for name in tables or list(SCHEMAS)})
        self._switch(versions)
        return self.load()

    def _stage(self, name: str, df: DataFrame) -> dict[str, str]:
        """Write rows as a new version; bucket -> version of the buckets that got any."""
        version = uuid4().hex
        typed = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in empty(self.spark, name).schema.fields])
        typed.withColumn("b", self._bucket(name)).repartition("b").write.partitionBy("b").parquet(f"{self.root}/{name}/{version}")
        found = [f.getPath().getName() for f in self._fs().listStatus(self._path(name, version))]
        return {f[2:]: version for f in found if f.startswith("b=")}

    def _switch(self, versions: dict[str, dict[str, str]]) -> None:
        fs, names = self._fs(), self._manifests()
        number = int(names[-1].split("-")[1]) + 1 if names else 1
        fs.mkdirs(self._path("manifests"))
        staged = self._path("manifests", f"next-{uuid4().hex}")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "tables": versions}, sort_keys=True), "utf-8"))
        out.close()
        if not fs.rename(staged, self._path("manifests", f"manifest-{number:012d}")):
            raise OSError(f"the manifest {number} of {self.root} could not be put in place")
        self._clean(names)

    def _clean(self, names: list[str]) -> None:
        """Remove manifests before the last two, and versions that neither of these names."""
        fs = self._fs()
        for old in names[:-1]:
            fs.delete(self._path("manifests", old), False)
        used = [self._read(m)["tables"] for m in self._manifests()]
        for table in SCHEMAS:
            if fs.exists(self._path(table)):
                live = {v for u in used for v in u.get(table, {}).values()}
                for f in fs.listStatus(self._path(table)):
                    if f.getPath().getName() not in live:
                        fs.delete(f.getPath(), True)

    def ingest(self, batch: Batch) -> Graph:
        """Fold a batch in and switch; repeating a batch changes nothing but update times.

        Only buckets that the batch has rows for are read, folded and written again.
        """
        versions, batch = self._versions(), batch.written()
        buckets = lambda t: {str(r.b) for r in batch.rows[t].select(self._bucket(t).alias("b")).distinct().collect()}  # noqa: E731  at most a store's buckets
        touched = at_once({t: partial(buckets, t) for t in batch.rows})
        whole = self.load()
        part = whole.with_tables(**{t: self._table(t, {b: v for b, v in versions.get(t, {}).items() if b in bs}) for t, bs in touched.items()})
        folded = batch.fold_into(part, whole)
        staged = at_once({name: partial(self._stage, name, folded.tables()[name]) for name in batch.rows})
        versions |= {name: versions.get(name, {}) | own for name, own in staged.items()}
        self._switch(versions)
        return self.load()

    def delete_source(self, source_id: str) -> tuple[Graph, DataFrame]:
        graph, counts = delete_source(self.load(), source_id)
        kept = counts.collect()
        return self.save(graph), self.spark.createDataFrame(kept, counts.schema)

    def clear(self) -> Graph:
        self._switch({})
        return self.load()

    def check(self) -> DataFrame:
        """Violations of vocabulary, ranges and key uniqueness."""
        return violations(self.load())
