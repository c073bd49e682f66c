"""A store of cases beside concurrent readers: each write is a version of its own, and a pointer is moved last.

Under the store's folder, ``versions/<case>/<version>`` holds the tables of a version and
``current/<case>`` names the version that counts.  Renaming a file over another is one
step of the file system, so a reader sees the old version or the new one, and a writer
that dies leaves the old one in force.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CaseStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path("current").getFileSystem(self._conf)

    def put(self, case: str, tables: dict[str, DataFrame], before_commit: Callable[[], None] | None = None) -> str:
        """Write the tables of a case as a new version and make it the one that counts; returns the version.

        An error before the pointer moves removes what was written and changes nothing.
        ``before_commit`` is called between the two, for checks of what was written.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", case):
            raise ValueError(f"{case!r} is no name of a case")
        version = uuid.uuid4().hex
        try:
            for name, df in tables.items():
                df.write.parquet(f"{self.root}/versions/{case}/{version}/{name}")
            if before_commit:
                before_commit()
            self._point(case, version)
        except BaseException:
            self._fs().delete(self._path("versions", case, version), True)
            raise
        return version

    def _point(self, case: str, version: str) -> None:
        fs, part = self._fs(), self._path("pending", f"{case}-{version}")
        out = fs.create(part, True)
        out.write(bytearray(version.encode()))
        out.close()
        fs.mkdirs(self._path("current"))
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        modes = self.spark.sparkContext._gateway.new_array(options, 1)
        modes[0] = options.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self._conf).rename(part, self._path("current", case), modes)

    def versions(self) -> DataFrame:
        """case, version: one row for each case."""
        if not self._fs().exists(self._path("current")) or not self._fs().listStatus(self._path("current")):
            return self.spark.createDataFrame([], "case string, version string")
        return self.spark.read.text(f"{self.root}/current", wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("case"), F.col("value").alias("version"))

    def table(self, name: str, *cases: str) -> DataFrame:
        """A table of the cases asked for (all by default), in the versions that count now, with the case's name."""
        now = [r for r in self.versions().orderBy("case").collect() if not cases or r["case"] in cases]  # names only
        if missing := set(cases) - {r["case"] for r in now}:
            raise KeyError(f"no such case: {sorted(missing)}")
        if not now:
            raise KeyError("the store has no cases")
        parts = [self.spark.read.parquet(f"{self.root}/versions/{r['case']}/{r['version']}/{name}").withColumn("case", F.lit(r["case"])) for r in now]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def clean(self) -> int:
        """Remove versions that no longer count; readers that began before must have ended."""
        now, fs, n = {r["case"]: r["version"] for r in self.versions().collect()}, self._fs(), 0
        for case in fs.listStatus(self._path("versions")) if fs.exists(self._path("versions")) else []:
            for version in fs.listStatus(case.getPath()):
                if now.get(case.getPath().getName()) != version.getPath().getName():
                    fs.delete(version.getPath(), True)
                    n += 1
        return n
