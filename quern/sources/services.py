"""Injected services and publishing (S8, S9, S11, M20, L4): nothing here opens a network connection by itself."""

from __future__ import annotations

import math
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from io import BytesIO

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.tables import safe_member

DIMENSIONS, BATCH, TRIES = 1024, 32, 3
#: Seconds for one call, and before the first repetition (twice as many before the next).
TIMEOUT, WAIT = 15.0, 0.5


class ServiceError(Exception):
    """For services to raise where a call failed and may be repeated."""


def _called(service: Callable, texts: list[str], timeout: float) -> list:
    """One call in a thread of its own; TimeoutError after ``timeout`` seconds."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(service, texts).result(timeout)
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def embed_batch(
    texts: Sequence[str], service: Callable[[list[str]], list[Sequence[float]]], dimensions: int = DIMENSIONS, tries: int = TRIES, timeout: float = TIMEOUT, wait: float = WAIT
) -> list[list[float]]:
    """Vectors cut to ``dimensions``; an empty list for blank texts, bad vectors and after ``tries`` failed calls.

    Failed calls are those that take too long or raise ServiceError or an OSError (all connection errors); they are
    repeated after a wait that doubles. Other exceptions are faults of the service's code and are raised.
    """
    ask = [t for t in texts if t and t.strip()]
    got: list = []
    for k in range(tries):
        try:
            got = _called(service, ask, timeout) if ask else []
            break
        except (ServiceError, OSError, TimeoutError):
            if k + 1 == tries:
                return [[] for _ in texts]
            time.sleep(wait * 2**k)
    if len(got) != len(ask):
        return [[] for _ in texts]
    fine = lambda v: [float(x) for x in v[:dimensions]] if len(v) >= dimensions and all(math.isfinite(x) for x in v) else []
    it = iter(got)
    return [fine(next(it)) if t and t.strip() else [] for t in texts]


def embed(df: DataFrame, text: str, service: Callable[[list[str]], list[Sequence[float]]], key: str = "id", dimensions: int = DIMENSIONS, batch: int = BATCH) -> DataFrame:
    """Key and embedding for every row, in batches inside each Arrow batch. The service is a function that workers import."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for i in range(0, len(p), batch):
                part = p.iloc[i : i + batch]
                yield pd.DataFrame({key: part[key], "embedding": embed_batch(part[text].tolist(), service, dimensions)})

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<double>")


def archive_members(archives: DataFrame, most: int = 512 << 20) -> DataFrame:
    """Safe members of zip archives (path, content) as rows: path, member, content; unsafe names and bombs are refused."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for path, content in zip(p["path"], p["content"], strict=True):
                with zipfile.ZipFile(BytesIO(content)) as z:
                    infos = [i for i in z.infolist() if not i.is_dir()]
                    if bad := [i.filename for i in infos if not safe_member(i.filename)]:
                        raise ValueError(f"{path}: unsafe member {bad[0]!r}")
                    if sum(i.file_size for i in infos) > most:
                        raise ValueError(f"{path}: members exceed {most} bytes")
                    for i in infos:
                        yield pd.DataFrame({"path": [path], "member": [i.filename], "content": [z.read(i)]})

    return archives.select("path", "content").mapInPandas(run, "path string, member string, content binary")


class Versions:
    """Numbered versions of a table beside each other; readers see all of the last one.

    A version's data is written first, then its number is taken by renaming a finished pointer file to it. The rename fails
    where the number is taken, so of two writers that start from the same version one wins and the other gets an error, and
    a pointer is never missing or half written. The rename is atomic where the file system's is (object stores need one
    that is).
    """

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.dir = spark, root, f"{root}/{name}.versions"
        self.name, self.path = name, spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def last(self) -> int:
        """The last number, 0 before the first version."""
        at = self.path(self.dir)
        if not self.fs.exists(at):
            return 0
        return max((int(s.getPath().getName()) for s in self.fs.listStatus(at) if s.getPath().getName().isdigit()), default=0)

    def publish(self, df: DataFrame, after: int | None = None) -> int:
        """Write ``df`` as the version after ``after`` (the one that it was made from; by default the last one now)."""
        number = (self.last() if after is None else after) + 1
        version = f"{self.name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{version}")
        new = self.path(f"{self.dir}/.{version}")
        out = self.fs.create(new, True)
        out.write(bytearray(version.encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(new, self.path(f"{self.dir}/{number:012d}"), self._options())
        except Py4JJavaError as e:
            self.fs.delete(new, False)
            raise RuntimeError(f"version {number} of {self.name} was published by another writer") from e
        return number

    def _options(self):
        """No overwriting: an empty list of rename options."""
        return self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def read(self, number: int | None = None) -> DataFrame:
        number = self.last() if number is None else number
        version = self.spark.read.text(f"{self.dir}/{number:012d}").select(F.trim("value")).first()[0]
        return self.spark.read.parquet(f"{self.root}/{version}")


def publish(df: DataFrame, root: str, name: str, after: int | None = None) -> int:
    """A new version of ``name``; see ``Versions``. Returns its number."""
    return Versions(df.sparkSession, root, name).publish(df, after)


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The version that ``publish`` has put in place last."""
    return Versions(spark, root, name).read()
