"""Histories that batches and streams write into: one row a key, idempotent, with compare-and-set.

A history is a folder of whole snapshots. A change writes the next snapshot beside the last and then creates one small
commit file that must not exist yet; whoever comes second finds it there, drops what they wrote and starts again from the
newer snapshot. Readers follow the last commit, so they never see half a change, and a lost executor only repeats tasks of
a write that isn't committed. Every change rewrites the history, which suits histories of what was published (small beside
what was read); earlier snapshots go after two more changes."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .stored import remove

# Characters that are kept of each field.
TITLE, STORY_KEY, IMAGE_URL = 512, 64, 1024


class History:
    def __init__(self, spark: SparkSession, root: str, schema: str, key: str):
        """``schema`` in DDL; ``key`` is one of its columns."""
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)

    def _commits(self) -> list[int]:
        at = self._path(self.root)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"commit-(\d+)", n)))

    def _commit(self, n: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/commit-{n}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self) -> DataFrame:
        commits = self._commits()
        if not commits:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{self._commit(commits[-1])['data']}")

    def _change(self, make: Callable[[DataFrame], DataFrame], writer: str | None, batch: int | None) -> bool:
        while True:
            commits = self._commits()
            last = self._commit(commits[-1]) if commits else {"batches": {}}
            if writer is not None and batch is not None and last["batches"].get(writer, -1) >= batch:
                return False
            data = f"data-{uuid.uuid4().hex}"
            make(self.read()).write.parquet(f"{self.root}/{data}")
            new = {"data": data, "batches": last["batches"] | ({writer: batch} if writer is not None and batch is not None else {})}
            if self._create(f"{self.root}/commit-{commits[-1] + 1 if commits else 0}", json.dumps(new)):
                for n in commits[:-2]:
                    remove(self.spark, f"{self.root}/{self._commit(n)['data']}", f"{self.root}/commit-{n}")
                return True
            remove(self.spark, f"{self.root}/{data}")

    def _create(self, path: str, text: str) -> bool:
        try:
            stream = self._fs.create(self._path(path), False)
        except Exception:
            if self._fs.exists(self._path(path)):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def upsert(self, rows: DataFrame, order: list[Column], writer: str | None = None, batch: int | None = None) -> bool:
        """Put rows in place of those of the same key; of several of one key the last by ``order`` counts. Rows without a
        key don't. With ``writer`` and ``batch``, a batch that was taken before changes nothing: then False."""
        names = [f.name for f in self.read().schema]
        fresh = rows.where(F.col(self.key).isNotNull() & (F.col(self.key) != "")).withColumn("_order", F.struct(*order))
        latest = fresh.groupBy(self.key).agg(*(F.max_by(n, "_order").alias(n) for n in names if n != self.key)).select(*names)
        return self._change(lambda old: old.join(latest, self.key, "left_anti").select(*names).unionByName(latest), writer, batch)

    def sink(self, order: list[Column], writer: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: a batch that is repeated after a failure is taken once."""
        return lambda rows, batch: self.upsert(rows, order, writer, batch) and None

    def claim(self, claims: DataFrame, status: str, expected: str, taken: str, by: str, order: list[Column]) -> DataFrame:
        """Compare and set: rows in status ``expected`` go to ``taken`` for the first claimant (column ``by``) by ``order``.
        Returns the claims that won; a key that isn't there, or is in another status, is nobody's."""
        first = claims.withColumn("_order", F.struct(*order)).groupBy(self.key).agg(F.min_by(by, "_order").alias("_by"))
        token = f"{uuid.uuid4().hex}:"

        def change(old: DataFrame) -> DataFrame:
            names = old.columns
            rows = old.join(first, self.key, "left").withColumn("_won", F.col("_by").isNotNull() & (F.col(status) == expected))
            return rows.withColumns({status: F.when(F.col("_won"), taken).otherwise(F.col(status)), by: F.when(F.col("_won"), F.concat(F.lit(token), "_by")).otherwise(F.col(by))}).select(*names)

        self._change(change, None, None)
        won = self.read().where(F.col(by).startswith(token)).select(self.key, F.substring(F.col(by), F.lit(len(token) + 1), F.length(by)).alias(by))
        return claims.join(won, [self.key, by], "left_semi")


def published_rows(rows: DataFrame) -> DataFrame:
    """url in normal form, title, story_key, image_url (each trimmed and cut), published_at; rows without a url go."""
    cut = lambda c, n: F.left(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(n)).alias(c)
    return rows.select(X.normalise_url("url").alias("url"), cut("title", TITLE), cut("story_key", STORY_KEY), cut("image_url", IMAGE_URL), "published_at").where("url <> ''")


def recently_failed(history: DataFrame, now: Column, minutes: int = 360) -> DataFrame:
    """Urls (in normal form) whose last record is a failure within the span."""
    return history.where((F.col("status") == "failed") & (F.col("ts") >= now - F.expr(f"INTERVAL {minutes} MINUTES"))).select("url")
