"""A change log as immutable Parquet segments under a manifest.

A segment is sorted by key and falling sequence number, so that file and row-group
statistics and a Bloom filter on the key let point and range reads skip most of it.  A
manifest names the segments that count; publishing the next one is a rename that fails
if it exists, so a commit is seen whole or not at all and two writers can't both win.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.errors import CommitConflict, CorruptFile

LOG_SCHEMA = "key {key}, seq bigint, value {value}"


class SegmentStore:
    """``path`` may be any URI that Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, path: str, key_type: str = "binary", value_type: str = "binary"):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = LOG_SCHEMA.format(key=key_type, value=value_type)
        self.lock = threading.RLock()
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.path).getFileSystem(conf)
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self._options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self.fs.mkdirs(self._path(f"{self.path}/manifest"))
        self.reload()

    # -- manifest

    def reload(self) -> None:
        """Read the newest manifest; a new store begins empty at sequence number 0."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.path}/manifest"))]
        versions = sorted(int(n) for n in names if n.isdigit())
        if not versions:
            self.version, self.state = -1, {"next_seq": 0, "segments": [], "extra": {}}
            return
        self.version = versions[-1]
        stream = self.fs.open(self._path(f"{self.path}/manifest/{self.version:020d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            self.state = json.loads(text)
        except ValueError as e:
            raise CorruptFile(f"manifest {self.version} can't be read") from e

    def _publish(self, state: dict) -> None:
        draft = self._path(f"{self.path}/manifest/draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        try:
            self.context.rename(draft, self._path(f"{self.path}/manifest/{self.version + 1:020d}"), self._options)
        except Exception as e:
            self.fs.delete(draft, False)
            raise CommitConflict(f"version {self.version + 1} is another writer's") from e
        self.version, self.state = self.version + 1, state

    @property
    def next_seq(self) -> int:
        return self.state["next_seq"]

    @property
    def extra(self) -> dict:
        return self.state["extra"]

    def set_extra(self, extra: dict) -> None:
        with self.lock:
            self._publish(self.state | {"extra": extra})

    # -- data

    def log(self) -> DataFrame:
        dirs = [f"{self.path}/{s['dir']}" for s in self.state["segments"]]
        return self.spark.read.schema(self.schema).parquet(*dirs) if dirs else self.spark.createDataFrame([], self.schema)

    def _write(self, log: DataFrame) -> str:
        name = f"segments/{uuid.uuid4().hex}"
        writer = log.select("key", "seq", "value").sortWithinPartitions("key", F.desc("seq")).write
        writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.max.bytes", 1 << 20).parquet(f"{self.path}/{name}")
        return name

    def append(self, log: DataFrame, next_seq: int) -> None:
        """Add rows (key, seq, value) in one commit."""
        with self.lock:
            name = self._write(log)
            self._publish(self.state | {"next_seq": max(next_seq, self.next_seq), "segments": [*self.state["segments"], {"dir": name}]})

    def append_at_once(self, rows: DataFrame) -> int:
        """Add (key, value) rows, all at one new sequence number, which is returned."""
        with self.lock:
            seq = self.next_seq
            self.append(rows.select("key", F.lit(seq).cast("long").alias("seq"), "value"), seq + 1)
            return seq

    def replace(self, log: DataFrame, parts: int | None = None) -> None:
        """Put one segment in place of all, range-partitioned by key."""
        with self.lock:
            parts = parts or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            name = self._write(log.repartitionByRange(parts, "key"))
            self._publish(self.state | {"segments": [{"dir": name}]})

    def vacuum(self) -> list[str]:
        """Delete segments that the newest manifest doesn't name; no reader may use them."""
        with self.lock:
            live = {s["dir"].rpartition("/")[2] for s in self.state["segments"]}
            folder, gone = self._path(f"{self.path}/segments"), []
            for s in self.fs.listStatus(folder) if self.fs.exists(folder) else ():
                if s.getPath().getName() not in live:
                    self.fs.delete(s.getPath(), True)
                    gone.append(s.getPath().getName())
            return gone
