"""Collections of JSON documents with derived secondary indexes."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.errors import CollectionNotFound, IndexNotFound, InvalidDocument, TransactionClosed, UniqueConstraintViolation
from cairn.operators import indexes, versions
from cairn.operators.filters import JsonFields, forced_match
from cairn.plans.query import Query
from cairn.sources.segments import SegmentStore

FIELDS = JsonFields("doc")


def prepared(doc: dict) -> tuple[str, str]:
    """Id and text of a document; without an id it gets a random one."""
    if not isinstance(doc, dict):
        raise InvalidDocument("a document is a JSON object")
    if "_id" in doc and not isinstance(doc["_id"], str):
        raise InvalidDocument("_id must be a string")
    doc = {"_id": str(uuid.uuid4())} | doc
    return doc["_id"], json.dumps(doc, sort_keys=True, ensure_ascii=False)


class DocStore:
    """One segment store per collection and one whose manifest is the catalogue.

    Inserting validates first and writes then, so what is turned away is not stored.
    Indexes are derived from the documents: a new one covers all that is stored.  Scans
    and queries of an unknown collection are empty; index operations raise.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.catalog = SegmentStore(spark, f"{self.path}/catalog", "string", "string")
        self.stores: dict[str, SegmentStore] = {}

    # -- collections and indexes

    def collections(self) -> dict[str, dict]:
        return self.catalog.extra

    def _save(self, name: str, entry: dict | None) -> None:
        rest = {k: v for k, v in self.catalog.extra.items() if k != name}
        self.catalog.set_extra(rest | ({name: entry} if entry else {}))

    def create_collection(self, name: str, indexes: list[dict] | None = None) -> None:
        """Does nothing if the collection exists."""
        if name not in self.collections():
            self._save(name, {"created_at": int(time.time()), "indexes": indexes or [], "folder": uuid.uuid4().hex})

    def drop_collection(self, name: str) -> None:
        if name in self.collections():
            self._save(name, None)
            self.stores.pop(name, None)

    def _entry(self, name: str) -> dict:
        if name not in self.collections():
            raise CollectionNotFound(name)
        return self.collections()[name]

    def store(self, name: str) -> SegmentStore:
        entry = self._entry(name)
        if name not in self.stores:
            self.stores[name] = SegmentStore(self.spark, f"{self.path}/collections/{entry['folder']}", "string", "string")
        return self.stores[name]

    def create_index(self, name: str, field: str, unique: bool = False) -> None:
        entry = self._entry(name)
        self._save(name, entry | {"indexes": [x for x in entry["indexes"] if x["field"] != field] + [{"field": field, "unique": unique}]})

    def drop_index(self, name: str, field: str) -> None:
        entry = self._entry(name)
        if not entry["indexes"]:
            raise IndexNotFound(f"{name} has no indexes")
        self._save(name, entry | {"indexes": [x for x in entry["indexes"] if x["field"] != field]})

    def list_indexes(self, name: str) -> list[dict]:
        return self._entry(name)["indexes"]

    def _index(self, name: str, field: str) -> dict:
        for x in self.list_indexes(name):
            if x["field"] == field:
                return x
        raise IndexNotFound(f"{name} has no index on {field}")

    # -- writing

    def insert(self, name: str, docs: dict | list[dict] | DataFrame) -> list[str] | None:
        """Insert or replace documents; a DataFrame has columns _id and doc (JSON text).

        Returns the ids of documents given as Python objects.
        """
        ids = None
        if not isinstance(docs, DataFrame):
            rows = dict(prepared(d) for d in (docs if isinstance(docs, list) else [docs]))
            ids = list(rows)
            docs = self.spark.createDataFrame(list(rows.items()), "_id string, doc string")
        self.check_unique(name, docs, self.scan(name))
        self.store(name).append_at_once(docs.select(F.col("_id").alias("key"), F.col("doc").alias("value")))
        return ids

    def check_unique(self, name: str, batch: DataFrame, existing: DataFrame) -> None:
        for x in self.list_indexes(name):
            if x["unique"]:
                kept = existing.join(batch.select("_id").distinct(), "_id", "left_anti")  # replaced documents don't count
                found = indexes.violations(batch, kept, FIELDS.text(x["field"]))
                rows = [(r["_id"], x["field"], r["value"]) for r in found.select("_id", "value").take(100)]
                if rows:
                    raise UniqueConstraintViolation(f"{name}.{x['field']}: {rows[0][2]} is taken", rows)

    def delete(self, name: str, doc_id: str) -> None:
        self.store(name).append_at_once(self.spark.createDataFrame([(doc_id, None)], "key string, value string"))

    def delete_prefix(self, name: str, prefix: str) -> None:
        store = self.store(name)
        store.append(versions.without_prefix(store.log(), prefix, store.next_seq), store.next_seq + 1)

    # -- reading

    def scan(self, name: str, before: int | None = None) -> DataFrame:
        """_id and doc of the live documents."""
        if name not in self.collections():
            return self.spark.createDataFrame([], "_id string, doc string")
        return versions.latest(self.store(name).log(), before).select(F.col("key").alias("_id"), F.col("value").alias("doc"))

    def get(self, name: str, doc_id: str) -> dict | None:
        row = self.scan(name).where(F.col("_id") == doc_id).first()
        return None if row is None else json.loads(row["doc"])

    def query(self, name: str) -> Query:
        return Query(self.scan(name), FIELDS)

    def typed(self, name: str, schema: str) -> DataFrame:
        """Documents as columns."""
        return self.scan(name).select(F.from_json("doc", schema).alias("d")).select("d.*")

    def get_by_index(self, name: str, field: str, value, prefix: bool | None = None, docs: DataFrame | None = None) -> DataFrame:
        """Documents by indexed value, compared as text; a non-unique index also finds
        values that begin with it unless ``prefix`` is False."""
        unique = self._index(name, field)["unique"]
        text = value if isinstance(value, str) else json.dumps(value)
        found = indexes.lookup(self.scan(name) if docs is None else docs, FIELDS.text(field), text, not unique if prefix is None else prefix)
        return found.orderBy("_id")

    def get_by_field_forced(self, name: str, field: str, value) -> DataFrame:
        return forced_match(self.scan(name), FIELDS, field, value).orderBy("_id")

    def begin(self) -> DocTransaction:
        return DocTransaction(self)


class DocTransaction:
    """Snapshot reads of all collections under a buffer of inserts and deletes; commit
    writes each collection's in one go, the last to commit wins."""

    def __init__(self, store: DocStore):
        self.store = store
        self.at = {name: store.store(name).next_seq for name in store.collections()}
        self.buffer: dict[str, dict[str, str | None]] | None = {}

    def _buffered(self, name: str) -> dict[str, str | None]:
        if self.buffer is None:
            raise TransactionClosed("this transaction has ended")
        return self.buffer.setdefault(name, {})

    def scan(self, name: str) -> DataFrame:
        rows = self._buffered(name)
        base = self.store.scan(name, self.at.get(name, 0)).select(F.col("_id").alias("key"), F.col("doc").alias("value"))
        seen = versions.overlay(base, self.store.spark.createDataFrame(list(rows.items()), "key string, value string")) if rows else base
        return seen.select(F.col("key").alias("_id"), F.col("value").alias("doc"))

    def insert(self, name: str, doc: dict) -> str:
        doc_id, text = prepared(doc)
        batch = self.store.spark.createDataFrame([(doc_id, text)], "_id string, doc string")
        self.store.check_unique(name, batch, self.scan(name))
        self._buffered(name)[doc_id] = text
        return doc_id

    def delete(self, name: str, doc_id: str) -> None:
        self._buffered(name)[doc_id] = None

    def get(self, name: str, doc_id: str) -> dict | None:
        rows = self._buffered(name)
        if doc_id in rows:
            return json.loads(rows[doc_id]) if rows[doc_id] else None
        row = self.scan(name).where(F.col("_id") == doc_id).first()
        return json.loads(row["doc"]) if row else None

    def query(self, name: str) -> Query:
        return Query(self.scan(name), FIELDS)

    def get_by_index(self, name: str, field: str, value, prefix: bool | None = None) -> DataFrame:
        return self.store.get_by_index(name, field, value, prefix, self.scan(name))

    def get_by_field_forced(self, name: str, field: str, value) -> DataFrame:
        return forced_match(self.scan(name), FIELDS, field, value).orderBy("_id")

    def commit(self) -> None:
        buffered, self.buffer = self.buffer, None
        if buffered is None:
            raise TransactionClosed("this transaction has ended")
        for name, rows in buffered.items():
            if rows:
                self.store.store(name).append_at_once(self.store.spark.createDataFrame(list(rows.items()), "key string, value string"))

    def abort(self) -> None:
        if self.buffer is None:
            raise TransactionClosed("this transaction has ended")
        self.buffer = None
