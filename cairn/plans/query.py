"""The query builder: filters, one sort key, skip and limit, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.filters import TypedFields
from cairn.operators.updates import aggregate


class Query:
    """Builds on a collection whose rows an id column names.

    All filters must hold.  The last sort called counts; ties follow the id upwards in
    either direction, and missing values come first upwards and last downwards.  Skip
    applies after the sort and limit after skip; without a sort, the order is the id's.
    """

    def __init__(self, docs: DataFrame, fields=None, id_col: str = "_id"):
        self.docs, self.fields, self.id_col = docs, fields or TypedFields(docs), id_col
        self.filters: list = []
        self.order: tuple[str, bool] | None = None
        self.skipped: int | None = None
        self.most: int | None = None

    def filter(self, *found) -> Query:
        self.filters += found
        return self

    def sort(self, field: str, descending: bool = False) -> Query:
        self.order = (field, descending)
        return self

    def skip(self, n: int) -> Query:
        self.skipped = n
        return self

    def limit(self, n: int) -> Query:
        self.most = n
        return self

    def matching(self) -> DataFrame:
        """The filtered rows, in no order."""
        out = self.docs
        for f in self.filters:
            out = out.where(f.column(self.fields))
        return out

    def execute(self) -> DataFrame:
        out, keys = self.matching(), []
        if self.order:
            field, descending = self.order
            keys = [k.desc() if descending else k.asc() for k in self.fields.sort_keys(field)]
        out = out.orderBy(*keys, F.col(self.id_col).asc())
        if self.skipped:
            out = out.offset(self.skipped)
        return out if self.most is None else out.limit(self.most)

    def aggregate(self, kind: str, column: str | None = None) -> DataFrame:
        return aggregate(self.matching(), kind, column)

    def count(self) -> int:
        return self.matching().count()
