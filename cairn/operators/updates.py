"""Updates, aggregates and validation over collections."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, batch: DataFrame, id_col: str) -> DataFrame:
    """``base`` with the rows of ``batch`` in place of those of equal id.  One shuffle:
    both sides in a union, the newer row of each id by max_by."""
    columns = base.columns
    row = F.struct(*[F.col(c) for c in columns])
    both = base.select(F.col(id_col).alias("_key"), row.alias("_row"), F.lit(0).alias("_turn")).unionByName(batch.select(F.col(id_col).alias("_key"), row.alias("_row"), F.lit(1).alias("_turn")))
    return both.groupBy("_key").agg(F.max_by("_row", "_turn").alias("_row")).select("_row.*")


def delete(base: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return base.join(ids.select(id_col).distinct(), id_col, "left_anti")


def set_where(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def increment(df: DataFrame, column: str, by: float, where: Column | None = None) -> DataFrame:
    return set_where(df, F.lit(True) if where is None else where, {column: F.col(column) + F.lit(by)})


def unset(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*columns)


def push(df: DataFrame, column: str, value: Column, where: Column | None = None) -> DataFrame:
    return set_where(df, F.lit(True) if where is None else where, {column: F.array_append(F.col(column), value)})


def set_path(df: DataFrame, path: str, value: Column) -> DataFrame:
    """Set a dotted path within a struct column."""
    top, _, rest = path.partition(".")
    return df.withColumn(top, F.col(top).withField(rest, value) if rest else value)


def replace_versioned(base: DataFrame, batch: DataFrame, id_col: str, version: str = "_v") -> tuple[DataFrame, DataFrame]:
    """Optimistic locking: rows of ``batch`` whose ``expected`` is the stored version
    are applied with the next one; the others are returned as conflicts."""
    current = base.select(F.col(id_col), F.col(version).alias("current"))
    checked = batch.join(current, id_col, "left")
    good = checked.where(F.col("current") == F.col("expected")).withColumn(version, F.col("current") + 1)
    conflicts = checked.where(~F.coalesce(F.col("current") == F.col("expected"), F.lit(False)))
    return upsert(base, good.select(*base.columns), id_col), conflicts.select(id_col, "expected", "current")


AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def aggregate(df: DataFrame, kind: str, column: str | None = None) -> DataFrame:
    value = F.count(F.lit(1)) if kind == "count" and column is None else AGGREGATES[kind](F.col(column))
    return df.agg(value.alias(kind))


@dataclass
class Rule:
    """Constraints of one field."""

    name: str
    required: bool = False
    kind: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    least: float | None = None
    most: float | None = None
    one_of: list = field(default_factory=list)

    def broken(self) -> dict[str, Column]:
        c = F.col(self.name)
        found = {}
        if self.required:
            found["required"] = c.isNull()
        if self.kind:
            found["type"] = c.isNotNull() & F.expr(f"try_cast(`{self.name}` AS {self.kind})").isNull()
        if self.min_length is not None:
            found["min_length"] = F.char_length(c) < self.min_length
        if self.max_length is not None:
            found["max_length"] = F.char_length(c) > self.max_length
        if self.pattern:
            found["pattern"] = ~c.rlike(self.pattern)
        if self.least is not None:
            found["min"] = c < self.least
        if self.most is not None:
            found["max"] = c > self.most
        if self.one_of:
            found["enum"] = ~c.isin(*self.one_of)
        return {k: F.coalesce(v, F.lit(False)) for k, v in found.items()}


def schema_violations(df: DataFrame, id_col: str, rules: list[Rule]) -> DataFrame:
    """id, field and rule of everything that a row breaks, in one pass."""
    checks = [F.when(v, F.struct(F.lit(r.name).alias("field"), F.lit(k).alias("rule"))) for r in rules for k, v in r.broken().items()]
    return df.select(id_col, F.explode(F.array_compact(F.array(*checks))).alias("x")).select(id_col, "x.field", "x.rule")


def stamped(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Documents with version 1 and times of creation and change."""
    now = F.unix_timestamp() if now is None else now
    return df.withColumns({"_v": F.lit(1).cast("long"), "_created_at": now, "_updated_at": now})


def restamped(df: DataFrame, now: Column | None = None) -> DataFrame:
    now = F.unix_timestamp() if now is None else now
    return df.withColumns({"_v": F.col("_v") + 1, "_updated_at": now})


def without_system(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Without columns whose name begins with an underscore."""
    keep = set(keep)
    return df.drop(*[c for c in df.columns if c.startswith("_") and c not in keep])
