"""Tables as one owner may see them (B-17): every read carries the owner's filter, and there is no read without an owner."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views

#: Views by owner's column; tables that everyone reads have none.
OWNERS: dict[str, tuple[str | None, Callable[[SparkSession, str], DataFrame]]] = {
    "attempts": ("user_id", views.attempts),
    "sessions": ("user_id", views.sessions),
    "events": ("user_id", lambda spark, sf_dir: views.table(spark, sf_dir, "events")),
    "orders": ("o_custkey", lambda spark, sf_dir: views.table(spark, sf_dir, "orders")),
    "nodes": ("owner", views.nodes),
    "parts": (None, lambda spark, sf_dir: views.table(spark, sf_dir, "part")),
    "benchmark": (None, lambda spark, sf_dir: views.table(spark, sf_dir, "benchmark")),
}


class Owned:
    """The catalogue of one owner. Owned rows can be read and written, shared tables only read."""

    def __init__(self, spark: SparkSession, sf_dir: str, owner: int):
        if owner is None:
            raise PermissionError("no owner is given")
        self.spark, self.sf_dir, self.owner = spark, sf_dir, owner

    def read(self, name: str) -> DataFrame:
        if name not in OWNERS:
            raise PermissionError(f"{name} has no rule of ownership")
        column, view = OWNERS[name]
        rows = view(self.spark, self.sf_dir)
        return rows if column is None else rows.where(F.col(column) == F.lit(self.owner))

    def checked(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows that are to be written to a view: the job fails at the first that is not the owner's."""
        column = OWNERS.get(name, (None, None))[0]
        if column is None:
            raise PermissionError(f"{name} is not the owner's to write")
        own = F.col(column).eqNullSafe(F.lit(self.owner))
        return rows.withColumn(column, F.when(own, F.col(column)).otherwise(F.raise_error(F.lit(f"a row of {name} belongs to someone else"))))
