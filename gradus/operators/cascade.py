"""Deleting rows and everything that refers to them (A-12)."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import written


class Reference(NamedTuple):
    """Rows of `child` go with the rows of `parent` that have the same values in the columns named by position."""

    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


def doomed(tables: dict[str, DataFrame], keys: dict[str, list[str]], references: list[Reference], gone: dict[str, DataFrame], rounds: int = 1000) -> dict[str, DataFrame]:
    """The rows that go with the rows `gone` (tables of keys): references are followed, also around cycles, until nothing new goes. Only keys
    travel; each round joins the rows that went in the last one. Raises if `rounds` are not enough."""
    front = {t: written(tables[t].join(k.select(*keys[t]).distinct(), keys[t], "left_semi")) for t, k in gone.items()}
    out: dict[str, DataFrame] = dict(front)
    for _ in range(rounds):
        found: dict[str, list[DataFrame]] = {}
        for r in references:
            if r.parent in front:
                on = [F.col(f"c.{a}") == F.col(f"p.{b}") for a, b in zip(r.columns, r.parent_columns, strict=True)]
                hit = tables[r.child].alias("c").join(front[r.parent].select(*r.parent_columns).alias("p"), on, "left_semi")
                found.setdefault(r.child, []).append(hit if r.child not in out else hit.join(out[r.child].select(*keys[r.child]), keys[r.child], "left_anti"))
        front = {t: written(reduce(DataFrame.unionByName, parts).dropDuplicates(keys[t])) for t, parts in found.items()}
        front = {t: rows for t, rows in front.items() if rows.take(1)}
        if not front:
            return out
        out |= {t: rows if t not in out else out[t].unionByName(rows) for t, rows in front.items()}
    raise RuntimeError(f"references did not settle in {rounds} rounds")


def delete(tables: dict[str, DataFrame], keys: dict[str, list[str]], references: list[Reference], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left of every table."""
    lost = doomed(tables, keys, references, gone)
    return {t: rows if t not in lost else rows.join(lost[t].select(*keys[t]), keys[t], "left_anti") for t, rows in tables.items()}
