"""Query registration: a Spark plan and, where SQL can say it, the SQL text next to it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.bindings import Tables
from .oracle_views import VIEWS

DIGITS = 6


@dataclass
class Query:
    name: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None
    doubles: list[str] = field(default_factory=list)
    covers: str = ""
    digits: int = DIGITS

    def run(self, spark: SparkSession, path: str) -> DataFrame:
        return tidy(self.plan(Tables(spark, path)), self.digits)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        text = with_views(self.sql)
        if not self.doubles:
            return text
        parts = ", ".join(f"round({c}::DOUBLE, {self.digits}) + 0.0 AS {c}" for c in self.doubles)
        return f"SELECT * REPLACE ({parts}) FROM ({text}) q"


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to a fixed number of digits, so that summation order cannot show."""
    cols = [
        (F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def with_views(sql: str) -> str:
    """Prepend the view definitions the text refers to, in dependency order."""
    need: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\bv_\w+", todo.pop()))
        for w in words & VIEWS.keys() - need:
            need.add(w)
            todo.append(VIEWS[w])
    body = sql.strip()
    ctes = [f"{n} AS ({q})" for n, q in VIEWS.items() if n in need]
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body[5:]
    return "WITH " + ", ".join(ctes) + " " + body


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, doubles: str = "", covers: str = "", digits: int = DIGITS):
    """Register a plan with its SQL; `digits` is raised where values are short decimals that would end in a five at the last digit."""

    def add(plan):
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(name, plan, sql, doubles.split(), covers, digits)
        return plan

    return add


def words(items: list[str]) -> str:
    return "|".join(items)
