"""Name -> query and name -> oracle SQL, gathered from the operator families."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from kiteloom.sources.tables import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Family:
    """Queries of one operator family; ``add`` registers a query with its oracle."""

    name: str
    queries: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = f
            if oracle:
                self.oracles[name] = oracle
            return f

        return keep

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """Register a query in Spark SQL; where both dialects agree, its text is the oracle too."""
        used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for t in used:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
            return spark.sql(text)

        run.__name__ = name
        self.add(name, oracle or text)(run)


def families() -> list[Family]:
    from kiteloom.plans import FAMILIES

    return FAMILIES()


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for family in families():
        clash = found.keys() & family.queries.keys()
        if clash:
            raise ValueError(f"queries {sorted(clash)} are registered twice")
        found |= family.queries
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for family in families():
        found |= family.oracles
    return found
