"""How queries are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provena.tables import spread


class Registry:
    """Queries by name, and the SQL of those that have some."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def put(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return put


#: Tables of texts, vectors and pages, and their keys.
KEYS = {"documents": "doc_id", "embeddings": "vec_id", "pages": "page_id"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(df, KEYS[name]) if name in KEYS else df
