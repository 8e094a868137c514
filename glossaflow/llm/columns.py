"""Working columns that no column of a caller's table can meet, and orders of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from glossaflow.plans.scratch import stage_table


def apart(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def is_integral(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, IntegralType)


def numbers_of(keys: DataFrame, name: str, nulls_first: bool = False) -> DataFrame:
    """The distinct rows of ``keys`` with a number each, in their order by the first column, then the others."""
    first, *others = keys.columns
    by = F.col(first).asc_nulls_first() if nulls_first else F.col(first).asc_nulls_last()
    return stage_table(keys.distinct().orderBy(by, *others).withColumn(name, F.monotonically_increasing_id()), "numbers")


def numbered(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str, DataFrame]:
    """Documents under integer ids of the same order, the column of these ids, and each of them once (doc_id, text).

    Rows of one id and text are one document. Rows without an id come last.
    """
    order, i, h = apart(docs, "order", "i", "h")
    if is_integral(docs, doc_id):
        n = docs.agg(F.count("*").alias("all"), F.countDistinct(doc_id).alias("known")).first()
        if n["all"] == n["known"]:
            docs = docs.withColumn(order, F.col(doc_id).cast("long"))
            return docs, order, docs.select(F.col(order).alias("doc_id"), F.col(text).alias("text"))
    keyed = docs.select("*", F.col(doc_id).alias(i), F.xxhash64(text).alias(h))
    numbers = numbers_of(keyed.select(i, h), order)
    met = keyed[i].eqNullSafe(numbers[i]) & (keyed[h] == numbers[h])
    docs = keyed.join(numbers, met).select(*[keyed[c] for c in docs.columns], order)
    return docs, order, docs.select(F.col(order).alias("doc_id"), F.col(text).alias("text")).dropDuplicates(["doc_id"])
