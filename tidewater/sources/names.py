"""One spelling for each company: names that differ only by case, accents or width are the same customer.

The sources compare names by a collation (Unicode, blind to case, accents and width). Here each class of equal names gets one of its
spellings, which from then on is its binary key: a load renames the others first, and all its joins, groups and
first rows stay exact comparisons with hash operators. The spelling is that of a name already loaded, else of
the first source that has one, else the first by bytes, so a later load changes no name that is there.

Only different names are compared by collation, once; sources are joined by exact name with the table of the spellings that change,
which is usually small. Cases: null and empty names stay; blanks count; an empty source has none; equal spellings are never
rows of the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stored

COLLATION = "UNICODE_CI_AI"
#: The columns of sources that name companies, in the order in which spellings count.
NAMES = (
    ("zhique_contact", "related_company"), ("crm_contact", "customer_name"), ("crm_opportunity", "customer_name"), ("key_customer", "key_customer_name"),
    ("marketing_lead", "final_company_name"), ("marketing_lead", "customer_company"), ("marketing_lead", "opp_customer_name"),
    ("crm_lead", "company"), ("crm_opportunity_data", "customer"), ("tianrun_session", "customer_name"),
)
#: Of these a load takes the trimmed names.
TRIMMED = ("crm_lead", "crm_opportunity_data")


def _name(table: str, column: str) -> Column:
    return F.trim(F.col(column)) if table in TRIMMED else F.col(column)


def collated(c: Column) -> Column:
    """The text as the sources compare it; joins and groups on it follow the collation."""
    return F.collate(c, COLLATION)


def spellings(tables: dict[str, DataFrame], known: DataFrame | None = None, names: tuple[tuple[str, str], ...] = NAMES) -> DataFrame:
    """(name, spelling) of the names in tables whose spelling is another one. known: (customer_name) of names already loaded."""
    parts = [tables[t].select(_name(t, c).alias("name"), F.lit(i).alias("rank")) for i, (t, c) in enumerate(names) if t in tables and c in tables[t].columns]
    if known is not None:
        parts.append(known.select(F.col("customer_name").alias("name"), F.lit(-1).alias("rank")))
    every = reduce(lambda a, b: a.unionByName(b), parts).filter(F.col("name").isNotNull() & (F.col("name") != ""))
    once = every.groupBy("name").agg(F.min("rank").alias("rank"))
    alike = Window.partitionBy(collated(F.col("name"))).orderBy("rank", "name")
    return once.select("name", F.first("name").over(alike).alias("spelling")).filter("name <> spelling")


def unified(tables: dict[str, DataFrame], table: DataFrame, names: tuple[tuple[str, str], ...] = NAMES) -> dict[str, DataFrame]:
    """tables with the spellings of table (name, spelling) in place of the names that it has."""
    out = dict(tables)
    new = table.select(F.col("name").alias("__name"), F.col("spelling").alias("__spelling"))
    for t, c in names:
        if t in out and c in out[t].columns:
            out[t] = out[t].join(new, _name(t, c) == F.col("__name"), "left").withColumn(c, F.coalesce("__spelling", F.col(c))).drop("__name", "__spelling")
    return out


def respelled(tables: dict[str, DataFrame], known: DataFrame | None, *others: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], ...]:
    """tables, and others that are parts of them, with one spelling for each company; unchanged where no two names are alike."""
    if not any(t in tables for t, _ in NAMES):
        return tables, *others
    table = stored(spellings(tables, known), "spellings")
    return (tables, *others) if table.isEmpty() else tuple(unified(x, table) for x in (tables, *others))
