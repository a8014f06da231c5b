"""Tables of the session's catalog: made if missing, widened, dropped."""

from __future__ import annotations

from pyspark.sql import SparkSession

from strideframe.config import quoted


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def missing_columns(spark: SparkSession, name: str, ddl: str) -> list[str]:
    """Definitions of the columns that a table lacks."""
    known = {c.lower() for c in spark.table(name).columns}
    return [c.strip() for c in ddl.split(",") if c.split()[0].lower() not in known]


def ensure_table(spark: SparkSession, name: str, ddl: str, *, partition_by: tuple[str, ...] = ()) -> list[str]:
    """Makes a Parquet table (``ddl``: columns, with blanks between name and type) if there is none, else adds the columns that it lacks; returns the added definitions."""
    columns = [(c.split()[0], c.split()[1]) for c in ddl.split(",")]
    parts = ", ".join(quoted(p) for p in partition_by)
    made = ", ".join(f"{quoted(n)} {t}" for n, t in columns)
    if not table_exists(spark, name):
        spark.sql(f"CREATE TABLE {quoted(name)} ({made}) USING parquet" + (f" PARTITIONED BY ({parts})" if parts else ""))
        return []
    added = missing_columns(spark, name, ddl)
    if added:
        spark.sql(f"ALTER TABLE {quoted(name)} ADD COLUMNS ({', '.join(f'{quoted(c.split()[0])} {c.split()[1]}' for c in added)})")
    return added


def drop_tables(spark: SparkSession, names: list[str]) -> None:
    """Drops tables; those that don't exist are no error."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")
