"""SQL databases over JDBC.

Only the address and the options are built here; Spark's JDBC source does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# JDBC address prefixes by database type.
PREFIXES = {"mysql": "jdbc:mysql://", "postgres": "jdbc:postgresql://"}


def jdbc_options(
    uri: str | None = None,
    host: str | None = None,
    port: int | str | None = None,
    user: str | None = None,
    password: str | None = None,
    database: str | None = None,
    sql_type: str = "mysql",
) -> dict[str, str]:
    """Connection options from an address, or from its parts.

    A given address is kept and only completed: the database is appended unless it is
    already named.  Credentials travel as options, never inside the address.
    """
    if uri:
        url = uri if uri.startswith("jdbc:") else f"jdbc:{uri}"
        path = url.split("//", 1)[-1].split("?", 1)[0]
        if database and database not in path.split("/")[1:]:
            url = f"{url.rstrip('/')}/{database}"
    else:
        if sql_type not in PREFIXES:
            raise ValueError(f"Unsupported db type:{sql_type}")
        if not host:
            raise ValueError("a host or an address is needed")
        url = f"{PREFIXES[sql_type]}{host}:{port}/{database}"
    options = {"url": url}
    if user:
        options["user"] = user
    if password:
        options["password"] = password
    return options


#: Rows fetched per round trip.
FETCH_ROWS = 10_000


def partition_options(partition_column: str | None, bounds: tuple[int, int] | None, partitions: int | None) -> dict[str, str]:
    """Options that let many tasks read disjoint ranges of a column; all three or none are given."""
    given = [partition_column is not None, bounds is not None, partitions is not None]
    if any(given) and not all(given):
        raise ValueError("a partition column, its bounds and the number of partitions go together")
    if not any(given):
        return {}
    low, high = bounds
    if partitions < 1 or low >= high:
        raise ValueError("bounds have to grow and there is at least one partition")
    return {"partitionColumn": partition_column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}


def read_jdbc(
    spark: SparkSession,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int | None = None,
    predicates: list[str] | None = None,
    one_task: bool = False,
    **connection,
) -> DataFrame:
    """A table or query, read by many tasks.

    They read either ranges of a column (``partition_column``, ``bounds``, ``partitions``; values
    beyond the bounds fall into the outer ranges) or one SQL condition each (``predicates``, which
    together have to cover every row once).  Without either, a read by one task has to be asked for.
    """
    ranges = partition_options(partition_column, bounds, partitions)
    if sum((bool(ranges), bool(predicates), one_task)) != 1:
        raise ValueError("give a partition column with bounds, or predicates, or one_task=True")
    options = jdbc_options(**connection) | {"fetchsize": str(FETCH_ROWS)}
    if predicates:
        url = options.pop("url")
        return spark.read.jdbc(url, table, predicates=predicates, properties=options)
    return spark.read.format("jdbc").options(**options, **ranges).option("dbtable", table).load()


def write_jdbc(df: DataFrame, table: str, mode: str = "append", **connection) -> None:
    df.write.format("jdbc").options(**jdbc_options(**connection)).option("dbtable", table).mode(mode).save()
