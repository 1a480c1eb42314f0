"""Databases over JDBC. The driver jar comes from the user (``spark.jars``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkprep._columns import c, require

# URL forms and default ports per provider.
PROVIDERS = {
    "postgres": ("jdbc:postgresql://{host}:{port}/{database}", 5432),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", 3306),
    "sqlserver": ("jdbc:sqlserver://{host}:{port};databaseName={database}", 1433),
    "oracle": ("jdbc:oracle:thin:@//{host}:{port}/{database}", 1521),
    "snowflake": ("jdbc:snowflake://{host}:{port}/?db={database}", 443),
    "trino": ("jdbc:trino://{host}:{port}/{database}", 8080),
    "bigquery": ("jdbc:bigquery://{host}:{port};ProjectId={database}", 443),
}


def jdbc_url(provider: str, host: str, database: str, port: int | None = None) -> str:
    if provider not in PROVIDERS:
        raise ValueError(f"unknown database {provider!r}; known are {sorted(PROVIDERS)}")
    form, default = PROVIDERS[provider]
    return form.format(host=host, port=port or default, database=database)


def jdbc_options(
    url: str | None = None, provider: str | None = None, host: str | None = None, database: str | None = None,
    port: int | None = None, user: str | None = None, password: str | None = None, driver: str | None = None, **extra,
) -> dict[str, str]:
    """The connection options of Spark's JDBC source, from a URL or from provider, host and database."""
    if url is None:
        if not (provider and host and database):
            raise ValueError("give a url, or provider, host and database")
        url = jdbc_url(provider, host, database, port)
    options = {"url": url, "user": user, "password": password, "driver": driver} | extra
    return {k: str(v) for k, v in options.items() if v is not None}


def _reading(table: str | None, query: str | None, partition: dict | None) -> dict[str, str]:
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    if not partition:
        return {"dbtable": table} if table else {"query": query}
    missing = [k for k in ("partitionColumn", "lowerBound", "upperBound", "numPartitions") if k not in partition]
    if missing:
        raise ValueError(f"a partitioned read needs {missing}")
    # The query option cannot be partitioned, a subquery in place of the table can.
    return {"dbtable": table or f"({query}) q"} | {k: str(v) for k, v in partition.items()}


def read_jdbc(
    spark: SparkSession, table: str | None = None, query: str | None = None, partition: dict | None = None, **connection
) -> DataFrame:
    """A table or query. ``partition`` (partitionColumn, lowerBound, upperBound, numPartitions) reads it in parallel;
    Spark pushes filters and columns down to the database."""
    return spark.read.format("jdbc").options(**jdbc_options(**connection), **_reading(table, query, partition)).load()


def mapped(df: DataFrame, mapping: dict[str, str] | None) -> DataFrame:
    """Keep the mapped columns under their names in the database."""
    if not mapping:
        return df
    return df.select(*[c(n).alias(mapping[n]) for n in require(df, mapping)])


def write_jdbc(
    df: DataFrame, table: str, mapping: dict[str, str] | None = None, if_exists: str = "fail",
    column_types: str | None = None, **connection,
) -> None:
    """Insert into a table. ``if_exists``: fail, replace, append. ``column_types`` is used when the table is made."""
    modes = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}
    if if_exists not in modes:
        raise ValueError("if_exists must be fail, replace or append")
    options = jdbc_options(**connection) | {"dbtable": table}
    if column_types:
        options["createTableColumnTypes"] = column_types
    mapped(df, mapping).write.format("jdbc").options(**options).mode(modes[if_exists]).save()


def read_mongodb(spark: SparkSession, uri: str, database: str, collection: str, limit: int | None = None) -> DataFrame:
    """A collection, with ``_id`` as text. Needs the MongoDB connector for Spark on the classpath."""
    options = {"connection.uri": uri, "database": database, "collection": collection}
    df = spark.read.format("mongodb").options(**options).load()
    if "_id" in df.columns:
        df = df.withColumn("_id", c("_id").cast("string"))
    return df if limit is None else df.limit(limit)
