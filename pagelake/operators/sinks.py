"""Record sinks: text, JSON, CSV and JDBC tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.operators.extract import pick
from pagelake.session import remove_folder, write_through

# Per database the URL prefix, default port and driver. Spark's own dialects turn the
# string columns written here into TEXT (SQLite, Postgres) or LONGTEXT (MySQL).
DATABASES = {
    "sqlite": {"prefix": "jdbc:sqlite:", "port": None, "driver": "org.sqlite.JDBC"},
    "mysql": {"prefix": "jdbc:mysql://", "port": 3306, "driver": "com.mysql.cj.jdbc.Driver"},
    "postgres": {"prefix": "jdbc:postgresql://", "port": 5432, "driver": "org.postgresql.Driver"},
}


def _json_text(value: Column) -> Column:
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def cell_json(c: Column) -> Column:
    return (
        F.when(c.kind == "list", F.to_json(c.xs))
        .when((c.kind == "null") | c.s.isNull(), "null")
        .otherwise(_json_text(c.s))
    )


def record_json(record: Column) -> Column:
    """A record as one JSON object, fields in record order, absent images as null."""
    members = F.transform(record, lambda c: F.concat(_json_text(c.field), F.lit(":"), cell_json(c)))
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def cell_text(c: Column) -> Column:
    """Cell of a flat table: missing as empty text, lists as JSON."""
    return F.when(c.kind == "list", F.to_json(c.xs)).otherwise(F.coalesce(c.s, F.lit("")))


def column_union(records: DataFrame, order: list[str], record: str = "record") -> DataFrame:
    """Distinct field names with the first place each is seen (by ``order`` columns, then position)."""
    cells = records.select(*order, F.posexplode(record).alias("_field_no", "_cell"))
    return cells.groupBy(F.col("_cell.field").alias("field")).agg(F.min(F.struct(*order, "_field_no")).alias("first_seen"))


def column_names(records: DataFrame, order: list[str], record: str = "record") -> list[str]:
    """Field names in first-seen order. Only the names come to the driver: they are a table's columns.

    Names come from model replies, so this suits tables of records that were planned together. A caller that
    knows the columns passes them to the writers instead."""
    return [row.field for row in column_union(records, order, record).orderBy("first_seen").select("field").collect()]


def to_wide(records: DataFrame, fields: list[str], keys: list[str] | None = None, record: str = "record") -> DataFrame:
    """One text column per field, in the given order; a projection, no pivot."""
    cells = [F.coalesce(cell_text(pick(F.col(record), f)), F.lit("")).alias(f) for f in fields]
    return records.select(*(keys or []), *cells)


def write_text(records: DataFrame, path: str, record: str = "record") -> None:
    """One JSON object per line."""
    records.select(record_json(F.col(record)).alias("value")).write.mode("overwrite").text(path)


def write_json(records: DataFrame, path: str, fields: list[str], record: str = "record") -> None:
    """JSON files with lists kept as lists; line-delimited, so they stay splittable."""
    def one(field: str) -> Column:
        c = pick(F.col(record), field)
        return F.parse_json(cell_json(c)).alias(field)

    records.select(*[one(f) for f in fields]).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _named(records: DataFrame, order: list[str], fields: list[str] | None, record: str, folders: list[str]) -> tuple[DataFrame, list[str]]:
    """The records and their field names. Unless the caller knows the names, the records are written once and read for both."""
    if fields is not None:
        return records, fields
    records = write_through(records.select(*order, record), "records", folders)
    return records, column_names(records, order, record)


def write_csv(records: DataFrame, path: str, order: list[str], record: str = "record", fields: list[str] | None = None) -> bool:
    """CSV files with a header over the union of fields; nothing is written for no records."""
    records, fields = _named(records, order, fields, record, folders := [])
    if fields:
        _write_csv(to_wide(records, fields, record=record), path)
    for folder in folders:
        remove_folder(records.sparkSession, folder)
    return bool(fields)


def _write_csv(wide: DataFrame, path: str) -> None:
    wide.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def jdbc_options(
    kind: str, database: str, table: str = "records", host: str = "localhost", port: int | None = None,
    user: str | None = None, password: str | None = None,
) -> dict[str, str]:
    """Options of ``DataFrameWriter.format("jdbc")`` for one of the supported databases."""
    known = DATABASES[kind]
    if known["port"] is None:
        url = f"{known['prefix']}{database}"
    else:
        url = f"{known['prefix']}{host}:{port or known['port']}/{database}"
    options = {"url": url, "dbtable": quote_name(kind, table), "driver": known["driver"]}
    if user is not None:
        options["user"] = user
    if password is not None:
        options["password"] = password
    return options


def quote_name(kind: str, name: str) -> str:
    mark = "`" if kind == "mysql" else '"'
    return f"{mark}{name.replace(mark, mark * 2)}{mark}"


def write_jdbc(
    records: DataFrame, options: dict[str, str], order: list[str], record: str = "record",
    connections: int = 8, fields: list[str] | None = None,
) -> bool:
    """Append to a table, created when missing with text columns; nothing happens for no records.

    A table that lacks a new column makes the write fail, as its schema never changes. Each task
    commits its own rows: write to a staging table where all or nothing is needed.
    """
    records, fields = _named(records, order, fields, record, folders := [])
    if fields:
        # Databases bound the writers they take. The rows are written first, so that only the writing has so few tasks.
        wide = write_through(to_wide(records, fields, record=record), "wide", folders)
        wide.coalesce(connections).write.format("jdbc").options(**options).mode("append").save()
    for folder in folders:
        remove_folder(records.sparkSession, folder)
    return bool(fields)


def write_run_document(runs: DataFrame, summary: DataFrame, path: str) -> None:
    """Runs and their summary side by side as JSON files."""
    runs.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/runs")
    summary.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/summary")
