"""Management commands (``.create table …``) on the Spark catalog.

Commands that change stored rows (drop or retype a column, delete records) rewrite the table into a new folder and
then swap names, so that a failure leaves the old table as it was.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright import types as K
from pipewright.functions import QueryError
from pipewright.lang import parse_script
from pipewright.lang.parser import Parser
from pipewright.sources import readers

if TYPE_CHECKING:
    from pipewright.engine import Engine

_NAME = r"(?:\['([^']+)'\]|\[\"([^\"]+)\"\]|([A-Za-z_][\w.]*))"
_COMMANDS: list[tuple[re.Pattern, Callable]] = []


def command(pattern: str) -> Callable:
    """Registers a handler; ``NAME`` in the pattern is a table, column or function name (one group)."""
    text = pattern.replace("NAME", r"(\['[^']+'\]|\[\"[^\"]+\"\]|[A-Za-z_][\w.]*)").replace(" ", r"\s+")
    compiled = re.compile(r"\." + text + r"\s*$", re.S | re.I)

    def add(f: Callable) -> Callable:
        _COMMANDS.append((compiled, f))
        return f

    return add


def bare(name: str) -> str:
    return name[2:-2] if name.startswith("[") else name


def quoted(name: str) -> str:
    return "`" + bare(name).replace("`", "``") + "`"


def columns_of(text: str) -> list[tuple[str, str]]:
    """``a:long, b:string`` as pairs."""
    p = Parser(f"({text})")
    return p.columns()


def done(engine: Engine, message: str, **more: Any) -> DataFrame:
    row = Row(Result=message, **{k: str(v) for k, v in more.items()})
    return engine.spark.createDataFrame([row])


def rows(engine: Engine, values: list[tuple], schema: str) -> DataFrame:
    return engine.spark.createDataFrame(values, schema)


def run_command(engine: Engine, text: str) -> DataFrame:
    """Runs a management command and returns its result as rows."""
    text = re.sub(r"(?m)^\s*//.*$", "", text).strip().rstrip(";").rstrip()
    for pattern, handler in _COMMANDS:
        m = pattern.match(text)
        if m:
            return handler(engine, *m.groups())
    raise QueryError(f"unknown command: {text.splitlines()[0][:80]}")


# Tables.
def _create(engine: Engine, name: str, schema: T.StructType, if_missing: bool = False) -> None:
    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    engine.spark.sql(f"CREATE TABLE {'IF NOT EXISTS ' if if_missing else ''}{quoted(name)} ({fields}) USING parquet")


def _rewrite(engine: Engine, name: str, df: DataFrame) -> None:
    table, old = bare(name), f"{bare(name)}_{uuid.uuid4().hex[:8]}"
    new = f"{table}_{uuid.uuid4().hex[:8]}"
    df.write.format("parquet").saveAsTable(f"`{new}`")
    spark = engine.spark
    spark.sql(f"ALTER TABLE `{table}` RENAME TO `{old}`")
    spark.sql(f"ALTER TABLE `{new}` RENAME TO `{table}`")
    spark.sql(f"DROP TABLE `{old}`")


def _exists(engine: Engine, name: str) -> bool:
    return engine.spark.catalog.tableExists(bare(name))


@command(r"create tables (.*)")
def create_tables(engine, text):
    made = []
    for m in re.finditer(_NAME + r"\s*\(([^)]*)\)", text):
        name = m.group(1) or m.group(2) or m.group(3)
        _create(engine, name, readers.schema_of(columns_of(m.group(4))), True)
        made.append(name)
    return done(engine, f"created {', '.join(made)}")


@command(r"create table NAME based-on NAME")
def create_like(engine, name, other):
    _create(engine, name, engine.spark.table(quoted(other)).schema)
    return done(engine, f"created {bare(name)}")


@command(r"create table NAME\s*\((.*?)\)(?:\s+with\s*\(.*\))?")
def create_table(engine, name, text):
    _create(engine, name, readers.schema_of(columns_of(text)))
    return done(engine, f"created {bare(name)}")


def _merge(engine: Engine, name: str, text: str) -> None:
    have = {f.name for f in engine.spark.table(quoted(name)).schema.fields}
    new = [(n, k) for n, k in columns_of(text) if n not in have]
    if new:
        engine.spark.sql(f"ALTER TABLE {quoted(name)} ADD COLUMNS ({', '.join(f'{quoted(n)} {K.SPARK[k].simpleString()}' for n, k in new)})")


@command(r"create-merge table NAME\s*\((.*?)\)")
def create_merge(engine, name, text):
    _create(engine, name, readers.schema_of(columns_of(text)), True)
    _merge(engine, name, text)
    return done(engine, f"merged {bare(name)}")


@command(r"alter-merge table NAME\s*\((.*?)\)")
def alter_merge(engine, name, text):
    _merge(engine, name, text)
    return done(engine, f"merged {bare(name)}")


@command(r"alter table NAME docstring\s+[\"'](.*)[\"']")
def table_comment(engine, name, text):
    engine.spark.sql(f"COMMENT ON TABLE {quoted(name)} IS {_sql_string(text)}")
    return done(engine, f"altered {bare(name)}")


@command(r"alter table NAME folder\s+.*")
def table_folder(engine, name):
    return done(engine, f"{bare(name)}: folders are not kept")


@command(r"alter table NAME\s*\((.*?)\)")
def alter_table(engine, name, text):
    """The declared columns: those that stay keep their rows, others are dropped or added as null."""
    schema = readers.schema_of(columns_of(text))
    old = engine.spark.table(quoted(name))
    have = {f.name: f.dataType for f in old.schema.fields}
    df = old.select(*[(K.cast(F.col(f"`{f.name}`"), have[f.name], K.name_of(f.dataType)) if have[f.name] != f.dataType else F.col(f"`{f.name}`")).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    _rewrite(engine, name, df)
    return done(engine, f"altered {bare(name)}")


@command(r"alter column NAME\.NAME type\s*=\s*(\w+)")
def alter_column(engine, table, column, kind):
    old = engine.spark.table(quoted(table))
    t = old.schema[bare(column)].dataType
    _rewrite(engine, table, old.withColumn(bare(column), K.cast(F.col(quoted(column)), t, kind)))
    return done(engine, f"altered {bare(table)}.{bare(column)}")


@command(r"alter column NAME\.NAME docstring\s+[\"'](.*)[\"']")
def column_comment(engine, table, column, text):
    engine.spark.sql(f"ALTER TABLE {quoted(table)} ALTER COLUMN {quoted(column)} COMMENT {_sql_string(text)}")
    return done(engine, f"altered {bare(table)}.{bare(column)}")


@command(r"drop tables\s*\((.*?)\)( ifexists)?")
def drop_tables(engine, names, _quiet):
    for n in names.split(","):
        engine.spark.sql(f"DROP TABLE IF EXISTS {quoted(n.strip())}")
    return done(engine, "dropped")


@command(r"drop table NAME columns\s*\((.*?)\)")
def drop_columns(engine, name, text):
    gone = [bare(c.strip()) for c in text.split(",")]
    _rewrite(engine, name, engine.spark.table(quoted(name)).drop(*gone))
    return done(engine, f"dropped {', '.join(gone)}")


@command(r"drop table NAME( ifexists)?")
def drop_table(engine, name, quiet):
    engine.spark.sql(f"DROP TABLE {'IF EXISTS ' if quiet else ''}{quoted(name)}")
    return done(engine, f"dropped {bare(name)}")


@command(r"drop column NAME\.NAME")
def drop_column(engine, table, column):
    _rewrite(engine, table, engine.spark.table(quoted(table)).drop(bare(column)))
    return done(engine, f"dropped {bare(table)}.{bare(column)}")


@command(r"rename tables? (.*)")
def rename_tables(engine, text):
    pairs = re.findall(r"([\w\[\]'\"]+)\s+to\s+([\w\[\]'\"]+)", text)
    pairs += [(old, new) for new, old in re.findall(r"([\w\[\]'\"]+)\s*=\s*([\w\[\]'\"]+)", text)]
    if not pairs:
        raise QueryError("rename: old to new, or new=old")
    # Through names of their own, so that two tables can change places.
    between = {old: f"t_{uuid.uuid4().hex}" for old, _ in pairs}
    for old, _ in pairs:
        engine.spark.sql(f"ALTER TABLE {quoted(old)} RENAME TO `{between[old]}`")
    for old, new in pairs:
        engine.spark.sql(f"ALTER TABLE `{between[old]}` RENAME TO {quoted(new)}")
    return done(engine, "renamed")


@command(r"rename column NAME\.NAME to NAME")
def rename_column(engine, table, column, new):
    _rewrite(engine, table, engine.spark.table(quoted(table)).withColumnRenamed(bare(column), bare(new)))
    return done(engine, f"renamed to {bare(new)}")


@command(r"clear table NAME data")
def clear_table(engine, name):
    engine.spark.sql(f"TRUNCATE TABLE {quoted(name)}")
    return done(engine, f"cleared {bare(name)}")


@command(r"show tables( details)?")
def show_tables(engine, _details):
    return rows(engine, [(n, engine.spark.catalog.currentDatabase()) for n in engine.names()], "TableName string, DatabaseName string")


@command(r"show table NAME (?:details|cslschema)")
def show_table(engine, name):
    df = _table(engine, name)
    schema = ",".join(f"{f.name}:{K.name_of(f.dataType)}" for f in df.schema.fields)
    return rows(engine, [(bare(name), schema, engine.spark.catalog.currentDatabase())], "TableName string, Schema string, DatabaseName string")


@command(r"show table NAME schema as json")
def show_schema(engine, name):
    df = _table(engine, name)
    schema = {"Name": bare(name), "OrderedColumns": [{"Name": f.name, "Type": K.clr_name(K.name_of(f.dataType)), "CslType": K.name_of(f.dataType)} for f in df.schema.fields]}
    return rows(engine, [(bare(name), json.dumps(schema))], "TableName string, Schema string")


def _table(engine: Engine, name: str) -> DataFrame:
    df = engine.table(bare(name))
    if df is None:
        raise QueryError(f"no table {bare(name)!r}")
    return df


@command(r"show version")
def show_version(engine):
    return rows(engine, [(engine.spark.version, "Spark")], "BuildVersion string, ProductVersion string")


# Databases.
@command(r"(create|drop) database NAME( ifexists)?")
def database(engine, what, name, _quiet):
    engine.spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(name)}" if what.lower() == "create" else f"DROP DATABASE IF EXISTS {quoted(name)} CASCADE")
    return done(engine, f"{what.lower()} {bare(name)}")


@command(r"show databases")
def show_databases(engine):
    return rows(engine, [(d.name,) for d in engine.spark.catalog.listDatabases()], "DatabaseName string")


@command(r"show database (?:NAME )?schema")
def show_database(engine, name):
    out = []
    for t in engine.spark.catalog.listTables(bare(name) if name else None):
        for f in engine.spark.table(f"`{t.namespace[0]}`.`{t.name}`" if t.namespace else f"`{t.name}`").schema.fields:
            out.append((t.name, f.name, K.name_of(f.dataType)))
    return rows(engine, out, "TableName string, ColumnName string, ColumnType string")


@command(r"show (?:running )?queries")
def show_queries(engine):
    tracker = engine.spark.sparkContext.statusTracker()
    return rows(engine, [(int(j), tracker.getJobInfo(j).status) for j in tracker.getActiveJobsIds()], "JobId int, State string")


@command(r"execute database script(?:\s+with\s*\(.*?\))?\s*<\|(.*)")
def script(engine, text):
    """One statement per line group: a new one starts at a line that opens with a dot."""
    out = []
    for part in re.split(r"(?m)^(?=\s*\.[a-z])", text):
        part = part.strip().rstrip(";").strip()
        if not part:
            continue
        engine.execute(part)
        out.append((len(out), part[:200], "Completed"))
    return rows(engine, out, "OperationId int, CommandText string, Result string")


# Data.
@command(r"(set-or-append|set-or-replace|set|append)(?: async)? NAME(?:\s+with\s*\(.*?\))?\s*<\|(.*)")
def set_data(engine, mode, name, query):
    df = engine.query(query)
    there = _exists(engine, name)
    mode = mode.lower()
    if mode == "set" and there:
        raise QueryError(f"the table {bare(name)!r} exists")
    if mode == "append" and not there:
        raise QueryError(f"no table {bare(name)!r}")
    if mode in ("append", "set-or-append") and there:
        target = engine.spark.table(quoted(name)).schema
        have = set(df.columns)
        df.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in target.fields]).write.insertInto(quoted(name))
    elif there:
        _rewrite(engine, name, df)
    else:
        df.write.format("parquet").saveAsTable(quoted(name))
    return done(engine, f"{mode} {bare(name)}")


@command(r"(set|set-or-replace) stored_query_result NAME(?:\s+with\s*\(.*?\))?\s*<\|(.*)")
def store_result(engine, _mode, name, query):
    from pipewright.plans.frame import fresh

    table = f"stored_{fresh('q')}"
    engine.query(query).write.format("parquet").saveAsTable(f"`{table}`")
    _stored_results(engine)[bare(name)] = table
    engine.register(bare(name), engine.spark.table(f"`{table}`"))
    return done(engine, f"stored {bare(name)}")


_COMMANDS.insert(0, _COMMANDS.pop())


def _stored_results(engine: Engine) -> dict[str, str]:
    if not hasattr(engine, "stored_results"):
        engine.stored_results = {}
    return engine.stored_results


@command(r"show stored_query_results?")
def show_results(engine):
    return rows(engine, [(n,) for n in _stored_results(engine)], "Name string")


@command(r"drop stored_query_result NAME")
def drop_result(engine, name):
    table = _stored_results(engine).pop(bare(name), None)
    if table is None:
        raise QueryError(f"no stored result {bare(name)!r}")
    engine._tables.pop(bare(name), None)
    engine.spark.sql(f"DROP TABLE IF EXISTS `{table}`")
    return done(engine, f"dropped {bare(name)}")


@command(r"(?:purge|delete)(?: async)? table NAME records(?:\s+with\s*\(.*?\))?\s*<\|(.*)")
def delete(engine, name, text):
    """Rows that the query's filters select are removed; rows where a filter is null stay."""
    from pipewright.engine import language_settings
    from pipewright.lang.tree import Bin, Query
    from pipewright.plans.expressions import Scope
    from pipewright.plans.frame import Frame

    text = text.strip()
    q = parse_script(text if not text.startswith("|") and not text.lower().startswith("where") else f"{bare(name)} | {text.lstrip('|').strip()}").query
    if not isinstance(q, Query) or any(o.kind != "where" for o in q.ops):
        raise QueryError("delete takes filters only")
    table = engine.spark.table(quoted(name))
    predicate = None
    for o in q.ops:
        predicate = o.predicate if predicate is None else Bin("and", predicate, o.predicate)
    if predicate is None:
        engine.spark.sql(f"TRUNCATE TABLE {quoted(name)}")
        return done(engine, f"deleted from {bare(name)}")
    with language_settings(engine.spark):
        scope = Scope(engine._lowering(), Frame(table), {})
        kept = table.where(~F.coalesce(scope.lower(predicate).bool, F.lit(False)))
    _rewrite(engine, name, kept)
    return done(engine, f"deleted from {bare(name)}")


@command(r"ingest inline into table NAME(?:\s+with\s*\(.*?\))?\s*<\|(.*)")
def ingest_inline(engine, name, text):
    schema = engine.spark.table(quoted(name)).schema
    columns = [(f.name, K.name_of(f.dataType)) for f in schema.fields]
    df = engine.spark.createDataFrame(readers.parse_rows(text, columns), schema)
    df.write.insertInto(quoted(name))
    return done(engine, f"ingested into {bare(name)}")


@command(r"ingest(?: async)? into table NAME\s*\(?\s*(?:h|@)?[\"'](.+?)[\"']\s*\)?(?:\s+with\s*\((.*)\))?")
def ingest_file(engine, name, path, options):
    schema = engine.spark.table(quoted(name)).schema
    given = dict(re.findall(r"(\w+)\s*=\s*[\"']?([^\"',)]+)", options or ""))
    readers.read(engine.spark, [path], None, schema, given).write.insertInto(quoted(name))
    return done(engine, f"ingested into {bare(name)}")


@command(r"export(?: async)?(?: compressed)? to (\w+)\s*\(\s*(?:h|@)?[\"'](.+?)[\"']\s*\)(?:\s+with\s*\(.*?\))?\s*<\|(.*)")
def export(engine, fmt, path, query):
    df = engine.query(query)
    readers.write(df, fmt, path)
    return done(engine, f"exported to {path}")


@command(r"(?:create|create-or-alter|alter) external table NAME\s*\((.*?)\)\s*kind\s*=\s*\w+\s+dataformat\s*=\s*(\w+)\s*\(\s*(?:h|@)?[\"'](.+?)[\"']\s*\)(?:\s+with\s*\(.*\))?")
def external_table(engine, name, text, fmt, path):
    schema = readers.schema_of(columns_of(text)) if text.strip() else None
    df = readers.read(engine.spark, [path], fmt, schema, {"format": fmt})
    engine.register(bare(name), df)
    _externals(engine)[bare(name)] = path
    return done(engine, f"created {bare(name)}")


def _externals(engine: Engine) -> dict[str, str]:
    if not hasattr(engine, "externals"):
        engine.externals = {}
    return engine.externals


@command(r"drop external table NAME( ifexists)?")
def drop_external(engine, name, quiet):
    if _externals(engine).pop(bare(name), None) is None and not quiet:
        raise QueryError(f"no external table {bare(name)!r}")
    engine._tables.pop(bare(name), None)
    return done(engine, f"dropped {bare(name)}")


@command(r"show external tables?(?: NAME)?")
def show_externals(engine, name):
    return rows(engine, [(n, p) for n, p in _externals(engine).items() if not name or n == bare(name)], "TableName string, Path string")


# Functions and views.
@command(r"(?:create|create-or-alter|alter) function(?: ifnotexists)?(?:\s+with\s*\(.*?\))?\s+NAME\s*(\(.*)")
def create_function(engine, name, rest):
    parsed = parse_script(f"let {bare(name)} = {rest};").lets[0]
    engine.functions[bare(name)] = parsed.value
    _sources(engine)[bare(name)] = rest
    return done(engine, f"created {bare(name)}")


@command(r"view NAME\s*<\|(.*)")
def create_view(engine, name, query):
    from pipewright.lang.tree import Function

    engine.functions[bare(name)] = Function([], parse_script(query).query)
    _sources(engine)[bare(name)] = query.strip()
    return done(engine, f"created {bare(name)}")


def _sources(engine: Engine) -> dict[str, str]:
    if not hasattr(engine, "function_sources"):
        engine.function_sources = {}
    return engine.function_sources


@command(r"alter function NAME docstring\s+.*")
def function_comment(engine, name):
    if bare(name) not in engine.functions:
        raise QueryError(f"no function {bare(name)!r}")
    return done(engine, f"altered {bare(name)}")


_COMMANDS.insert(0, _COMMANDS.pop())


@command(r"drop function NAME( ifexists)?")
def drop_function(engine, name, quiet):
    if engine.functions.pop(bare(name), None) is None and not quiet:
        raise QueryError(f"no function {bare(name)!r}")
    _sources(engine).pop(bare(name), None)
    return done(engine, f"dropped {bare(name)}")


@command(r"show functions?(?: NAME)?")
def show_functions(engine, name):
    return rows(engine, [(n, _sources(engine).get(n, "")) for n in sorted(engine.functions) if not name or n == bare(name)], "Name string, Body string")


@command(r"create(?:-or-alter)?(?: async)? materialized-view(?:\s+with\s*\(.*?\))?\s+NAME on table NAME\s*\{?\s*(?:<\|)?(.*?)\}?")
def materialized_view(engine, name, _table_name, query):
    """A snapshot table; :func:`refresh` computes it again."""
    query = query.strip().rstrip("}").strip()
    _views(engine)[bare(name)] = query
    refresh(engine, bare(name))
    return done(engine, f"created {bare(name)}")


def refresh(engine: Engine, name: str) -> None:
    df = engine.query(_views(engine)[name])
    if _exists(engine, name):
        _rewrite(engine, name, df)
    else:
        df.write.format("parquet").saveAsTable(f"`{name}`")


def _views(engine: Engine) -> dict[str, str]:
    if not hasattr(engine, "materialized"):
        engine.materialized = {}
    return engine.materialized


@command(r"drop materialized-view NAME( ifexists)?")
def drop_materialized(engine, name, quiet):
    if _views(engine).pop(bare(name), None) is None and not quiet:
        raise QueryError(f"no view {bare(name)!r}")
    engine.spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")
    return done(engine, f"dropped {bare(name)}")


@command(r"show materialized-views?(?: NAME)?")
def show_materialized(engine, name):
    return rows(engine, [(n, q) for n, q in _views(engine).items() if not name or n == bare(name)], "Name string, Query string")


def _sql_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

