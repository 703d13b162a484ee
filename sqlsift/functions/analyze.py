"""The SQL front-end as an Arrow UDF: one parse for texts that differ in literals alone (`sqltext.shapes`); a text it cannot take becomes an error, never a failure."""

from __future__ import annotations

import sys
import threading

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sqlsift.sqltext.shapes import Templates

#: Frames and bytes of stack for texts that nest deeper than Python's default.
DEEP_FRAMES, DEEP_STACK = 100_000, 512 << 20
SCHEMA = """struct<error: string, statements: array<struct<command: string, masked: string, unmasked: string,
  columns: array<struct<clause: string, schema_name: string, table_name: string, column_name: string>>,
  tables: array<struct<schema_name: string, table_name: string>>,
  joins: array<struct<schema_a: string, table_a: string, schema_b: string, table_b: string, on_condition: string, join_condition: string>>,
  functions: array<string>,
  creates: array<struct<scope: string, is_unique: boolean, used_concurrently: boolean, is_temp: boolean, is_unlogged: boolean, object_type: string,
    if_not_exists: boolean, name: string, on_commit: string, operator: string, expression: string, where_clause: string>>>>>"""


def _rows(**fields: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct(list(fields.items())))


_S, _B = pa.string(), pa.bool_()
#: SCHEMA for Arrow.
_ARROW = pa.struct([("error", _S), ("statements", _rows(
    command=_S, masked=_S, unmasked=_S, columns=_rows(clause=_S, schema_name=_S, table_name=_S, column_name=_S), tables=_rows(schema_name=_S, table_name=_S),
    joins=_rows(schema_a=_S, table_a=_S, schema_b=_S, table_b=_S, on_condition=_S, join_condition=_S), functions=pa.list_(_S),
    creates=_rows(scope=_S, is_unique=_B, used_concurrently=_B, is_temp=_B, is_unlogged=_B, object_type=_S, if_not_exists=_B, name=_S, on_commit=_S, operator=_S, expression=_S, where_clause=_S),
))])


def _deep(run, *args):
    """The result of `run` in a thread of its own with a large stack; RecursionError if even that is too small."""
    out: list = []

    def inner():
        try:
            out.append(run(*args))
        except RecursionError as e:
            out.append(e)

    frames, stack = sys.getrecursionlimit(), threading.stack_size(DEEP_STACK)
    try:
        sys.setrecursionlimit(DEEP_FRAMES)
        thread = threading.Thread(target=inner)
        thread.start()
        thread.join()
    finally:
        threading.stack_size(stack)
        sys.setrecursionlimit(frames)
    if isinstance(out[0], RecursionError):
        raise out[0]
    return out[0]


def analyze_text(sql: str | None) -> dict:
    """Error or statements of one text. Null and empty texts have no statement and no error."""
    try:
        return _analyzed(sql)
    except RecursionError:
        pass
    try:
        return _deep(_analyzed, sql)
    except RecursionError:
        return {"error": "nested too deep", "statements": []}


def _analyzed(sql: str | None) -> dict:
    from sqlsift.sqltext.lexer import SqlError
    from sqlsift.sqltext.metadata import extract
    from sqlsift.sqltext.parser import parse
    from sqlsift.sqltext.printer import text

    sql = sql or ""
    try:
        found = []
        for s in parse(sql):
            m = extract(s)
            table = next(iter(m.tables)) if len(m.tables) == 1 else None
            found.append(
                {
                    "command": s.command, "masked": text(s, True), "unmasked": text(s),
                    # with one table in the statement, its columns without a table are that table's
                    "columns": [dict(zip(("clause", "schema_name", "table_name", "column_name"), (c[0], *table, c[3]) if table and c[2] == "UNKNOWN" else c)) for c in m.columns],
                    "tables": [dict(zip(("schema_name", "table_name"), t)) for t in m.tables],
                    "joins": [dict(zip(("schema_a", "table_a", "schema_b", "table_b", "on_condition", "join_condition"), (*k, *v))) for k, v in m.joins.items()],
                    "functions": list(m.functions), "creates": m.creates,
                }
            )
        return {"error": None, "statements": found}
    except SqlError as e:
        return {"error": str(e), "statements": []}


#: A worker's own.
_TEMPLATES = Templates(analyze_text)


def _analyzed_batch(texts: pa.Array) -> pa.Array:
    return pa.array([_TEMPLATES(x) for x in texts.to_pylist()], _ARROW)


def analyze(text: Column | str) -> Column:
    """Error and statements. Declared nondeterministic to be called once a row: filters that Spark infers from what is taken apart (no empty lists) would
    else call it a second time where the texts are read, in as few tasks as that has and before texts are made distinct."""
    return F.arrow_udf(_analyzed_batch, SCHEMA).asNondeterministic()(text)
