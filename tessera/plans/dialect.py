"""One text for two engines: the few places where Spark SQL and DuckDB SQL differ.

A query is a function of a dialect that returns SQL. Spark runs it over temporary views of
the Parquet tables, so Catalyst prunes columns and pushes filters as for any query; the
same function with the other dialect is the oracle. Queries that need more than SQL, or
whose Spark form should differ, are written as DataFrame functions instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import spread, table

#: Tokens after lower-casing: hexadecimal numbers, identifiers with inner joints, decimals, runs of ideographs (fixed values).
TOKEN = "0x[0-9a-f]+|[a-z]+[a-z0-9]*(?:[._-][a-z0-9]+)*|[0-9]+(?:[.][0-9]+)*|[\\x{4e00}-\\x{9fff}]+"
IDEOGRAPH = "[\\x{4e00}-\\x{9fff}]"

#: Tables whose rows are worth more work than moving them.
TEXTS = ("documents",)

Sql = Callable[["Dialect"], str]


class Dialect:
    """What both engines spell alike."""

    def t(self, name: str) -> str:
        raise NotImplementedError

    def tokens(self, x: str) -> str:
        """All tokens, a run of ideographs as its characters and then its pairs; repeats are kept."""
        plain = self.find_all(f"lower({x})", TOKEN)
        return f"CASE WHEN {self.has(x, IDEOGRAPH)} THEN flatten({self.map(plain, 'w_', self.spelled('w_'))}) ELSE {plain} END"

    def spelled(self, w: str) -> str:
        raise NotImplementedError

    def i(self, x: str) -> str:
        return f"CAST({x} AS BIGINT)"

    def d(self, x: str) -> str:
        return f"CAST({x} AS DOUBLE)"


class Spark(Dialect):
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.tag = hashlib.sha256(folder.encode()).hexdigest()[:10]

    def t(self, name):
        view = f"{name}_{self.tag}"
        df = table(self.spark, self.folder, name)
        (spread(df) if name in TEXTS else df).createOrReplaceTempView(view)
        return view

    def re(self, p):
        return "r'" + p + "'"

    def find_all(self, x, p, group=0):
        return f"regexp_extract_all({x}, {self.re(p)}, {group})"

    def find(self, x, p, group=0):
        return f"regexp_extract({x}, {self.re(p)}, {group})"

    def has(self, x, p):
        return f"({x} RLIKE {self.re(p)})"

    def sub(self, x, p, by):
        return f"regexp_replace({x}, {self.re(p)}, '{by}')"

    def spelled(self, w):
        pairs = f"CASE WHEN char_length({w}) > 1 THEN transform(sequence(1, char_length({w}) - 1), k_ -> substr({w}, k_, 2)) ELSE CAST(array() AS ARRAY<STRING>) END"
        return f"CASE WHEN {self.has(w, IDEOGRAPH)} THEN concat(transform(sequence(1, char_length({w})), k_ -> substr({w}, k_, 1)), {pairs}) ELSE array({w}) END"

    def size(self, a):
        return f"CAST(size({a}) AS BIGINT)"

    def length(self, x):
        return f"CAST(char_length({x}) AS BIGINT)"

    def explode(self, a):
        return f"explode({a})"

    def places(self, columns, a, source, pos="pos", val="val"):
        return f"SELECT {columns}, CAST(p_ AS BIGINT) AS {pos}, v_ AS {val} FROM {source} LATERAL VIEW posexplode({a}) AS p_, v_"

    def split(self, x, s):
        return f"split({x}, {self.re(s)})"

    def array(self, *xs):
        return f"array({', '.join(xs)})"

    def at(self, a, k):
        return f"try_element_at({a}, CAST({k} AS INT))"

    def both(self, a, b):
        return f"array_intersect({a}, {b})"

    def either(self, a, b):
        return f"array_union({a}, {b})"

    def minus(self, a, b):
        return f"array_except({a}, {b})"

    def distinct(self, a):
        return f"array_distinct({a})"

    def ordered(self, a):
        return f"array_sort({a})"

    def join(self, a, s):
        return f"array_join({a}, '{s}')"

    def holds(self, a, x):
        return f"array_contains({a}, {x})"

    def slice(self, a, start, n):
        return f"slice({a}, {start}, {n})"

    def map(self, a, v, e):
        return f"transform({a}, {v} -> {e})"

    def only(self, a, v, e):
        return f"filter({a}, {v} -> {e})"

    def up_to(self, a, b):
        return f"CASE WHEN {b} >= {a} THEN sequence({a}, {b}) ELSE CAST(array() AS ARRAY<BIGINT>) END"

    def listed(self, v, s, by):
        return f"listagg({v}, '{s}') WITHIN GROUP (ORDER BY {by})"

    def sha(self, x):
        return f"sha2({x}, 256)"

    def micros(self, x):
        return f"unix_micros(CAST({x} AS TIMESTAMP))"

    def best(self, v, by):
        return f"max_by({v}, {by})"

    def least(self, v, by):
        return f"min_by({v}, {by})"

    def pack(self, *xs):
        return f"struct({', '.join(xs)})"

    def disc(self, x, q):
        return f"percentile_disc({q}) WITHIN GROUP (ORDER BY {x})"

    def cont(self, x, q):
        return f"percentile_cont({q}) WITHIN GROUP (ORDER BY {x})"

    def json(self, x, k):
        return f"get_json_object({x}, '$.{k}')"

    def squared(self, a, b):
        return f"aggregate(zip_with({a}, {b}, (x, y) -> (CAST(x AS DOUBLE) - CAST(y AS DOUBLE)) * (CAST(x AS DOUBLE) - CAST(y AS DOUBLE))), CAST(0 AS DOUBLE), (s, z) -> s + z)"

    def dot(self, a, b):
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, z) -> s + z)"

    def last(self, x):
        return f"last_value({x}) IGNORE NULLS"

    def hex_int(self, x):
        return f"CAST(conv({x}, 16, 10) AS BIGINT)"

    def rows(self, columns, *values):
        return f"(SELECT * FROM VALUES {', '.join(values)} AS v_({columns}))"


class Duck(Dialect):
    def t(self, name):
        return name

    def re(self, p):
        return "'" + p + "'"

    def find_all(self, x, p, group=0):
        return f"regexp_extract_all({x}, {self.re(p)}, {group})"

    def find(self, x, p, group=0):
        return f"regexp_extract({x}, {self.re(p)}, {group})"

    def has(self, x, p):
        return f"regexp_matches({x}, {self.re(p)})"

    def sub(self, x, p, by):
        return f"regexp_replace({x}, {self.re(p)}, '{by}', 'g')"

    def spelled(self, w):
        every = f"list_concat(list_transform(range(1, length({w}) + 1), lambda k_: substr({w}, k_, 1)), list_transform(range(1, length({w})), lambda k_: substr({w}, k_, 2)))"
        return f"CASE WHEN {self.has(w, IDEOGRAPH)} THEN {every} ELSE [{w}] END"

    def size(self, a):
        return f"CAST(len({a}) AS BIGINT)"

    def length(self, x):
        return f"CAST(length({x}) AS BIGINT)"

    def explode(self, a):
        return f"unnest({a})"

    def places(self, columns, a, source, pos="pos", val="val"):
        return f"SELECT {columns}, unnest(range(len({a}))) AS {pos}, unnest({a}) AS {val} FROM {source}"

    def split(self, x, s):
        return f"regexp_split_to_array({x}, {self.re(s)})"

    def array(self, *xs):
        return f"[{', '.join(xs)}]"

    def at(self, a, k):
        return f"({a})[{k}]"

    def both(self, a, b):
        return f"list_intersect({a}, {b})"

    def either(self, a, b):
        return f"list_distinct(list_concat({a}, {b}))"

    def minus(self, a, b):
        return f"list_distinct(list_filter({a}, lambda e_: NOT list_contains({b}, e_)))"

    def distinct(self, a):
        return f"list_distinct({a})"

    def ordered(self, a):
        return f"list_sort({a})"

    def join(self, a, s):
        return f"array_to_string({a}, '{s}')"

    def holds(self, a, x):
        return f"list_contains({a}, {x})"

    def slice(self, a, start, n):
        return f"({a})[({start}):({start}) + ({n}) - 1]"

    def map(self, a, v, e):
        return f"list_transform({a}, lambda {v}: {e})"

    def only(self, a, v, e):
        return f"list_filter({a}, lambda {v}: {e})"

    def up_to(self, a, b):
        return f"range({a}, {b} + 1)"

    def listed(self, v, s, by):
        return f"string_agg({v}, '{s}' ORDER BY {by})"

    def sha(self, x):
        return f"sha256({x})"

    def micros(self, x):
        return f"epoch_us({x})"

    def best(self, v, by):
        return f"arg_max({v}, {by})"

    def least(self, v, by):
        return f"arg_min({v}, {by})"

    def pack(self, *xs):
        return f"row({', '.join(xs)})"

    def disc(self, x, q):
        return f"quantile_disc({x}, {q})"

    def cont(self, x, q):
        return f"quantile_cont({x}, {q})"

    def json(self, x, k):
        return f"json_extract_string({x}, '$.{k}')"

    def squared(self, a, b):
        return f"list_sum(list_transform(range(1, len({a}) + 1), lambda k_: ({a}[k_]::DOUBLE - {b}[k_]::DOUBLE) * ({a}[k_]::DOUBLE - {b}[k_]::DOUBLE)))"

    def dot(self, a, b):
        return f"list_sum(list_transform(range(1, len({a}) + 1), lambda k_: {a}[k_]::DOUBLE * {b}[k_]::DOUBLE))"

    def last(self, x):
        return f"last_value({x} IGNORE NULLS)"

    def hex_int(self, x):
        return f"('0x' || {x})::BIGINT"

    def rows(self, columns, *values):
        return f"(SELECT * FROM (VALUES {', '.join(values)}) AS v_({columns}))"


def spark_query(sql: Sql) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return spark.sql(sql(Spark(spark, folder)))

    run.__doc__ = sql.__doc__
    return run


class Book:
    """A module's queries, each with the ids of the operators that it covers."""

    def __init__(self):
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLES: dict[str, str] = {}
        self.COVERS: dict[str, str] = {}

    def both(self, covers: str) -> Callable[[Sql], Sql]:
        """Register SQL that both engines run."""

        def keep(sql: Sql) -> Sql:
            self.QUERIES[sql.__name__] = spark_query(sql)
            self.ORACLES[sql.__name__] = sql(Duck())
            self.COVERS[sql.__name__] = covers
            return sql

        return keep

    def runs(self, sql: Sql) -> Callable:
        """Run the query that ``both`` registered by another function; its SQL stays what it is held against."""

        def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            f.__doc__ = sql.__doc__
            self.QUERIES[sql.__name__] = f
            return f

        return keep

    def frame(self, covers: str, oracle: str | None = None) -> Callable:
        """Register a DataFrame function and the SQL that gives its rows."""

        def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            self.QUERIES[f.__name__] = f
            self.COVERS[f.__name__] = covers
            if oracle:
                self.ORACLES[f.__name__] = oracle
            return f

        return keep
