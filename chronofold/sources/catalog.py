"""Tables as views: registration, declared metadata, information-schema answers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SQL_NAMES = {
    "byte": "TINYINT", "short": "SMALLINT", "integer": "INTEGER", "long": "BIGINT", "double": "REAL", "float": "REAL", "string": "TEXT",
    "binary": "BYTES", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "variant": "JSON",
}
SPARK_TYPES = {
    "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(),
    "REAL": T.DoubleType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "TEXT": T.StringType(), "VARCHAR": T.StringType(), "STRING": T.StringType(),
    "BINARY": T.BinaryType(), "VARBINARY": T.BinaryType(), "BLOB": T.BinaryType(), "BOOLEAN": T.BooleanType(), "BOOL": T.BooleanType(),
    "DATE": T.DateType(), "TIME": T.LongType(), "TIMESTAMP": T.TimestampType(), "UUID": T.StringType(), "JSON": T.StringType(), "DECIMAL": T.DecimalType(18, 2),
}


@dataclass
class TableDef:
    """What is declared about a table beside its data: keys, indexes, classes, version."""

    name: str
    columns: T.StructType
    primary_key: list[str] = field(default_factory=list)
    classes: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, list[str]] = field(default_factory=dict)
    required: list[str] = field(default_factory=list)
    version: int = 1
    #: Columns that were dropped, and the names under which re-added ones are stored.
    dropped: set[str] = field(default_factory=set)
    stored: dict[str, str] = field(default_factory=dict)

    def add_column(self, name: str, kind: T.DataType) -> None:
        if name in self.columns.names:
            raise ValueError(f"column {name} exists")
        self.columns = T.StructType([*self.columns.fields, T.StructField(name, kind)])
        self.version += 1
        if name in self.dropped:
            self.stored[name] = f"{name}__{self.version}"  # what the old column held stays hidden

    def drop_column(self, name: str) -> None:
        if name in self.primary_key:
            raise ValueError(f"{name} is part of the primary key")
        if name not in self.columns.names:
            raise ValueError(f"no column {name}")
        self.columns = T.StructType([f for f in self.columns.fields if f.name != name])
        self.dropped.add(name)
        self.classes.pop(name, None)
        self.indexes = {i: c for i, c in self.indexes.items() if name not in c}
        self.version += 1

    def conform(self, df: DataFrame) -> DataFrame:
        """df in this version's columns: missing ones are null, dropped ones go."""
        from pyspark.sql import functions as F

        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.columns])


class Catalog:
    """Tables by name, each with its DataFrame and TableDef."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.frames: dict[str, DataFrame] = {}
        self.defs: dict[str, TableDef] = {}

    def register(self, name: str, df: DataFrame, primary_key: list[str] | None = None, classes: dict[str, str] | None = None) -> DataFrame:
        if not df.columns:
            raise ValueError("a table needs a column")
        self.frames[name] = df
        self.defs[name] = TableDef(name, df.schema, primary_key or [], classes or {})
        df.createOrReplaceTempView(name)
        return df

    def drop(self, name: str, if_exists: bool = False) -> None:
        if name not in self.frames and not if_exists:
            raise ValueError(f"no table {name}")
        self.frames.pop(name, None)
        self.defs.pop(name, None)
        self.spark.catalog.dropTempView(name)

    def tables(self) -> DataFrame:
        rows = [(n, len(d.columns), len(d.primary_key)) for n, d in sorted(self.defs.items())]
        return self.spark.createDataFrame(rows, "table_name string, column_count long, primary_key_count long")

    def columns(self, table: str | None = None) -> DataFrame:
        rows = [(n, f.name, SQL_NAMES.get(f.dataType.typeName(), f.dataType.simpleString().upper()), i + 1) for n, d in sorted(self.defs.items()) if table in (None, n) for i, f in enumerate(d.columns)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, data_type string, ordinal_position long")

    def classifications(self, table: str) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.defs[table].classes.items()), "column_name string, data_class string")


#: The star schema that the queries run on, with keys.
TABLES = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"],
}


#: Schemas of tables read before, by path: each is inferred once a process.
_SCHEMAS: dict[str, T.StructType] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def open_catalog(spark: SparkSession, sf_dir: str, *names: str) -> Catalog:
    """A catalog of the tables named; of all if none is."""
    catalog = Catalog(spark)
    for name in names or TABLES:
        catalog.register(name, read_table(spark, sf_dir, name), TABLES.get(name))
    return catalog


def type_of(text: str) -> T.DataType:
    """The type that a declaration such as VARCHAR(20) or DECIMAL(10, 2) names."""
    m = re.fullmatch(r"\s*(\w+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*", text)
    if not m or m[1].upper() not in SPARK_TYPES:
        raise ValueError(f"unknown type {text}")
    if m[1].upper() == "DECIMAL" and m[2]:
        return T.DecimalType(int(m[2]), int(m[3] or 0))
    return SPARK_TYPES[m[1].upper()]
