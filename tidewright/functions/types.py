"""Column types of three relational servers and of documents, as Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

#: Spark type by source type name; sizes are added where a type has them. Fixed values.
SPARK_TYPES = {
    "bigint": "bigint", "bigserial": "bigint", "int8": "bigint",
    "int": "int", "integer": "int", "int4": "int", "mediumint": "int", "serial": "int", "year": "int",
    "smallint": "smallint", "int2": "smallint", "smallserial": "smallint",
    "bit": "boolean", "bool": "boolean", "boolean": "boolean",
    "decimal": "decimal", "numeric": "decimal", "money": "decimal(19,4)", "smallmoney": "decimal(10,4)",
    "float": "double", "double": "double", "double precision": "double", "real": "float",
    "char": "char", "nchar": "char", "character": "char", "varchar": "varchar", "nvarchar": "varchar", "character varying": "varchar",
    "text": "string", "ntext": "string", "tinytext": "string", "mediumtext": "string", "longtext": "string", "enum": "string", "set": "string",
    "date": "date", "datetime": "timestamp_ntz", "datetime2": "timestamp_ntz", "smalldatetime": "timestamp_ntz", "timestamp": "timestamp_ntz",
    "timestamp without time zone": "timestamp_ntz", "timestamp with time zone": "timestamp", "timestamptz": "timestamp", "datetimeoffset": "timestamp",
    "time": "string", "time with time zone": "string", "time without time zone": "string", "interval": "string",
    "binary": "binary", "varbinary": "binary", "image": "binary", "blob": "binary", "tinyblob": "binary", "mediumblob": "binary", "longblob": "binary", "bytea": "binary", "rowversion": "binary",
    "uniqueidentifier": "string", "uuid": "string", "xml": "string", "hierarchyid": "string", "geography": "string", "geometry": "string", "sql_variant": "string",
    "json": "string", "jsonb": "string",
}


PLAIN = {t.simpleString(): t for t in (T.LongType(), T.IntegerType(), T.ShortType(), T.ByteType(), T.BooleanType(), T.DoubleType(), T.FloatType(), T.StringType(), T.DateType(), T.TimestampType(), T.TimestampNTZType(), T.BinaryType())}


def spark_type(source: str, name: str, length: int | None = None, precision: int | None = None, scale: int | None = None) -> T.DataType:
    """A column's Spark type. Unknown types are text; a missing length or -1 means unbounded; unsigned tiny integers get a wider type."""
    name = name.lower().strip()
    if name == "tinyint":
        return T.ShortType() if source == "mssql" else T.ByteType()
    if name == "timestamp" and source == "mssql":
        return T.BinaryType()
    if name == "float" and source == "mysql":
        return T.FloatType()
    kind = SPARK_TYPES.get(name, "string")
    if kind == "decimal":
        return T.DecimalType(min(precision or 38, 38), scale if scale is not None else (0 if precision else 10))
    if kind in ("char", "varchar"):
        if not length or length < 0:
            return T.StringType()
        return T.CharType(min(length, 255)) if kind == "char" else T.VarcharType(length)
    if kind.startswith("decimal("):
        return T.DecimalType(*map(int, kind[8:-1].split(",")))
    return PLAIN[kind]


#: What a Spark type is called by each server; {n}: its size. Fixed values.
TARGET_TYPES = {
    "mysql": {"bigint": "BIGINT", "int": "INT", "smallint": "SMALLINT", "tinyint": "TINYINT", "boolean": "TINYINT(1)", "double": "DOUBLE", "float": "FLOAT", "string": "LONGTEXT", "date": "DATE", "timestamp_ntz": "DATETIME(6)", "timestamp": "DATETIME(6)", "binary": "LONGBLOB", "decimal": "DECIMAL({n})", "char": "CHAR({n})", "varchar": "VARCHAR({n})", "json": "JSON"},
    "postgresql": {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "SMALLINT", "boolean": "BOOLEAN", "double": "DOUBLE PRECISION", "float": "REAL", "string": "TEXT", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMPTZ", "binary": "BYTEA", "decimal": "NUMERIC({n})", "char": "CHAR({n})", "varchar": "VARCHAR({n})", "json": "JSONB"},
    "mssql": {"bigint": "BIGINT", "int": "INT", "smallint": "SMALLINT", "tinyint": "SMALLINT", "boolean": "BIT", "double": "FLOAT", "float": "REAL", "string": "NVARCHAR(MAX)", "date": "DATE", "timestamp_ntz": "DATETIME2", "timestamp": "DATETIMEOFFSET", "binary": "VARBINARY(MAX)", "decimal": "DECIMAL({n})", "char": "NCHAR({n})", "varchar": "NVARCHAR({n})", "json": "NVARCHAR(MAX)"},
}


def target_type(kind: T.DataType, dialect: str) -> str:
    """The name of a Spark type in the dialect; arrays and structs are JSON there."""
    if dialect not in TARGET_TYPES:
        raise ValueError(f"unsupported target: {dialect}")
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return TARGET_TYPES[dialect]["json"]
    name, _, size = kind.simpleString().partition("(")
    size = size.rstrip(")")
    if name == "varchar" and dialect == "mysql":
        size = str(min(int(size), 16383))
    return TARGET_TYPES[dialect].get(name, TARGET_TYPES[dialect]["string"]).format(n=size)


def create_table(name: str, schema: T.StructType, dialect: str, keys: tuple[str, ...] = ()) -> str:
    """CREATE TABLE text for a relational target."""
    from .naming import quote

    lines = [f"{quote(f.name, dialect)} {target_type(f.dataType, dialect)} {'NULL' if f.nullable and f.name not in keys else 'NOT NULL'}" for f in schema]
    if keys:
        lines.append(f"PRIMARY KEY ({', '.join(quote(k, dialect) for k in keys)})")
    return f"CREATE TABLE {name} (\n  " + ",\n  ".join(lines) + "\n)"
