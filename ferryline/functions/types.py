"""JDBC type codes, their families, and the codes of Spark types."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Java.sql.Types codes by family.
FAMILIES = {
    "NUMERIC": [-6, 5, 4, -5, 6, 7, 8, 2, 3],
    "TEXT": [1, 12, -1, -15, -9, -16],
    "TEMPORAL": [91, 92, 2013, 93, 2014],
    "BOOLEAN": [16, -7],
    "BINARY": [-2, -3, -4, 2004],
}
SPARK_CODES = {
    T.ByteType: -6, T.ShortType: 5, T.IntegerType: 4, T.LongType: -5,
    T.FloatType: 7, T.DoubleType: 8, T.DecimalType: 3,
    T.CharType: 1, T.VarcharType: 12, T.StringType: -1,
    T.DateType: 91, T.TimestampNTZType: 93, T.TimestampType: 2014,
    T.BooleanType: 16, T.BinaryType: -3, T.ArrayType: 2003, T.StructType: 2002, T.MapType: 2000,
}


def type_family(code: Column) -> Column:
    """Family of a JDBC type code; any other code is a family of its own."""
    pairs = [(F.lit(c), F.lit(family)) for family, codes in FAMILIES.items() for c in codes]
    known = F.create_map(*chain.from_iterable(pairs))
    return F.coalesce(F.try_element_at(known, code.cast("int")), F.concat(F.lit("OTHER_"), code.cast("string")))


def jdbc_code(data_type: T.DataType) -> int:
    for spark_type, code in SPARK_CODES.items():
        if type(data_type) is spark_type:
            return code
    return 1111  # java.sql.Types.OTHER


def stored_type(data_type: T.DataType) -> T.DataType:
    """The type a DataFrame column has: char and varchar are strings there."""
    return T.StringType() if isinstance(data_type, (T.CharType, T.VarcharType)) else data_type
