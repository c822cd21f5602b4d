"""The data model: weights are whole numbers of a unit (``SCALE`` decimals for text input)."""

from __future__ import annotations

from pyspark.sql import types as T

SLOTS = 8
SCALE = 6
WEIGHTS = [f"w{i}" for i in range(SLOTS)]

_text, _long = T.StringType(), T.LongType()

EDGES = T.StructType([T.StructField("src", _text, False), T.StructField("dst", _text, False), *[T.StructField(w, _long) for w in WEIGHTS]])
VERTICES = T.StructType([T.StructField("name", _text, False), T.StructField("f_name", _text), T.StructField("t_name", _text)])
OPS = T.StructType(
    [T.StructField("seq", _long, False), T.StructField("op", _text, False), T.StructField("src", _text), T.StructField("dst", _text), T.StructField("name", _text)]
    + [T.StructField(w, _long) for w in WEIGHTS]
    + [T.StructField("k", T.IntegerType()), T.StructField("save", T.BooleanType()), T.StructField("recover", T.BooleanType())]
)
POINT = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("vert", _text), T.StructField("dist", _long)])
