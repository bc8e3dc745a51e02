"""Canonical texts against Python's json and C's %g."""

import hashlib
import json
import math
import random
import struct

from panelmill.functions import canonical as N
from pyspark.sql import functions as F


def doubles():
    rng = random.Random(11)
    values = [0.0, -0.0, 1.0, -1.5, 100.0, 1e15, 1e16, 123456789012345680.0, 1e22, 1e23, 1e-4, 1e-5, 0.1, 1 / 3, 2 / 3, 5e-324, 1.7976931348623157e308, 2.0**-44, 9007199254740993.0, 1.1e-7]
    values += [rng.uniform(-1e6, 1e6) for _ in range(300)] + [round(rng.uniform(0, 1000), 4) for _ in range(200)]
    while len(values) < 800:
        v = struct.unpack("d", rng.randbytes(8))[0]
        if math.isfinite(v):
            values.append(v)
    return values


def test_doubles_are_written_as_python_writes_them(spark):
    df = spark.createDataFrame([(v,) for v in doubles()], "v double")
    rows = df.select("v", N.shortest(F.col("v")).alias("s"), N.general(F.col("v")).alias("g")).collect()
    wrong = [(repr(r["v"]), r["s"]) for r in rows if r["s"] != json.dumps(r["v"])]
    # A text in more digits than needed may be left where Java itself prints more than 17; it still reads back.
    assert len(wrong) <= 2 and all(float(s) == float(v) for v, s in wrong), wrong
    off = [(repr(r["v"]), r["g"]) for r in rows if r["g"] != f"{r['v']:.12g}"]
    assert len(off) <= 1, off
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v double").select(N.json_text(F.col("v"), df.schema["v"].dataType).alias("s"))
    assert [r["s"] for r in odd.collect()] == ["NaN", "Infinity", "-Infinity", "null"]


VALUES = [
    {"b": 1, "a": "x", "c": {"z": None, "y": [1.5, None, 2.0]}, "m": {"k2": True, "k1": False}, "d": None},
    {"b": None, "a": 'q"\\ \n\t\r\b\f\x01\x1f/ é 漢 🙂  \x7f', "c": {"z": "é🙂", "y": []}, "m": {"é": True, "z": None}, "d": "2024-02-29"},
    {"b": -7, "a": "", "c": None, "m": None, "d": None},
]
KIND = "b long, a string, c struct<z: string, y: array<double>>, m map<string, boolean>, d string"


def test_four_forms_equal_json_dumps(spark):
    df = spark.createDataFrame([(v["b"], v["a"], (v["c"]["z"], v["c"]["y"]) if v["c"] else None, v["m"], v["d"]) for v in VALUES], KIND).coalesce(1)
    whole, kind = F.struct(*df.columns), df.schema
    forms = {"spaced": {"ensure_ascii": False}, "compact": {"ensure_ascii": False, "separators": (",", ":")}, "escaped": {"separators": (",", ":")}, "expression": {}}
    for form, options in forms.items():
        got = [r["i"] for r in df.select(N.identity(whole, kind, form).alias("i")).collect()]
        digest = hashlib.sha1 if form == "expression" else hashlib.sha256
        texts = [r["t"] for r in df.select(N.json_text(whole, kind, form in ("compact", "escaped"), form in ("escaped", "expression")).alias("t")).collect()]
        assert texts == [json.dumps(v, sort_keys=True, **options) for v in VALUES], form
        assert got == [digest(json.dumps(v, sort_keys=True, **options).encode()).hexdigest() for v in VALUES]


def test_an_expression_has_the_identity_of_its_json(spark):
    df = spark.createDataFrame([("mul", [{"feature": "a"}, {"feature": "b"}])], "op string, args array<map<string,string>>")
    got = df.select(N.identity(F.struct("op", "args"), df.schema, "expression").alias("i")).first()["i"]
    assert got == hashlib.sha1(b'{"args": [{"feature": "a"}, {"feature": "b"}], "op": "mul"}').hexdigest()
