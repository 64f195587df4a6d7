import hashlib

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import expr as X


def one(spark, value, kind, column):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c"))).first()[0]


@pytest.mark.parametrize("v", [0.1, 1.0, 123.456, 1e7, 12345678.9, 1.5e15, 1e16, 1.5e16, 2.5e-4, 1e-4, 1e-5, 1.25e-7, -1e7, -2.5e-4, -1e-5, 1e22, 0.0, 999999.5, 1e-3, 1e300])
def test_floats_print_as_in_python(spark, v):
    assert one(spark, v, "double", X.python_float) == str(v)


def test_stable_ids(spark):
    want = "obs_" + hashlib.sha1(b"a::2").hexdigest()[:16]
    assert spark.range(1).select(X.stable_id("obs", F.lit("a"), F.lit(None).cast("string"), F.lit(2))).first()[0] == want


@pytest.mark.parametrize("text,items", [(None, []), (" ", []), ("a; b;;", ["a", "b"]), ("a|b", ["a", "b"]), ("a;b|c", ["a", "b|c"]), ('["a", "b;c"]', ["a", "b;c"]), ("[broken", ["[broken"]), ("one", ["one"])])
def test_lists(spark, text, items):
    assert one(spark, text, "string", X.to_list) == items


@pytest.mark.parametrize("text,value", [("123,5", 123.5), (" 1e3 ", 1000.0), ("1.5d", None), ("", None), (None, None), ("x", None), (".5", 0.5), ("1_000", None)])
def test_floats_of_cells(spark, text, value):
    assert one(spark, text, "string", X.to_float) == value


@pytest.mark.parametrize("text,compat,strict", [("Ti-6Al 4V", "ti6al4v", "ti6al4v"), ("Твердость", "", "твердость"), (" ?! ", "", "?!"), ("ВТ6", "6", "вт6")])
def test_name_keys(spark, text, compat, strict):
    assert one(spark, text, "string", X.norm_name) == compat and one(spark, text, "string", X.strict_norm) == strict


def test_bags(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": None})], "l map<string,string>, r map<string,string>")
    assert df.select(X.merge_maps(F.col("l"), F.col("r"))).first()[0] == {"a": "1", "b": "3", "c": None}
    assert one(spark, '{"k": [1, 2]}', "string", X.to_map) == {"k": "[1,2]"} and one(spark, "no", "string", X.to_map) == {} and one(spark, None, "string", X.to_map) == {}
    assert one(spark, None, "double", X.clamp) is None and one(spark, 3.0, "double", X.clamp) == 1.0


def test_float_text_of_all_values(spark, tmp_path):
    from lodeworks.plans.graph import QUERIES

    values = [0.0, -0.0, -1.5, -2.5e-4, 5e-4, 1e-5, 1.25e-7, 12345678.9, 1e7, -1e22, 1.7976931348623157e308, 2.2250738585072014e-308, float("inf"), float("-inf"), float("nan"), 3.5, None]
    rows = [(1, [(v,) for v in values]), (2, None), (3, [None])]
    spark.createDataFrame(rows, "exp_row bigint, observations array<struct<value:double>>").write.parquet(str(tmp_path / "experiments.parquet"))
    got = {(r.exp_row, r.obs_no): r.text for r in QUERIES["float_text_all"](spark, str(tmp_path)).collect()}
    assert got == {(1, k): str(v) for k, v in enumerate(values) if v is not None}
