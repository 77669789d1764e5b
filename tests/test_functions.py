import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from labelvec import functions as V
from labelvec.plans.network import dropout_factors


def one(spark, value, schema, column):
    return spark.createDataFrame([(value,)], f"v {schema}").select(column.alias("r")).first().r


def test_csv_line_round_trip(spark):
    assert one(spark, [0, 255, 7], "array<int>", V.to_csv_line(F.col("v"))) == "0,255,7"
    assert one(spark, [0.0, 1.0], "array<double>", V.to_csv_line(F.col("v"))) == "0.0,1.0"
    assert one(spark, "1,2.5,-3", "string", V.from_csv_line(F.col("v"))) == [1.0, 2.5, -3.0]


def test_empty_line_is_an_empty_vector(spark):
    assert one(spark, "", "string", V.from_csv_line(F.col("v"))) == []


@pytest.mark.parametrize("line", ["1,,2", "1,x", ","])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_bad_field_is_an_error(spark, line, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(PySparkException, match="not a double field"):
            one(spark, line, "string", V.from_csv_line(F.col("v")))
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


@pytest.mark.parametrize("line", ["", "1.5,2"])
def test_int_lines_are_strict(spark, line):
    with pytest.raises(PySparkException, match="not a int field"):
        one(spark, line, "string", V.from_csv_line(F.col("v"), "int", allow_empty=False))


def test_combined_line(spark):
    df = spark.createDataFrame([(3, [1, 2])], "l int, v array<int>")
    line = df.select(V.combined_line(F.col("l"), F.col("v")).alias("v"))
    assert line.first().v == "3|1,2"
    label, image = V.split_combined_line(F.col("v"))
    assert tuple(line.select(label, image).first()) == (3, [1, 2])
    with pytest.raises(PySparkException, match="label\\|vector"):
        one(spark, "3", "string", V.split_combined_line(F.col("v"))[0])


@pytest.mark.parametrize("channels", [None, 1, 3])
def test_reshape_inverts_flatten(spark, channels):
    h, w = 4, 5
    flat = list(range(h * w * (channels or 1)))
    shaped = one(spark, flat, "array<int>", V.reshape_image(F.col("v"), h, w, channels))
    expected = np.array(flat).reshape((h, w) if channels is None else (h, w, channels)).tolist()
    assert shaped == expected
    back = V.flatten_image(V.reshape_image(F.col("v"), h, w, channels), channels is not None)
    assert one(spark, flat, "array<int>", back) == flat


def test_reshape_checks_the_length(spark):
    with pytest.raises(PySparkException, match="cannot reshape"):
        one(spark, [1, 2, 3], "array<int>", V.reshape_image(F.col("v"), 2, 2))


def test_one_hot_and_argmax(spark):
    assert one(spark, 2, "int", V.one_hot(F.col("v"), 4)) == [0.0, 0.0, 1.0, 0.0]
    with pytest.raises(PySparkException, match="outside range"):
        one(spark, 4, "int", V.one_hot(F.col("v"), 4))
    # A tie goes to the lowest index.
    assert one(spark, [1.0, 5.0, 5.0], "array<double>", V.argmax(F.col("v"))) == 1


def test_uint8(spark):
    assert one(spark, [0.9, 255.0], "array<double>", V.uint8(F.col("v"))) == [0, 255]
    with pytest.raises(PySparkException, match="outside 0..255"):
        one(spark, [256.0], "array<double>", V.uint8(F.col("v")))


def test_normalize(spark):
    assert one(spark, [0, 51, 255], "array<int>", V.normalize(F.col("v"))) == [0.0, 51 / 255.0, 1.0]


def test_clip_loss_below_the_limit(spark):
    df = spark.createDataFrame([([0.0, 1.0], [1e-30, 1.0], [1.0, 0.0])], "l array<double>, p array<double>, m array<double>")
    right = V.clipped_cross_entropy(F.col("l"), F.col("p"), 2)
    wrong = V.clipped_cross_entropy(F.col("m"), F.col("p"), 2)
    a, b = df.select(right, wrong).first()
    assert a == 0.0
    assert b == pytest.approx(-math.log(1e-10))


def test_logit_loss_does_not_overflow(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1000.0, -1000.0])], "l array<double>, z array<double>")
    assert df.select(V.logit_cross_entropy(F.col("l"), F.col("z"), 2).alias("r")).first().r == 0.0
    assert df.select(V.softmax(F.col("z")).alias("r")).first().r == [1.0, 0.0]


def test_prediction_line(spark):
    df = spark.createDataFrame([(7, 2)], "l int, p int")
    assert df.select(V.prediction_line(F.col("l"), F.col("p"))).first()[0] == "Label: 7, Prediction: 2"
    stamped = df.select(V.prediction_line(F.col("l"), F.col("p"), F.lit("2020-01-02 03:04:05").cast("timestamp")))
    assert stamped.first()[0] == "2020-01-02T03:04:05.000000 Label: 7, Prediction: 2"


def test_dropout_mask_matches_the_task_side(spark):
    ids = np.array([0, 1, 17, 2**40])
    column = V.dropout_mask(F.col("id"), 500, F.lit(3), 11, 0.9)
    df = spark.createDataFrame([(int(i),) for i in ids], "id long").select(column.alias("m"))
    got = np.array([r.m for r in df.collect()])
    assert np.array_equal(got, dropout_factors(ids, 500, 3, 11, 0.9))


def test_dropout_mask_keeps_the_right_share():
    mask = dropout_factors(np.arange(2000), 500, 1, 5, 0.9)
    assert abs((mask > 0).mean() - 0.9) < 0.002
    assert abs((mask > 0).mean(axis=0) - 0.9).max() < 0.04
    assert abs((mask > 0).mean(axis=1) - 0.9).max() < 0.08
    assert not np.array_equal(mask, dropout_factors(np.arange(2000), 500, 2, 5, 0.9))
