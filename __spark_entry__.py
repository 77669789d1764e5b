"""

``embeddings`` stands in for the sample table: a vector becomes an 8 x 8 image of
pixels 0..255. Weights come from a closed formula that SQL can repeat.
"""

from __future__ import annotations

import dataclasses
import pathlib
import re
import sys
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from labelvec import functions as V, sources  # noqa: E402
from labelvec.functions import draws, permutation, vectors  # noqa: E402
from labelvec.operators import metrics as M, pairing, positions, verify  # noqa: E402
from labelvec.plans import checkpoints, jobs, scoring, state_rows, training  # noqa: E402
from labelvec.plans.network import NetSpec, Tensors, gradient, initial_values, spec_a, spec_b  # noqa: E402
from labelvec.plans.optimizers import Adagrad, Adam  # noqa: E402
from labelvec.plans.partials import dataset_sums  # noqa: E402
from labelvec.plans.training import count_dense  # noqa: E402
from labelvec.session import ship_package, staging_path  # noqa: E402
from labelvec.sources import write_samples  # noqa: E402
from labelvec.streaming import feed, online  # noqa: E402
from labelvec.testing import write_idx_files  # noqa: E402

INPUTS, HIDDEN, CLASSES, SIDE = 64, 8, 10, 8
BATCH = 100
SMALL_A = spec_a(inputs=INPUTS, hidden=HIDDEN, centered=True)
SMALL_B = spec_b(inputs=INPUTS, hidden=HIDDEN, centered=True)
QueryFn = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, QueryFn] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under its function name or ``name``, with its SQL when there is one."""

    def add(fn: QueryFn) -> QueryFn:
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        _queries[key] = run
        if sql is not None:
            _sql[key] = sql
        return fn

    return add


# ---------------------------------------------------------------- inputs


def samples_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, embedding, cls, image, one-hot label, split)."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("sample_id"),
        "embedding",
        F.col("label").alias("cls"),
        V.quantize(F.col("embedding")).alias("image"),
        V.one_hot(F.col("label"), CLASSES).alias("label"),
        F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("split"),
    )


def formula_weights(spec: NetSpec) -> Tensors:
    def f(i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
        return ((i * i * 7 + i * j * 13 + j * 29 + k) % 101) / 101.0 - 0.5

    def grid(rows: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(rows)[:, None], np.arange(columns)[None, :]

    zero = np.zeros(1, int)
    values = (
        f(*grid(INPUTS, HIDDEN), 0),
        0.1 * f(zero, np.arange(HIDDEN), 5),
        4.0 * f(*grid(HIDDEN, CLASSES), 11),
        0.1 * f(zero, np.arange(CLASSES), 23),
    )
    return dict(zip(spec.names, values))


def scored(
    spark: SparkSession,
    sf_dir: str,
    spec: NetSpec,
    keep: tuple[str, ...] = ("sample_id", "cls"),
    where: str = "true",
) -> DataFrame:
    rows = samples_of(spark, sf_dir).where(where)
    return scoring.forward(rows, spec, formula_weights(spec), keep=keep)


def batch_of(sample_id: str = "sample_id") -> Column:
    return F.expr(f"{sample_id} div {BATCH}").alias("batch_id")


def rounded(column: Column | str) -> Column:
    return F.round(column, 6)


def line_of(column: Column | str) -> Column:
    return V.to_csv_line(F.col(column) if isinstance(column, str) else column)


def tensor_rows(spark: SparkSession, tensors: Tensors) -> DataFrame:
    """(tensor, i, value) rows, rounded for comparison."""
    values = M.tensor_values(checkpoints.weights_frame(spark, tensors, 0))
    return values.select("tensor", "i", rounded("value").alias("value"))


# SQL counterparts. Each entry may use those before it.
F_SQL = "(({i}*{i}*7 + {i}*{j}*13 + {j}*29 + {k}) % 101) / 101.0 - 0.5"


def _f(i: str, j: str, k: int) -> str:
    return F_SQL.format(i=i, j=j, k=k)


_CTES = {
    "px": """
SELECT vec_id AS sample_id, label AS cls, embedding, vec_id // 100 AS batch_id,
  CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
  list_transform(embedding, lambda v: CAST(floor(least(greatest(
    (CAST(v AS DOUBLE) + 1.0) * 127.5, 0.0), 255.0)) AS INTEGER)) AS image
FROM embeddings""",
    "x": """
SELECT sample_id, cls, i, 2.0 * (p / 255.0) - 1.0 AS x
FROM (SELECT sample_id, cls, unnest(image) AS p, generate_subscripts(image, 1) - 1 AS i FROM px)""",
    "hid_w": f"""
SELECT i, j, {_f('i', 'j', 0)} AS w FROM range(64) a(i), range(8) b(j)""",
    "hid_b": f"""
SELECT j, 0.1 * ({_f('0', 'j', 5)}) AS b FROM range(8) b(j)""",
    "sm_w": f"""
SELECT j, k, 4.0 * ({_f('j', 'k', 11)}) AS w FROM range(8) a(j), range(10) b(k)""",
    "sm_b": f"""
SELECT k, 0.1 * ({_f('0', 'k', 23)}) AS b FROM range(10) b(k)""",
    "pre": """
SELECT sample_id, cls, j, s + b AS pre FROM (
  SELECT x.sample_id, x.cls, hid_w.j, sum(x.x * hid_w.w) AS s
  FROM x JOIN hid_w ON x.i = hid_w.i GROUP BY x.sample_id, x.cls, hid_w.j) JOIN hid_b USING (j)""",
    "hid": "SELECT sample_id, cls, j, pre, greatest(pre, 0.0) AS h FROM pre",
    "z": """
SELECT sample_id, cls, k, s + b AS z FROM (
  SELECT hid.sample_id, hid.cls, sm_w.k, sum(hid.h * sm_w.w) AS s
  FROM hid JOIN sm_w ON hid.j = sm_w.j GROUP BY hid.sample_id, hid.cls, sm_w.k)
JOIN sm_b USING (k)""",
    "zm": "SELECT *, z - max(z) OVER (PARTITION BY sample_id) AS d FROM z",
    "y": "SELECT *, exp(d) / sum(exp(d)) OVER (PARTITION BY sample_id) AS y FROM zm",
    "pred": """
SELECT sample_id, cls, CAST(k AS INTEGER) AS prediction FROM z
QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY z DESC, k) = 1""",
    "row_loss": """
SELECT sample_id, cls, sum(CASE WHEN k = cls THEN -ln(greatest(least(y, 1.0), 1e-10)) END) AS loss_a,
  ln(sum(exp(d))) - sum(CASE WHEN k = cls THEN d END) AS loss_b
FROM y GROUP BY sample_id, cls""",
    "dz_a": """
SELECT sample_id, k, (g - sum(g * y) OVER (PARTITION BY sample_id)) * y AS dz FROM (
  SELECT *, CASE WHEN k = cls AND y >= 1e-10 AND y <= 1.0 THEN -1.0 / greatest(least(y, 1.0), 1e-10)
    ELSE 0.0 END AS g FROM y)""",
    "dz_b": "SELECT sample_id, k, y - CAST(k = cls AS INTEGER) AS dz FROM y",
}


def _gradient_ctes(kind: str) -> dict[str, str]:
    names = {
        "a": ("hid_w", "hid_b", "sm_w", "sm_b"),
        "b": ("layer1/weights", "layer1/biases", "layer2/weights", "layer2/biases"),
    }[kind]
    scale = "" if kind == "a" else " / (SELECT count(*) FROM px)"
    return {
        "dh": f"""
SELECT hid.sample_id, hid.j, CASE WHEN any_value(hid.pre) > 0 THEN sum(dz.dz * sm_w.w) ELSE 0.0 END AS dh
FROM hid JOIN sm_w ON hid.j = sm_w.j JOIN dz_{kind} dz
  ON dz.sample_id = hid.sample_id AND dz.k = sm_w.k
GROUP BY hid.sample_id, hid.j""",
        "grad": f"""
SELECT '{names[0]}' AS tensor, CAST(x.i * 8 + dh.j AS INTEGER) AS i, sum(x.x * dh.dh){scale} AS g, any_value(w.w) AS w
FROM x JOIN dh ON x.sample_id = dh.sample_id JOIN hid_w w ON w.i = x.i AND w.j = dh.j GROUP BY x.i, dh.j
UNION ALL SELECT '{names[1]}', CAST(dh.j AS INTEGER), sum(dh.dh){scale}, any_value(b.b)
FROM dh JOIN hid_b b ON b.j = dh.j GROUP BY dh.j
UNION ALL SELECT '{names[2]}', CAST(hid.j * 10 + dz.k AS INTEGER), sum(hid.h * dz.dz){scale}, any_value(w.w)
FROM hid JOIN dz_{kind} dz ON dz.sample_id = hid.sample_id
JOIN sm_w w ON w.j = hid.j AND w.k = dz.k GROUP BY hid.j, dz.k
UNION ALL SELECT '{names[3]}', CAST(dz.k AS INTEGER), sum(dz.dz){scale}, any_value(b.b)
FROM dz_{kind} dz JOIN sm_b b ON b.k = dz.k GROUP BY dz.k""",
    }


def sql(select: str, last: str = "px", extra: dict[str, str] | None = None) -> str:
    """WITH all common tables up to ``last``, then ``extra`` ones, then the select."""
    parts = []
    for name, body in _CTES.items():
        parts.append(f"{name} AS ({body})")
        if name == last:
            break
    parts += [f"{name} AS ({body})" for name, body in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + select


SQL_LINE = "array_to_string(image, ',')"
SQL_ONE_HOT = (
    "array_to_string(list_transform(range(10), lambda c: CASE WHEN c = {} THEN '1.0' "
    "ELSE '0.0' END), ',')"
)


def sql_round(expression: str) -> str:
    # Adding zero turns a negative zero into a plain one.
    return f"round({expression}, 6) + 0.0"


# ---------------------------------------------------------------- projections


@query(sql(f"SELECT sample_id, {SQL_LINE} AS image_line, {SQL_ONE_HOT.format('cls')} AS label_line FROM px"))
def csv_encode(spark, sf_dir):
    return samples_of(spark, sf_dir).select(
        "sample_id", line_of("image").alias("image_line"), line_of("label").alias("label_line")
    )


@query(sql(f"SELECT sample_id, cls || '|' || {SQL_LINE} AS line FROM px"))
def csv2_encode(spark, sf_dir):
    return samples_of(spark, sf_dir).select(
        "sample_id", V.combined_line(F.col("cls"), F.col("image")).alias("line")
    )


@query(sql(f"SELECT sample_id, {SQL_LINE} AS line, len(image) AS pixels FROM px"))
def flatten_image(spark, sf_dir):
    nested = samples_of(spark, sf_dir).select(
        "sample_id", V.reshape_image(F.col("image"), SIDE, SIDE, 1).alias("nested")
    )
    flat = V.flatten_image(F.col("nested"), channels=True)
    return nested.select(
        "sample_id", line_of(flat).alias("line"), F.size(flat).cast("bigint").alias("pixels")
    )


@query(
    sql(
        "SELECT sample_id, CAST(r AS INTEGER) AS row_no, "
        "array_to_string(image[r * 8 + 1 : r * 8 + 8], ',') AS line FROM px, range(8) t(r)"
    )
)
def reshape_image(spark, sf_dir):
    nested = samples_of(spark, sf_dir).select(
        "sample_id",
        F.posexplode(V.reshape_image(F.col("image"), SIDE, SIDE)).alias("row_no", "pixels"),
    )
    return nested.select("sample_id", "row_no", line_of("pixels").alias("line"))


@query(
    sql(
        "SELECT sample_id, CAST(generate_subscripts(image, 1) - 1 AS INTEGER) AS pos, "
        "unnest(image) / 255.0 AS x FROM px"
    )
)
def normalize_pixels(spark, sf_dir):
    return samples_of(spark, sf_dir).select(
        "sample_id", F.posexplode(V.normalize(F.col("image"))).alias("pos", "x")
    )


@query(
    sql(
        "SELECT sample_id, array_to_string(list_transform(range(10), "
        "lambda c: CASE WHEN c = cls THEN '1' ELSE '0' END), ',') AS line FROM px"
    )
)
def label_uint8(spark, sf_dir):
    return samples_of(spark, sf_dir).select(
        "sample_id", line_of(V.uint8(F.col("label"))).alias("line")
    )


@query(
    sql(
        "SELECT sample_id, CAST(c AS INTEGER) AS k, CAST(c = cls AS INTEGER)::DOUBLE AS value "
        "FROM px, range(10) t(c)"
    )
)
def onehot_encode(spark, sf_dir):
    return samples_of(spark, sf_dir).select(
        "sample_id", F.posexplode(V.one_hot(F.col("cls"), CLASSES)).alias("k", "value")
    )


@query(
    sql(
        "SELECT sample_id, cls AS decoded, "
        "list_position(embedding, list_max(embedding)) - 1 AS strongest FROM px"
    )
)
def onehot_decode(spark, sf_dir):
    return samples_of(spark, sf_dir).select(
        "sample_id",
        V.argmax(F.col("label")).alias("decoded"),
        V.argmax(F.col("embedding")).alias("strongest"),
    )


DROPOUT_UNITS, DROPOUT_KEEP, DROPOUT_RUN_SEED = 16, 0.9, 7


@query(
    f"""
WITH m AS (SELECT vec_id, u, (vec_id % 2147483647 * 48271 + (vec_id // {BATCH}) % 2147483647 * 16807
    + {DROPOUT_RUN_SEED}::BIGINT * 39373 + u * 69621) % 2147483647 AS a
  FROM embeddings, range({DROPOUT_UNITS}) t(u)),
s AS (SELECT *, a * a % 2147483647 AS b FROM m)
SELECT vec_id AS sample_id, CAST(u AS INTEGER) AS unit,
  CASE WHEN b * b % 2147483647 * a % 2147483647 < {DROPOUT_KEEP}::DOUBLE * 2147483647
    THEN 1.0::DOUBLE / {DROPOUT_KEEP}::DOUBLE ELSE 0.0::DOUBLE END AS factor FROM s"""
)
def dropout_mask(spark, sf_dir):
    factors = V.dropout_mask(
        F.col("sample_id"), DROPOUT_UNITS, batch_of(), DROPOUT_RUN_SEED, DROPOUT_KEEP
    )
    return samples_of(spark, sf_dir).select(
        "sample_id", F.posexplode(factors).alias("unit", "factor")
    )


# ---------------------------------------------------------------- formats


def _vector_stats(vector: str) -> list[Column]:
    """Length, sum and position-weighted sum of a vector, without exploding it."""
    values = F.transform(vector, lambda v: v.cast("double"))

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda acc, v: acc + v)

    return [
        F.size(vector).cast("bigint").alias("n"),
        total(values).alias("total"),
        total(F.transform(values, lambda v, i: v * (i + 1))).alias("weighted"),
    ]


SQL_STATS = (
    "CAST(len({0}) AS BIGINT) AS n, CAST(list_sum({0}) AS DOUBLE) AS total, "
    "CAST(list_sum(list_transform({0}, lambda v, i: v * i)) AS DOUBLE) AS weighted"
)
SQL_HOT_LIST = "list_transform(range(10), lambda c: CAST(c = cls AS INTEGER))"


@query(sql(f"SELECT {SQL_STATS.format('image')} FROM px"))
def csv_decode(spark, sf_dir):
    path = staging_path(spark, "csv")
    samples_of(spark, sf_dir).select(line_of("image").alias("value")).write.text(path)
    return sources.read_vectors(spark, path).select(*_vector_stats("vector"))


@query(
    sql(
        f"SELECT 'image' AS side, {SQL_STATS.format('image')} FROM px UNION ALL "
        f"SELECT 'label', {SQL_STATS.format(SQL_HOT_LIST)} FROM px"
    )
)
def csv_decode_typed(spark, sf_dir):
    path = staging_path(spark, "csv")
    sources.write_csv_pair(samples_of(spark, sf_dir), path)
    images = sources.read_vectors(spark, f"{path}/images", "int", allow_empty=False)
    labels = sources.read_vectors(spark, f"{path}/labels", "double", allow_empty=False)
    return images.select(F.lit("image").alias("side"), *_vector_stats("vector")).union(
        labels.select(F.lit("label").alias("side"), *_vector_stats("vector"))
    )


@query(sql(f"SELECT {SQL_LINE} AS image_line, cls AS label FROM px"))
def csv_pair_roundtrip(spark, sf_dir):
    path = staging_path(spark, "csv")
    sources.write_csv_pair(samples_of(spark, sf_dir), path)
    pairs = sources.read_csv_pair(spark, f"{path}/images", f"{path}/labels")
    return pairs.select(line_of("image").alias("image_line"), V.argmax(F.col("label")).alias("label"))


@query(sql(f"SELECT {SQL_LINE} AS image_line, cls AS label FROM px"))
def csv2_roundtrip(spark, sf_dir):
    path = staging_path(spark, "csv2")
    sources.write_combined(samples_of(spark, sf_dir).withColumn("label", F.col("cls")), path)
    return sources.read_combined(spark, path).select(line_of("image").alias("image_line"), "label")


@query(sql(f"SELECT sample_id, split, {SQL_LINE} AS image_line, cls AS label FROM px"))
def columnar_roundtrip(spark, sf_dir):
    path = staging_path(spark, "samples")
    sources.write_samples(
        samples_of(spark, sf_dir).select("sample_id", "image", "label", "split"), path
    )
    return sources.read_samples(spark, path).select(
        "sample_id",
        F.col("split").cast("string").alias("split"),
        line_of("image").alias("image_line"),
        V.argmax(F.col("label")).alias("label"),
    )


@query(sql(f"SELECT {SQL_LINE} AS image_line, cls AS label FROM px"))
def tfrecord_roundtrip(spark, sf_dir):
    path = staging_path(spark, "records")
    sources.write_tfrecord(samples_of(spark, sf_dir), path)
    return sources.read_tfrecord(spark, path).select(
        line_of("image").alias("image_line"), V.argmax(F.col("label")).alias("label")
    )


@query(sql(f"SELECT sample_id, {SQL_LINE} AS image_line, cls AS label FROM px"))
def idx_read(spark, sf_dir):
    path = staging_path(spark, "idx")
    write_idx_files(
        samples_of(spark, sf_dir).withColumn("label", F.col("cls")), path, SIDE, SIDE
    )
    pairs = sources.read_idx_pair(spark, f"{path}/images", f"{path}/labels", classes=CLASSES)
    return pairs.select(
        "sample_id", line_of("image").alias("image_line"), V.argmax(F.col("label")).alias("label")
    )


@query("SELECT CAST(10 AS BIGINT) AS n_partitions, count(*) AS n_rows FROM embeddings")
def partition_counts(spark, sf_dir):
    counts = verify.partition_counts(samples_of(spark, sf_dir), 10)
    return counts.agg(F.count("*").alias("n_partitions"), F.sum("n_rows").alias("n_rows"))


@query(sql(f"SELECT sample_id, {SQL_LINE} AS image_line, cls AS label FROM px WHERE split = 'test'"))
def split_filter(spark, sf_dir):
    path = staging_path(spark, "samples")
    sources.write_samples(
        samples_of(spark, sf_dir).select("sample_id", "image", "label", "split"), path
    )
    return sources.read_samples(spark, path, split="test").select(
        "sample_id", line_of("image").alias("image_line"), V.argmax(F.col("label")).alias("label")
    )


# ---------------------------------------------------------------- pairing and checks


def _ordered_text(samples: DataFrame, column: str, path: str, n: int) -> None:
    """Text files whose lines, over all files in name order, follow the ``n`` ids; four at least."""
    partitions = max(4, -(-n // 100_000))
    part = F.expr(f"cast(sample_id * {partitions} div {n} as int)")
    (
        samples.select("sample_id", column)
        .repartitionById(partitions, part)
        .sortWithinPartitions("sample_id")
        .select(line_of(column).alias("value"))
        .write.text(path)
    )


@query(sql(f"SELECT sample_id, {SQL_LINE} AS image_line, cls AS label FROM px"))
def pair_images_labels(spark, sf_dir):
    path = staging_path(spark, "ordered")
    samples = samples_of(spark, sf_dir)
    n = count_dense(samples)
    for column in ("image", "label"):
        _ordered_text(samples, column, f"{path}/{column}", n)
    pairs = sources.read_csv_pair(spark, f"{path}/image", f"{path}/label")
    return pairs.select(
        "sample_id", line_of("image").alias("image_line"), V.argmax(F.col("label")).alias("label")
    )


@query(
    """SELECT vec_id AS sample_id, CASE WHEN embedding[1] > 0 THEN 'left' ELSE 'right' END AS side
FROM embeddings WHERE (embedding[1] > 0) <> (embedding[2] > 0)"""
)
def pair_unmatched(spark, sf_dir):
    samples = samples_of(spark, sf_dir)
    return pairing.unmatched_ids(
        samples.where(F.col("embedding")[0] > 0), samples.where(F.col("embedding")[1] > 0)
    )


@query("SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS sample_id FROM embeddings WHERE vec_id % 5 <> 0")
def dense_ids(spark, sf_dir):
    train = samples_of(spark, sf_dir).where("split = 'train'")
    return positions.with_dense_id(train.select(F.col("sample_id").alias("vec_id")), ["vec_id"])


@query("SELECT count(*) AS num_images, count(*) AS num_labels, CAST(0 AS BIGINT) AS unmatched FROM embeddings")
def verify_counts(spark, sf_dir):
    path = staging_path(spark, "csv")
    sources.write_csv_pair(samples_of(spark, sf_dir), path)
    found = verify.verify_text_pair(spark, f"{path}/images", f"{path}/labels")
    return found.select("num_images", "num_labels", F.col("incomplete").alias("unmatched"))


@query(
    sql(
        "SELECT count(image) AS num_images, count(cls) AS num_labels, "
        "CAST(min(len(image)) AS INTEGER) AS min_dim, CAST(max(len(image)) AS INTEGER) AS max_dim, "
        "CAST(0 AS BIGINT) AS incomplete FROM px"
    )
)
def verify_dataset(spark, sf_dir):
    path = staging_path(spark, "csv")
    jobs.store(samples_of(spark, sf_dir), path, "csv")
    return jobs.verify(spark, path, "csv")


DIGESTS = ("csv", "csv2", "tfr", "parquet")


def _digest_sql(fmt: str) -> str:
    row = f"{'sample_id || ' + repr('|') + ' || ' if fmt == 'parquet' else ''}{SQL_LINE} || '|' || {SQL_ONE_HOT.format('cls')}"
    halves = " || ':' || ".join(f"CAST(sum(CAST('0x' || substr(h, {k}, 16) AS UBIGINT)) AS VARCHAR)" for k in (1, 17))
    return f"SELECT '{fmt}' AS fmt, count(*) AS n_rows, {halves} AS digest FROM (SELECT md5({row}) AS h FROM px)"


@query(sql(" UNION ALL ".join(map(_digest_sql, DIGESTS))))
def dataset_digest(spark, sf_dir):
    """The table in four formats: each is written, read back and compared with what passed the writer."""
    samples = samples_of(spark, sf_dir).select("sample_id", "image", "label")
    rows = None
    for fmt in DIGESTS:
        path = staging_path(spark, f"digest-{fmt}")
        found = jobs.store_verified(samples, path, fmt)
        part = jobs.load(spark, path, fmt).agg(F.count("*").alias("n_rows")).select(F.lit(fmt).alias("fmt"), "n_rows", F.lit(found).alias("digest"))
        rows = part if rows is None else rows.union(part)
    return rows


@query(sql(f"SELECT sample_id, {SQL_LINE} AS image_line, cls AS label FROM px ORDER BY sample_id LIMIT 10"))
def sample_head(spark, sf_dir):
    return verify.sample_head(samples_of(spark, sf_dir)).select(
        "sample_id", line_of("image").alias("image_line"), V.argmax(F.col("label")).alias("label")
    )


# ---------------------------------------------------------------- scoring


@query(sql(f"SELECT sample_id, CAST(k AS INTEGER) AS k, {sql_round('y')} AS prob FROM y", "y"))
def forward_a(spark, sf_dir):
    out = scored(spark, sf_dir, SMALL_A)
    return out.select("sample_id", F.posexplode("output").alias("k", "prob")).withColumn(
        "prob", rounded("prob")
    )


@query(sql(f"SELECT sample_id, CAST(k AS INTEGER) AS k, {sql_round('z')} AS logit FROM z", "z"))
def forward_b(spark, sf_dir):
    out = scored(spark, sf_dir, SMALL_B)
    return out.select("sample_id", F.posexplode("output").alias("k", "logit")).withColumn(
        "logit", rounded("logit")
    )


@query(sql("SELECT sample_id, cls AS label, prediction FROM pred", "pred"))
def predict(spark, sf_dir):
    return scoring.predict(samples_of(spark, sf_dir), SMALL_A, formula_weights(SMALL_A))


@query(
    sql("SELECT 'Label: ' || cls || ', Prediction: ' || prediction AS line FROM pred", "pred")
)
def predict_text(spark, sf_dir):
    path = staging_path(spark, "predictions")
    sources.write_predictions(predict(spark, sf_dir), path, timestamps=False)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    sql(
        f"SELECT sample_id // {BATCH} AS batch_id, "
        f"{sql_round('avg(CAST(prediction = cls AS INTEGER))')} AS accuracy, count(*) AS n_rows "
        "FROM pred GROUP BY 1",
        "pred",
    )
)
def batch_accuracy(spark, sf_dir):
    scores = predict(spark, sf_dir).withColumn("batch_id", batch_of())
    return M.accuracy(scores, "batch_id").withColumn("accuracy", rounded("accuracy"))


@query(
    sql(
        f"SELECT {sql_round('avg(CAST(prediction = cls AS INTEGER))')} AS accuracy, "
        "count(*) AS n_rows FROM pred",
        "pred",
    )
)
def accuracy(spark, sf_dir):
    return M.accuracy(predict(spark, sf_dir)).withColumn("accuracy", rounded("accuracy"))


# The saturated loss multiplies logits by 60, so that clipping takes part.
@query(
    sql(
        f"SELECT sample_id // {BATCH} AS batch_id, {sql_round('sum(loss)')} AS loss, "
        f"{sql_round('sum(saturated)')} AS saturated_loss FROM ("
        "SELECT sample_id, sum(CASE WHEN k = cls THEN -ln(greatest(least(y, 1.0), 1e-10)) END) AS loss, "
        "-ln(greatest(least(sum(CASE WHEN k = cls THEN exp(60.0 * d) END) / sum(exp(60.0 * d)), 1.0), "
        "1e-10)) AS saturated FROM y GROUP BY sample_id) GROUP BY 1",
        "y",
    )
)
def clip_loss(spark, sf_dir):
    logits = scored(spark, sf_dir, SMALL_B, ("sample_id", "label"))
    loss = V.clipped_cross_entropy(F.col("label"), F.col("probs"), CLASSES)
    saturated = F.transform("output", lambda z: z * 60.0)
    for name, values in (("loss", F.col("output")), ("saturated_loss", saturated)):
        logits = logits.withColumn("probs", V.softmax(values)).withColumn(name, loss)
    return logits.groupBy(batch_of()).agg(
        *[rounded(F.sum(name)).alias(name) for name in ("loss", "saturated_loss")]
    )


@query(
    sql(
        f"SELECT sample_id // {BATCH} AS batch_id, {sql_round('avg(loss_b)')} AS cross_entropy "
        "FROM row_loss GROUP BY 1",
        "row_loss",
    )
)
def logit_loss(spark, sf_dir):
    logits = scored(spark, sf_dir, SMALL_B, ("sample_id", "label")).withColumn(
        "batch_id", batch_of()
    )
    loss = V.logit_cross_entropy(F.col("label"), F.col("output"), CLASSES)
    return M.mean_loss(logits, loss, "batch_id").withColumn(
        "cross_entropy", rounded("cross_entropy")
    )


# ---------------------------------------------------------------- summaries


def _class_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as rows of a weights table, one tensor name per class."""
    vectors = samples_of(spark, sf_dir).select(
        F.concat(F.lit("class_"), F.col("cls")).alias("tensor"),
        F.array(F.size("embedding")).alias("shape"),
        F.col("embedding").cast("array<double>").alias("data"),
    )
    return M.tensor_values(vectors)


SQL_VALUES = (
    "(SELECT 'class_' || label AS tensor, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
)


@query(
    f"SELECT tensor, {sql_round('avg(value)')} AS mean, {sql_round('stddev_pop(value)')} AS stddev, "
    f"{sql_round('max(value)')} AS max, {sql_round('min(value)')} AS min "
    f"FROM {SQL_VALUES} GROUP BY tensor"
)
def tensor_summary(spark, sf_dir):
    summary = M.tensor_summary(_class_tensors(spark, sf_dir))
    return summary.select(
        "tensor", *[rounded(c).alias(c) for c in ("mean", "stddev", "max", "min")]
    )


@query(
    "SELECT tensor, CAST(floor((value - -1.0::DOUBLE) / 0.05::DOUBLE) AS BIGINT) AS bucket, count(*) AS n "
    f"FROM {SQL_VALUES} GROUP BY 1, 2"
)
def tensor_histogram(spark, sf_dir):
    return M.tensor_histogram(_class_tensors(spark, sf_dir), -1.0, 0.05)


def _sql_bucket(value: str) -> str:
    return f"CAST(floor({value} / 0.5) AS BIGINT)"


SQL_ACTIVATIONS = sql(
    "SELECT tensor, bucket, count(*) AS n FROM ("
    f"SELECT 'layer1/pre_activations' AS tensor, {_sql_bucket('pre')} AS bucket FROM hid "
    f"UNION ALL SELECT 'layer1/activations', {_sql_bucket('h')} FROM hid "
    f"UNION ALL SELECT unnest(['layer2/pre_activations', 'layer2/activations']), {_sql_bucket('z')} FROM z) "
    "GROUP BY 1, 2",
    "z",
)


@query(SQL_ACTIVATIONS)
def activation_histogram(spark, sf_dir):
    return scoring.activation_histogram(
        samples_of(spark, sf_dir), SMALL_B, formula_weights(SMALL_B)
    )


def _step_metrics(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """(writer, step, tag, value): loss and accuracy of each split's share of a batch."""
    rows = scored(spark, sf_dir, SMALL_A, ("sample_id", "cls", "label", "split"), where)
    loss = V.clipped_cross_entropy(F.col("label"), F.col("output"), CLASSES)
    values = rows.groupBy(F.col("split").alias("writer"), batch_of().alias("step")).agg(
        F.sum(loss).alias("loss"),
        F.avg((F.col("prediction") == F.col("cls")).cast("double")).alias("acc"),
    )
    pairs = F.array(
        *[F.struct(F.lit(t).alias("tag"), rounded(t).alias("value")) for t in ("loss", "acc")]
    )
    return values.select("writer", "step", F.inline(pairs))


def _metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, appended to a metric table and read back."""
    path = staging_path(spark, "model")
    values = _step_metrics(spark, sf_dir)
    checkpoints.write_metrics(values, path, "run", upto=0)
    return checkpoints.read_metrics(spark, path)


_STEP_CTES = {
    "steps": f"""
SELECT px.split AS writer, l.sample_id // {BATCH} AS step,
  {sql_round('sum(loss_a)')} AS loss, {sql_round('avg(CAST(prediction = l.cls AS INTEGER))')} AS acc
FROM row_loss l JOIN pred USING (sample_id) JOIN px USING (sample_id) GROUP BY 1, 2"""
}


@query(
    sql(
        "SELECT 'run' AS run_id, writer, step, 'loss' AS tag, loss AS value FROM steps "
        "UNION ALL SELECT 'run', writer, step, 'acc', acc FROM steps",
        "row_loss",
        _STEP_CTES,
    )
)
def metrics_log(spark, sf_dir):
    return _metric_log(spark, sf_dir)


@query(sql("SELECT writer, step, loss, acc FROM steps", "row_loss", _STEP_CTES))
def metrics_wide(spark, sf_dir):
    return M.metrics_wide(_step_metrics(spark, sf_dir), ("loss", "acc"))


@query(
    sql(
        "SELECT writer, step, 'loss' AS tag, loss AS value FROM steps WHERE step % 2 = 0 "
        "UNION ALL SELECT writer, step, 'acc', acc FROM steps WHERE step % 2 = 0",
        "row_loss",
        _STEP_CTES,
    )
)
def metrics_every_n(spark, sf_dir):
    return feed.every_n(_step_metrics(spark, sf_dir), 2)


@query(
    f"""
SELECT label, CASE WHEN v = 0 THEN 0 ELSE CAST(sign(v) * (ceil(ln(abs(v)) / ln(1.05 / 0.95::DOUBLE)) + {vectors.LOG_OFFSET}) AS BIGINT) END AS bucket,
    count(*) AS n FROM (SELECT label, exp(40.0::DOUBLE * CAST(unnest(embedding) AS DOUBLE)) - 1.0 AS v FROM embeddings) GROUP BY 1, 2"""
)
def log_histogram(spark, sf_dir):
    """Components with a heavy tail, by class, in buckets of 5 % relative error."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.explode("embedding").alias("x"))
    values = rows.select("label", (F.exp(F.col("x").cast("double") * 40.0) - 1.0).alias("value"))
    return M.log_histogram(values, "label").select("label", "bucket", "n")


# ---------------------------------------------------------------- batch feed


@query(f"SELECT vec_id AS sample_id, vec_id // {BATCH} AS batch_id, vec_id % {BATCH} AS batch_pos FROM embeddings")
def minibatch_assign(spark, sf_dir):
    return feed.minibatch_assign(samples_of(spark, sf_dir), BATCH).select(
        "sample_id", "batch_id", "batch_pos"
    )


SHUFFLE_SEED = 11


def _shuffle_sql(epochs: int) -> str:
    """(id, epoch, x): the place of every vec_id in each epoch, by rounds over a grid that walk on beyond its last row."""

    def step(rows: str) -> str:
        grid = f"SELECT id, epoch, n, a, c, x // c AS l, x % c AS r FROM ({rows})"
        p = permutation.PRIME
        for k in range(permutation.ROUNDS):
            key = permutation.round_key(k, SHUFFLE_SEED, 0)
            mixed = f"SELECT *, ({'l' if k % 2 else 'r'} % {p} * {permutation.PLACE} + epoch % {p} * {permutation.EPOCH} + {key}) % {p} AS m FROM ({grid})"
            drawn = f"SELECT *, (m * m % {p}) * (m * m % {p}) % {p} * m % {p} AS f FROM ({mixed})"
            l, r = ("l", "(r + f) % c") if k % 2 else ("(l + f) % a", "r")
            grid = f"SELECT id, epoch, n, a, c, {l} AS l, {r} AS r FROM ({drawn})"
        return f"SELECT id, epoch, n, a, c, l * c + r AS x FROM ({grid})"

    start = f"""
SELECT vec_id AS id, CAST(e AS BIGINT) AS epoch, n, a, (n + a - 1) // a AS c, vec_id AS x FROM embeddings, range({epochs}) t(e),
  (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM embeddings)"""
    return f"SELECT id, epoch, x FROM (WITH RECURSIVE w AS ({step(start)} UNION ALL {step('SELECT * FROM w WHERE x >= n')}) SELECT * FROM w WHERE x < n)"


@query(
    f"SELECT id AS sample_id, CAST(epoch AS INTEGER) AS epoch, x AS position, x // {BATCH} AS batch_id, x % {BATCH} AS batch_pos FROM ({_shuffle_sql(3)})"
)
def epoch_shuffle(spark, sf_dir):
    """Three epochs, each with batches of its own."""
    samples = samples_of(spark, sf_dir).select("sample_id")
    return feed.epoch_shuffle(samples, count_dense(samples), 3, BATCH, SHUFFLE_SEED).select(
        "sample_id", "epoch", "position", "batch_id", "batch_pos"
    )


@query("SELECT vec_id AS sample_id, CAST(e AS INTEGER) AS epoch FROM embeddings, range(3) t(e)")
def epoch_expand(spark, sf_dir):
    return feed.epoch_expand(samples_of(spark, sf_dir).select("sample_id"), 3)


@query(
    f"""
WITH b AS (SELECT vec_id // {BATCH} AS batch_id, e, (SELECT max(vec_id) // {BATCH} + 1 FROM embeddings) AS n
  FROM embeddings, range(3) t(e))
SELECT e * n + batch_id AS global_step, count(*) AS n_rows FROM b
WHERE e * n + batch_id < 12 GROUP BY 1"""
)
def step_limit(spark, sf_dir):
    samples = samples_of(spark, sf_dir).select("sample_id")
    n_batches = -(-count_dense(samples) // BATCH)
    steps = feed.epochs_within(feed.minibatch_assign(samples, BATCH), n_batches, 3, 12)
    return steps.groupBy("global_step").agg(F.count("*").alias("n_rows"))


@query(
    sql(
        "SELECT batch_id, image_no, sample_id, CAST(r AS INTEGER) AS row_no, "
        "array_to_string(image[r * 8 + 1 : r * 8 + 8], ',') AS line FROM ("
        "SELECT *, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY sample_id) - 1 AS INTEGER) "
        "AS image_no FROM px), range(8) t(r) WHERE image_no < 3"
    )
)
def image_samples(spark, sf_dir):
    batches = feed.minibatch_assign(samples_of(spark, sf_dir), BATCH)
    images = feed.image_samples(batches, 3, SIDE, SIDE)
    rows = images.select(
        "batch_id", "image_no", "sample_id", F.posexplode("image").alias("row_no", "pixels")
    )
    return rows.withColumn("line", line_of("pixels")).drop("pixels")


@query(
    sql(
        f"""
SELECT CAST(s AS BIGINT) AS step, CASE WHEN s % 3 = 0 THEN 'eval' ELSE 'train' END AS action,
  CASE WHEN s % 3 = 0 THEN e.loss ELSE t.loss END AS loss,
  CASE WHEN s % 3 = 0 THEN e.acc ELSE t.acc END AS acc
FROM range(0, (SELECT n + 1 + (n - 1) // 2 FROM (SELECT max(vec_id) // {BATCH} + 1 AS n FROM embeddings))) r(s)
LEFT JOIN steps t ON t.writer = 'train' AND t.step = s - s // 3 - 1
LEFT JOIN tests e ON true""",
        "row_loss",
        {
            **_STEP_CTES,
            "tests": f"""
SELECT {sql_round('sum(loss_a)')} AS loss, {sql_round('avg(CAST(prediction = l.cls AS INTEGER))')} AS acc
FROM row_loss l JOIN pred USING (sample_id) JOIN px USING (sample_id) WHERE split = 'test'""",
        },
    )
)
def eval_schedule(spark, sf_dir):
    """As many steps as it takes to train on every batch, an evaluation every third step."""
    n_batches = -(-count_dense(samples_of(spark, sf_dir)) // BATCH)
    plan = feed.eval_schedule(spark, feed.steps_for(n_batches, 3), 3)
    train = _step_metrics(spark, sf_dir, "split = 'train'")
    train = M.metrics_wide(train, ("loss", "acc")).select(F.col("step").alias("batch_no"), "loss", "acc")
    test = scored(spark, sf_dir, SMALL_A, ("sample_id", "cls", "label"), "split = 'test'")
    loss = V.clipped_cross_entropy(F.col("label"), F.col("output"), CLASSES)
    test = test.agg(
        rounded(F.sum(loss)).alias("loss"),
        rounded(F.avg((F.col("prediction") == F.col("cls")).cast("double"))).alias("acc"),
    )
    trained = plan.where("action = 'train'").join(train, "batch_no", "left").select("step", "action", "loss", "acc")
    # the one row of the evaluation, for every step that evaluates
    evaluated = plan.where("action = 'eval'").select("step", "action").crossJoin(F.broadcast(test))
    return trained.union(evaluated)


# ---------------------------------------------------------------- initial weights

INIT_SEED = 19


def _init_sql(kind: str) -> str:
    """Weights of a layer that is as wide as the table has rows."""
    p = draws.PRIME

    def drawn(n: str, name: str, k: int, deviation: str) -> str:
        start = (k * draws.TENSOR + INIT_SEED * draws.SEED) % p
        polynomial = lambda c, x: " + ".join(f"{v!r}::DOUBLE * pow({x}, {e})" for e, v in enumerate(c))
        ratio = lambda pair, x: f"({polynomial(pair[0], x)}) / ({polynomial(pair[1], x)})"
        fifth = lambda x: f"(({x}) * ({x}) % {p}) * (({x}) * ({x}) % {p}) % {p} * ({x}) % {p}"
        return f"""
SELECT '{name}' AS tensor, i, round({deviation} * CASE WHEN abs(q) <= 0.425 THEN q * {ratio(draws.MIDDLE, '(0.180625 - q * q)')}
  ELSE sign(q) * {ratio(draws.OUTER, '(sqrt(-ln(least(q + 0.5, 0.5 - q))) - 1.6)')} END, 6) + 0.0 AS value
FROM (SELECT i, n, (({fifth('b')}) + 0.5) / {p}.0::DOUBLE * (1.0::DOUBLE - 2.0 * {draws.TAIL!r}::DOUBLE) + {draws.TAIL!r}::DOUBLE - 0.5 AS q FROM (
  SELECT i, n, ((({fifth('a')}) * {draws.AGAIN} + {start}) % {p}) AS b FROM (SELECT i, n, (i % {p} * {draws.CELL} + {start}) % {p} AS a FROM n, range({n}) t(i))))"""

    def flat(n: str, name: str, value: str) -> str:
        return f"SELECT '{name}', i, {value}::DOUBLE FROM n, range({n}) t(i)"

    w1, b1, w2, b2 = {"a": SMALL_A, "b": SMALL_B}[kind].names
    first, second, bias = ("0.125::DOUBLE", "1.0 / sqrt(n)", "0.0") if kind == "a" else ("0.1::DOUBLE", "0.1::DOUBLE", "0.1")
    parts = [drawn(f"{INPUTS} * n", w1, 0, first), flat("n", b1, bias), drawn(f"{CLASSES} * n", w2, 2, second), flat(str(CLASSES), b2, bias)]
    return "WITH n AS (SELECT count(*) AS n FROM embeddings) " + " UNION ALL ".join(parts)


def _init(spark, sf_dir, spec) -> DataFrame:
    wide = dataclasses.replace(spec, hidden=count_dense(samples_of(spark, sf_dir)))
    return initial_values(spark, wide, INIT_SEED).select("tensor", "i", rounded("value").alias("value"))


@query(_init_sql("a"))
def init_a(spark, sf_dir):
    """First weights of model A with a hidden unit for each row of the table, drawn by executors."""
    return _init(spark, sf_dir, SMALL_A)


@query(_init_sql("b"))
def init_b(spark, sf_dir):
    """The same for model B."""
    return _init(spark, sf_dir, SMALL_B)


# ---------------------------------------------------------------- training


def _gradient(spark: SparkSession, sf_dir: str, spec: NetSpec) -> Tensors:
    sums = dataset_sums(samples_of(spark, sf_dir), spec, formula_weights(spec))
    return gradient(spec, sums)


def _grad_sql(kind: str, select: str) -> str:
    return sql(select, f"dz_{kind}", _gradient_ctes(kind))


@query(_grad_sql("a", f"SELECT tensor, i, {sql_round('g')} AS value FROM grad WHERE tensor IN ('hid_b', 'sm_b')"))
def grad_bias(spark, sf_dir):
    g = _gradient(spark, sf_dir, SMALL_A)
    return tensor_rows(spark, {n: g[n] for n in ("hid_b", "sm_b")})


@query(_grad_sql("a", f"SELECT tensor, i, {sql_round('g')} AS value FROM grad WHERE tensor IN ('hid_w', 'sm_w')"))
def grad_weights(spark, sf_dir):
    g = _gradient(spark, sf_dir, SMALL_A)
    return tensor_rows(spark, {n: g[n] for n in ("hid_w", "sm_w")})


@query(_grad_sql("b", f"SELECT tensor, i, {sql_round('g')} AS value FROM grad"))
def grad_logit_loss(spark, sf_dir):
    return tensor_rows(spark, _gradient(spark, sf_dir, SMALL_B))


def _adagrad_state(spark: SparkSession, sf_dir: str) -> Tensors:
    optimizer, weights = Adagrad(), formula_weights(SMALL_A)
    state = {**weights, **optimizer.slots(weights)}
    return optimizer.update(SMALL_A, state, _gradient(spark, sf_dir, SMALL_A))


SQL_ADAGRAD = (
    f"SELECT tensor, i, {sql_round('w - 0.01::DOUBLE * g / sqrt(0.1::DOUBLE + g * g)')} AS value FROM grad "
    f"UNION ALL SELECT tensor || '/Adagrad', i, {sql_round('0.1::DOUBLE + g * g')} FROM grad"
)


def _step_rows(spark: SparkSession, sf_dir: str, spec: NetSpec, optimizer: Adagrad | Adam) -> DataFrame:
    """Weights and slots after one step over the whole table; all tensors stay with the executors."""
    stored = state_rows.StoredState.store(state_rows.rows_of(spark, spec, formula_weights(spec), optimizer), spec)
    new, _ = state_rows.step(stored, samples_of(spark, sf_dir), optimizer, updates=1)
    return state_rows.values_of(new.rows(spark), optimizer).select("tensor", "i", rounded("value").alias("value"))


@query(_grad_sql("a", SQL_ADAGRAD))
def adagrad_step(spark, sf_dir):
    return _step_rows(spark, sf_dir, SMALL_A, Adagrad())


SQL_ADAM_RATE = "(0.001::DOUBLE * sqrt(1.0::DOUBLE - 0.999::DOUBLE) / (1.0::DOUBLE - 0.9::DOUBLE))"


@query(
    _grad_sql(
        "b",
        f"""
SELECT tensor, i, {sql_round(f'w - {SQL_ADAM_RATE} * m / (sqrt(v) + 1e-8)')} AS value FROM
  (SELECT *, (1.0::DOUBLE - 0.9::DOUBLE) * g AS m, (1.0::DOUBLE - 0.999::DOUBLE) * g * g AS v FROM grad)
UNION ALL SELECT tensor || '/Adam', i, {sql_round('(1.0::DOUBLE - 0.9::DOUBLE) * g')} FROM grad
UNION ALL SELECT tensor || '/Adam_1', i, {sql_round('(1.0::DOUBLE - 0.999::DOUBLE) * g * g')} FROM grad
UNION ALL SELECT 'Adam/updates', 0, 1.0::DOUBLE""",
    )
)
def adam_step(spark, sf_dir):
    updates = spark.range(1).select(F.lit("Adam/updates").alias("tensor"), F.lit(0).alias("i"), F.lit(1.0).alias("value"))
    return _step_rows(spark, sf_dir, SMALL_B, Adam()).union(updates)


@query(_grad_sql("a", f"SELECT CAST(1 AS BIGINT) AS step, * FROM ({SQL_ADAGRAD})"))
def checkpoint_roundtrip(spark, sf_dir):
    path = staging_path(spark, "model")
    state = _adagrad_state(spark, sf_dir)
    checkpoints.save_state(spark, path, formula_weights(SMALL_A), 0, "run")
    checkpoints.save_state(spark, path, state, 1, "run")
    step, saved = checkpoints.load_state(spark, path, "run", tensors=len(state))
    return tensor_rows(spark, saved).select(F.lit(step).cast("bigint").alias("step"), "*")


@query(
    f"""
WITH v AS (SELECT vec_id // {BATCH} AS step, CAST(unnest(embedding) AS DOUBLE) AS value,
    CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i FROM embeddings)
SELECT step, 'batch_sum' AS tensor, i, {sql_round('sum(value)')} AS value FROM v
WHERE step = (SELECT max(step) FROM v) GROUP BY step, i"""
)
def checkpoint_latest(spark, sf_dir):
    """One checkpoint per batch, holding the sum of its vectors; the last one is read."""
    values = samples_of(spark, sf_dir).select(
        batch_of().alias("step"), F.posexplode(F.col("embedding").cast("array<double>"))
    )
    sums = values.groupBy("step", "pos").agg(F.sum("col").alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    states = sums.groupBy("step").agg(ordered.alias("cells")).select(
        F.lit("run").alias("run_id"),
        F.lit("batch_sum").alias("tensor"),
        F.array(F.size("cells")).alias("shape"),
        F.transform("cells", lambda c: c["value"]).alias("data"),
        "step",
    )
    path = f"{staging_path(spark, 'model')}/weights"
    states.write.parquet(path)
    latest = checkpoints.latest_weights(checkpoints.read_weights(spark, path[: -len("/weights")]))
    return M.tensor_values(latest).select("step", "tensor", "i", rounded("value").alias("value"))


@query(sql("SELECT sample_id, cls AS label, prediction FROM pred", "pred"))
def score_saved(spark, sf_dir):
    """Two runs in one folder; the weights of the right one are restored."""
    path = staging_path(spark, "model")
    weights = formula_weights(SMALL_A)
    checkpoints.save_state(spark, path, {n: -w for n, w in weights.items()}, 9, "other")
    checkpoints.save_state(spark, path, {n: 0 * w for n, w in weights.items()}, 1, "run")
    checkpoints.save_state(spark, path, weights, 2, "run")
    return jobs.score_saved(samples_of(spark, sf_dir), SMALL_A, path, run_id="run")


def _training_samples(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """(sample_id, image, label) of some rows, numbered anew."""
    rows = samples_of(spark, sf_dir).where(where).select("sample_id", "image", "label")
    numbered = positions.with_dense_id(rows, ["sample_id"], "dense")
    return numbered.drop("sample_id").withColumnRenamed("dense", "sample_id")


# Gradients of each batch from the same start, and their updates averaged by rows.
_BATCH_CTES = {
    "dh": _gradient_ctes("a")["dh"],
    "grad": f"""
SELECT 'hid_w' AS tensor, CAST(x.i * 8 + dh.j AS INTEGER) AS i, x.sample_id // {BATCH} AS b, sum(x.x * dh.dh) AS g, any_value(w.w) AS w
FROM x JOIN dh ON x.sample_id = dh.sample_id JOIN hid_w w ON w.i = x.i AND w.j = dh.j GROUP BY x.i, dh.j, 3
UNION ALL SELECT 'hid_b', CAST(dh.j AS INTEGER), dh.sample_id // {BATCH}, sum(dh.dh), any_value(b.b)
FROM dh JOIN hid_b b ON b.j = dh.j GROUP BY dh.j, 3
UNION ALL SELECT 'sm_w', CAST(hid.j * 10 + dz.k AS INTEGER), dz.sample_id // {BATCH}, sum(hid.h * dz.dz), any_value(w.w)
FROM hid JOIN dz_a dz ON dz.sample_id = hid.sample_id
JOIN sm_w w ON w.j = hid.j AND w.k = dz.k GROUP BY hid.j, dz.k, 3
UNION ALL SELECT 'sm_b', CAST(dz.k AS INTEGER), dz.sample_id // {BATCH}, sum(dz.dz), any_value(b.b)
FROM dz_a dz JOIN sm_b b ON b.k = dz.k GROUP BY dz.k, 3""",
    "rows": f"SELECT sample_id // {BATCH} AS b, count(*) AS n FROM px GROUP BY 1",
}


@query(
    sql(
        f"""
SELECT tensor, i, {sql_round('sum(n * (w - 0.01::DOUBLE * g / sqrt(0.1::DOUBLE + g * g))) / sum(n)')} AS value
FROM grad JOIN rows USING (b) GROUP BY tensor, i UNION ALL
SELECT tensor || '/Adagrad', i, {sql_round('sum(n * (0.1::DOUBLE + g * g)) / sum(n)')}
FROM grad JOIN rows USING (b) GROUP BY tensor, i""",
        "dz_a",
        _BATCH_CTES,
    )
)
def train_mlp(spark, sf_dir):
    """One pass over the whole table, a shard for each mini-batch, averaged."""
    samples = samples_of(spark, sf_dir)
    n_batches = -(-count_dense(samples) // BATCH)
    result = training.train_mlp(
        samples, SMALL_A, steps=n_batches, shards=n_batches, weights=formula_weights(SMALL_A)
    )
    return tensor_rows(spark, result.state)


# Averages of the batches' updates from one start; weights are those of a shard's rows.
SQL_AVERAGE = """
SELECT tensor, i, sum(n * (w - 0.01::DOUBLE * g / sqrt(0.1::DOUBLE + g * g))) / sum(n) AS value FROM grad JOIN rows USING (b) {0} GROUP BY tensor, i
UNION ALL SELECT tensor || '/Adagrad', i, sum(n * (0.1::DOUBLE + g * g)) / sum(n) FROM grad JOIN rows USING (b) {0} GROUP BY tensor, i"""


@query(
    sql(
        f"SELECT tensor, i, {sql_round('value')} AS value FROM ({SQL_AVERAGE.format('')})",
        "dz_a",
        _BATCH_CTES,
    ).replace(_CTES["px"], _CTES["px"].replace("SELECT vec_id AS", "SELECT x AS").replace("FROM embeddings", f"FROM embeddings JOIN ({_shuffle_sql(1)}) ON id = vec_id"))
)
def train_reshuffled(spark, sf_dir):
    """One pass over the whole table in the first epoch's order, a shard for each of its mini-batches, averaged."""
    samples = samples_of(spark, sf_dir)
    n_batches = -(-count_dense(samples) // BATCH)
    result = training.train_mlp(
        samples, SMALL_A, steps=n_batches, shards=n_batches, weights=formula_weights(SMALL_A), reshuffle=True, seed=SHUFFLE_SEED
    )
    return tensor_rows(spark, result.state)


def _rounds_sql() -> str:
    """Half of the batches from the first weights; the other half from their average, in tables of the same names with a 2."""
    half = f"(SELECT (max(vec_id) // {BATCH} + 2) // 2 FROM embeddings)"
    first = {**_BATCH_CTES, "avg1": SQL_AVERAGE.format(f"WHERE b < {half}")}
    weights = {
        "hid_w": "SELECT i // 8 AS i, i % 8 AS j, value AS w FROM avg1 WHERE tensor = 'hid_w'",
        "hid_b": "SELECT i AS j, value AS b FROM avg1 WHERE tensor = 'hid_b'",
        "sm_w": "SELECT i // 10 AS j, i % 10 AS k, value AS w FROM avg1 WHERE tensor = 'sm_w'",
        "sm_b": "SELECT i AS k, value AS b FROM avg1 WHERE tensor = 'sm_b'",
    }
    again = {n: _CTES[n] for n in ("pre", "hid", "z", "zm", "y", "dz_a")} | {n: _BATCH_CTES[n] for n in ("dh", "grad")}
    names = re.compile(r"\b(" + "|".join([*weights, *again]) + r")\b(?!')")
    second = {f"{n}2": body for n, body in weights.items()} | {f"{n}2": names.sub(r"\g<1>2", body) for n, body in again.items()}
    select = f"""
SELECT tensor, i, {sql_round("sum(n * (w - 0.01::DOUBLE * g / sqrt(a + g * g))) / sum(n)")} AS value FROM late GROUP BY tensor, i
UNION ALL SELECT tensor || '/Adagrad', i, {sql_round("sum(n * (a + g * g)) / sum(n)")} FROM late GROUP BY tensor, i"""
    late = f"SELECT grad2.*, n, value AS a FROM grad2 JOIN rows USING (b) JOIN avg1 ON avg1.tensor = grad2.tensor || '/Adagrad' AND avg1.i = grad2.i WHERE b >= {half}"
    return sql(select, "dz_a", {**first, **second, "late": late})


@query(_rounds_sql())
def train_rounds(spark, sf_dir):
    """One pass over the whole table in two rounds: shards of two mini-batches, averaged after each."""
    samples = samples_of(spark, sf_dir)
    n_batches = -(-count_dense(samples) // BATCH)
    result = training.train_mlp(
        samples, SMALL_A, steps=n_batches, shards=-(-n_batches // 2), average_every=1, weights=formula_weights(SMALL_A)
    )
    return tensor_rows(spark, result.state)


@query(_grad_sql("a", SQL_ADAGRAD))
def train_mlp_sync(spark, sf_dir):
    """One step over the whole table as one batch, its gradient summed over tasks."""
    samples = samples_of(spark, sf_dir)
    result = training.train_mlp(
        samples, SMALL_A, mode="sync", batch_size=count_dense(samples), steps=1, weights=formula_weights(SMALL_A)
    )
    return tensor_rows(spark, result.state)


@query(_grad_sql("a", SQL_ADAGRAD))
def train_stream(spark, sf_dir):
    """The same step, fed by a stream that finds the stored table file by file."""
    samples = samples_of(spark, sf_dir).select("sample_id", "image", "label")
    path = staging_path(spark, "stream")
    write_samples(samples, f"{path}/table", partitions=4, block_rows=BATCH)
    run = online.OnlineTraining(
        spark, f"{path}/table", SMALL_A, f"{path}/model", count_dense(samples), weights=formula_weights(SMALL_A)
    )
    return tensor_rows(spark, run.run_available(f"{path}/offsets", files_per_batch=1).state)


@query(
    sql(
        f"""
SELECT split AS writer, CAST(CASE WHEN split = 'train' THEN 1 ELSE 0 END AS BIGINT) AS step,
  {sql_round('avg(loss_b)')} AS cross_entropy, {sql_round('avg(CAST(prediction = l.cls AS INTEGER))')} AS accuracy,
  1.0::DOUBLE AS dropout_keep_probability
FROM row_loss l JOIN pred USING (sample_id) JOIN px USING (sample_id) GROUP BY split""",
        "row_loss",
    )
)
def train_eval_log(spark, sf_dir):
    """The log of an evaluation of the whole test split and a step over the whole train split."""
    train, test = (_training_samples(spark, sf_dir, f"split = '{s}'") for s in ("train", "test"))
    result = training.train_mlp(
        train, SMALL_B, mode="sync", batch_size=count_dense(train), steps=2, eval_samples=test,
        eval_every=2, keep_prob=1.0, weights=formula_weights(SMALL_B),
    )
    tags = ("cross_entropy", "accuracy", "dropout_keep_probability")
    wide = M.metrics_wide(result.metrics(spark), tags)
    return wide.select("writer", "step", *[rounded(t).alias(t) for t in tags])


@query(SQL_ACTIVATIONS)
def train_histograms(spark, sf_dir):
    """The histograms of activations that a step over the whole table logs, counted by all its tasks."""
    samples = samples_of(spark, sf_dir)
    result = training.train_mlp(
        samples, SMALL_B, mode="sync", batch_size=count_dense(samples), steps=1, keep_prob=1.0, histograms=True,
        weights=formula_weights(SMALL_B),
    )
    logged = result.histograms(spark).where("tag LIKE '%activations'")
    return logged.groupBy(F.col("tag").alias("tensor"), "bucket").agg(F.sum("n").alias("n"))


def _job_sql() -> str:
    """Train on one split, score the other with the updated weights."""
    test = _CTES["x"].replace("FROM px", "FROM (" + _CTES["px"] + " WHERE vec_id % 5 = 0)")
    update = f"(SELECT * FROM ({SQL_ADAGRAD}))"
    cell = "CAST(i AS BIGINT)"
    extra = {
        **_gradient_ctes("a"),
        "new": f"SELECT * FROM {update}",
        "xt": test,
        "pre2": f"""
SELECT sample_id, cls, j, s + value AS pre FROM (
  SELECT xt.sample_id, xt.cls, w.i % 8 AS j, sum(xt.x * w.value) AS s
  FROM xt JOIN new w ON w.tensor = 'hid_w' AND w.i // 8 = xt.i GROUP BY ALL) p
JOIN new b ON b.tensor = 'hid_b' AND {cell.replace('i AS', 'b.i AS')} = p.j""",
        "z2": f"""
SELECT sample_id, cls, k, s + value AS z FROM (
  SELECT h.sample_id, h.cls, w.i % 10 AS k, sum(greatest(h.pre, 0.0) * w.value) AS s
  FROM pre2 h JOIN new w ON w.tensor = 'sm_w' AND w.i // 10 = h.j GROUP BY ALL) p
JOIN new b ON b.tensor = 'sm_b' AND {cell.replace('i AS', 'b.i AS')} = p.k""",
        "pred2": """
SELECT sample_id, cls, k AS prediction FROM z2
QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY z DESC, k) = 1""",
    }
    select = f"""
SELECT cls AS label, count(*) AS n, CAST(sum(CAST(prediction = cls AS INTEGER)) AS BIGINT) AS hits,
  (SELECT count(*) FROM embeddings WHERE vec_id % 5 <> 0) AS num_train,
  (SELECT count(*) FROM embeddings WHERE vec_id % 5 = 0) AS num_test
FROM pred2 GROUP BY cls"""
    whole = sql(select, "dz_a", extra)
    return whole.replace("FROM embeddings)", "FROM embeddings WHERE vec_id % 5 <> 0)", 1)


@query(_job_sql())
def ingest_train_score(spark, sf_dir):
    """Raw files to predictions: convert, verify, train one step over the split, score the other."""
    path = staging_path(spark, "job")
    raw = {}
    for split in ("train", "test"):
        part = samples_of(spark, sf_dir).where(F.col("split") == split).withColumn("label", F.col("cls"))
        rows = positions.with_dense_id(part.select("sample_id", "image", "label"), ["sample_id"], "dense")
        write_idx_files(
            rows.select(F.col("dense").alias("sample_id"), "image", "label"), f"{path}/raw/{split}", SIDE, SIDE
        )
        raw[split] = (f"{path}/raw/{split}/images", f"{path}/raw/{split}/labels")
    rows = samples_of(spark, sf_dir).where("split = 'train'").count()
    result = jobs.run_job(
        spark, raw, f"{path}/out", SMALL_A, mode="sync", batch_size=rows, steps=1, weights=formula_weights(SMALL_A)
    )
    hits = (F.col("prediction") == F.col("label")).cast("bigint")
    return result.predictions.groupBy("label").agg(
        F.count("*").alias("n"),
        F.sum(hits).alias("hits"),
        *[F.lit(result.verified[s]["num_images"]).cast("bigint").alias(f"num_{s}") for s in ("train", "test")],
    )


# ---------------------------------------------------------------- text operators

try:
    import corpus_pipeline
    from labelvec.llm import queries as llm_queries
except ModuleNotFoundError as missing:  # both are optional, whatever they import is not
    if missing.name not in ("corpus_pipeline", "labelvec.llm"):
        raise
else:
    for _name, _fn in {**llm_queries.QUERIES, "pipeline": corpus_pipeline.run}.items():
        query(llm_queries.SQL.get(_name), _name)(_fn)


# ---------------------------------------------------------------- contract


def entry(spark: SparkSession) -> DataFrame:
    return _queries["batch_accuracy"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, QueryFn]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
