"""Positional pairing: row i of one set of files with row i of another."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from labelvec.operators.positions import numbered, unit_offsets


def part_counts(left_offsets: DataFrame, right_offsets: DataFrame) -> DataFrame:
    """Rows per file rank on both sides, from the offsets alone."""

    def counts(offsets: DataFrame, name: str) -> DataFrame:
        return offsets.groupBy("part").agg(F.sum("_rows").alias(name))

    joined = counts(left_offsets, "n_left").join(
        counts(right_offsets, "n_right"), "part", "full"
    )
    return joined.select(
        "part",
        F.coalesce("n_left", F.lit(0)).alias("n_left"),
        F.coalesce("n_right", F.lit(0)).alias("n_right"),
    )


def pair_by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join two staged frames row by row into (sample_id, ...left, ...right).

    The files may be split differently on the two sides. Files of equal rank must
    hold equally many rows; then both sides give a row the same dense id, and one
    equi-join on that id, which no single file can skew, pairs them.
    """
    offsets = unit_offsets(left), unit_offsets(right)
    bad = part_counts(*offsets).where("n_left <> n_right").orderBy("part").limit(5).collect()
    if bad:
        detail = ", ".join(f"file {r.part}: {r.n_left} and {r.n_right} rows" for r in bad)
        raise ValueError(f"the two sides do not line up: {detail}")
    return numbered(left, offsets[0]).join(numbered(right, offsets[1]), "sample_id")


def unmatched_positions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every (part, pos) present on one side only, with that side's name."""
    l = numbered(left, positions=True).select("part", "pos", F.lit(True).alias("_l"))
    r = numbered(right, positions=True).select("part", "pos", F.lit(True).alias("_r"))
    return (
        l.join(r, ["part", "pos"], "full")
        .where("_l IS NULL OR _r IS NULL")
        .select(
            "part",
            "pos",
            F.when(F.col("_r").isNull(), F.lit("left")).otherwise(F.lit("right")).alias("side"),
        )
    )


def unmatched_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    """The same check once both sides carry ``sample_id``."""
    l = left.select("sample_id", F.lit(True).alias("_l"))
    r = right.select("sample_id", F.lit(True).alias("_r"))
    return (
        l.join(r, "sample_id", "full")
        .where("_l IS NULL OR _r IS NULL")
        .select(
            "sample_id",
            F.when(F.col("_r").isNull(), F.lit("left")).otherwise(F.lit("right")).alias("side"),
        )
    )
