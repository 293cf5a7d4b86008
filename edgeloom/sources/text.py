"""Edge lists and adjacency lists in text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lenient_id, strict_id
from ..operators.ranks import with_rank

FILE_TYPES = ("edgelist", "adjlist", "parquet")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) in the order of file path, place in the file, and line. Numbers rise but may have gaps."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return with_rank(lines, ["f", "b", "i"], "line_no").select("line_no", "value")


def _rows(lines: DataFrame) -> DataFrame:
    """Without comment lines: those whose first character is # or %."""
    return lines.where(~F.coalesce(F.substring("value", 1, 1).isin("#", "%"), F.lit(False)))


def parse_edges(lines: DataFrame, strict: bool = False) -> DataFrame:
    """raw from lines(line_no, value) of two names and anything after them, between tabs, commas or blanks.

    A line of fewer than two tokens raises. Self-loops go. strict: names that aren't numbers of 32 bits raise, else they are read leniently.
    """
    name = strict_id if strict else lenient_id
    t = F.filter(F.split("value", "[\t, ]+"), lambda x: x != "")
    rows = _rows(lines).select("line_no", t.alias("t"), "value")
    bad = F.raise_error(F.concat(F.lit("an edge needs two vertices: '"), F.col("value"), F.lit("'")))
    tokens = rows.select("line_no", F.when(F.size("t") >= 2, F.col("t")).otherwise(bad.cast("array<string>")).alias("t"))
    return tokens.select("line_no", name(F.col("t")[0]).alias("src"), name(F.col("t")[1]).alias("dst")).where("src <> dst")


def parse_adjacency(lines: DataFrame, strict: bool = False) -> DataFrame:
    """raw from lines(line_no, value) of a name, a count and so many neighbours, between tabs or blanks; a name alone has no neighbours.

    Self-loops count as neighbours and then go. A count that doesn't match and an empty line raise.
    """
    name = strict_id if strict else lenient_id
    t = F.filter(F.split("value", "[\t ]+"), lambda x: x != "")
    rows = _rows(lines).select("line_no", "value", t.alias("t"))
    n = F.when(F.size("t") > 1, name(F.col("t")[1])).otherwise(F.lit(0).cast("bigint"))
    ok = (F.size("t") == 1) | ((F.size("t") > 1) & (F.size("t") - 2 == n))
    bad = F.raise_error(F.concat(F.lit("neighbours don't match their count: '"), F.col("value"), F.lit("'")))
    own = rows.select("line_no", F.when(ok, F.col("t")).otherwise(bad.cast("array<string>")).alias("t"))
    each = own.select("line_no", F.col("t")[0].alias("a"), F.posexplode(F.slice("t", 3, F.greatest(F.size("t") - 2, F.lit(0)))).alias("k", "b"))
    # neighbours keep their order within a line, and lines theirs
    placed = each.select(F.struct("line_no", "k").alias("at"), name(F.col("a")).alias("src"), name(F.col("b")).alias("dst"))
    return with_rank(placed, ["at"], "line_no").select("line_no", "src", "dst").where("src <> dst")


def read_graph(spark: SparkSession, path: str, filetype: str = "edgelist", strict: bool = False) -> DataFrame:
    """raw from text files, or from a Parquet table that has these columns. Nothing is cached by name."""
    if not path:
        raise ValueError("no input given")
    if filetype not in FILE_TYPES:
        raise ValueError(f"unknown file type {filetype!r}; known: {', '.join(FILE_TYPES)}")
    if filetype == "parquet":
        return spark.read.parquet(path).select(*(F.col(c).cast("long").alias(c) for c in ("line_no", "src", "dst"))).where("src <> dst")
    return (parse_edges if filetype == "edgelist" else parse_adjacency)(read_lines(spark, path), strict)


def write_edge_list(raw: DataFrame, path: str) -> None:
    """Lines of source and target in the order of line_no, original names, loops left out."""
    raw.where("src <> dst").repartitionByRange("line_no").sortWithinPartitions("line_no").select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(path)

