"""Source text of symbols, read from the files when it is asked for."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import SymbolGraph


def snippets(g: SymbolGraph, nodes: DataFrame, root: str | None = None) -> DataFrame:
    """(id, start_line, end_line, line_count, content) of those nodes that have a file and lines.

    Each file is read once, whole, by the task that cuts its symbols out of it;
    a range that goes beyond the file ends with it.  Nodes whose file is gone
    give no row.  Relative paths are below ``root``, else the graph's own.
    """
    spark: SparkSession = g.nodes.sparkSession
    top = os.path.abspath(root or g.root or ".")
    end = F.col("end_line") if "end_line" in nodes.columns else F.col("start_line")
    wanted = nodes.where("file is not null and start_line is not null").select("id", F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat(F.lit(top + "/"), "file")).alias("full"), "start_line", F.coalesce(end, "start_line").alias("end_line"))
    # whoever asks names the symbols, so their files are few
    files = [r.full for r in wanted.select("full").distinct().collect() if os.path.exists(r.full)]
    if not files:
        return wanted.select("id", "start_line", "end_line", F.lit(0).alias("line_count"), F.lit("").alias("content")).limit(0)
    text = spark.read.text(files, wholetext=True).select(F.regexp_replace(F.input_file_name(), "^file:(//)?", "").alias("full"), F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n").alias("lines"))
    cut = F.slice("lines", F.greatest(F.col("start_line"), F.lit(1)).cast("int"), F.greatest(F.col("end_line") - F.greatest(F.col("start_line"), F.lit(1)) + 1, F.lit(0)).cast("int"))
    return wanted.join(text, "full").select("id", "start_line", "end_line", F.size(cut).alias("line_count"), F.array_join(cut, "\n").alias("content"))
