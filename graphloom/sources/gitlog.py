"""Commit histories as rows."""

from __future__ import annotations

import os
import subprocess
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_folder

#: Ends a commit's entry in the log.
END = "\x1e"


def parse(entries: DataFrame) -> DataFrame:
    """(commit, author, file) of (commit, value) rows: an entry's first line names the author, the others are files."""
    lines = F.split(F.trim(F.col("value"), F.lit("\n")), "\n")
    return entries.select("commit", lines[0].alias("author"), F.explode(F.slice(lines, 2, F.size(lines))).alias("file")).withColumn("file", F.trim("file")).where("file != ''")


def log(spark: SparkSession, folder: str) -> DataFrame:
    """A repository's own history."""
    out = subprocess.run(["git", "-C", folder, "log", "--name-only", f"--format={END}%an"], capture_output=True, text=True, check=True).stdout
    return parse(spark.createDataFrame(list(enumerate(out.split(END)[1:])), "commit long, value string"))


def checkout(spark: SparkSession, folder: str, base: str) -> str:
    """A folder, shared by all executors, with a repository's files as of a commit; whoever asks removes it."""
    shared = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    if ":" in shared.split("/")[0]:
        raise ValueError(f"{shared} is no folder that files can be unpacked to")
    to = os.path.join(shared, f"base-{uuid.uuid4().hex}")
    os.makedirs(to)
    packed = subprocess.run(["git", "-C", folder, "archive", base], capture_output=True, check=True).stdout
    subprocess.run(["tar", "-x", "-C", to], input=packed, check=True)
    return to


def top_folder(folder: str) -> str:
    """The repository's top, or the folder itself outside of one."""
    done = subprocess.run(["git", "-C", folder, "rev-parse", "--show-toplevel"], capture_output=True, text=True)
    return done.stdout.strip() or folder


def changed_files(spark: SparkSession, folder: str, base: str = "HEAD") -> DataFrame:
    """(file) that differ from a commit."""
    out = subprocess.run(["git", "-C", folder, "diff", "--name-only", base, "--"], capture_output=True, text=True, check=True).stdout
    return spark.createDataFrame([(f,) for f in out.splitlines()], "file string")
