"""Reports as files: every section a folder of JSON lines, written by the executors and read back as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """Each section below ``path`` under its name; a section that is there already is replaced."""
    for name, df in sections.items():
        df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")


def read_report(spark: SparkSession, path: str, section: str, schema: str) -> DataFrame:
    """A section again; fields that a row lacks are NULL, lines that are no JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{path}/{section}")


def as_lines(df: DataFrame, title: str, *columns: str) -> DataFrame:
    """(pos, line): a table in Markdown; rows keep no order but ``line``'s."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    head = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    top = df.sparkSession.createDataFrame(list(enumerate(head)), "pos long, line string")
    body = df.select(F.lit(len(head)).cast("long").alias("pos"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line"))
    return top.unionByName(body)


def write_lines(lines: DataFrame, path: str) -> None:
    """(pos, line) as text files in order: sorted by range, so a long report is many files."""
    lines.orderBy("pos", *[c for c in lines.columns if c not in ("pos", "line")], "line").select("line").write.mode("overwrite").text(path)
