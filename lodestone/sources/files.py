"""Readers and writers of files: tables with aliased headers, manifests, line JSON, TSV, bibliographic items, sinks."""

from __future__ import annotations

import os
import sqlite3
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import DOI, doi


#: Stands for a quoted empty field while a file is read.
EMPTY = "\x01"


def csv_aliased(spark: SparkSession, path: str, aliases: dict[str, list[str]], required: list[str], sep: str = ",") -> DataFrame:
    """A CSV table with its columns renamed to logical names; headers match without case, the first alias wins. All values are text.

    Raises ValueError if a required name has no column.
    """
    df = spark.read.csv(path, header=True, sep=sep, mode="PERMISSIVE", multiLine=False)
    by_name = {c.strip().lower(): c for c in reversed(df.columns)}
    found = {name: by_name[a.lower()] for name, names in aliases.items() for a in reversed(names) if a.lower() in by_name}
    if missing := [r for r in required if r not in found]:
        raise ValueError(f"no column for {missing} in {df.columns}")
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in found.items()])


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """A TSV table in which a quoted empty field is an empty text and a bare one is null."""
    rows = spark.read.csv(path, header=True, sep="\t", emptyValue=EMPTY)  # Spark reads both as null if they read alike
    return rows.select(*[F.when(F.col(f"`{c}`") == EMPTY, "").otherwise(F.col(f"`{c}`")).alias(c) for c in rows.columns])


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(doi): the DOIs of a list in text, CSV, TSV or JSON lines, each once without regard to case, in the first spelling by place.

    Lines that start with # do not count; any form is read line by line, so the format need not be told.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
    every = lines.where(~F.col("line").startswith("#")).select("file", "place", F.posexplode(F.regexp_extract_all("line", F.lit(DOI), F.lit(0))).alias("k", "raw"))
    found = every.withColumn("doi", doi(F.regexp_replace("raw", r"[,;].*$", ""))).where("doi is not null")
    return found.groupBy(F.lower("doi").alias("_k")).agg(F.min_by("doi", F.struct("file", "place", "k")).alias("doi")).select("doi")


def id_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(kind, value) of a mixed list: `aps:` ids and bare DOIs are kind doi, everything else is an id."""
    line = F.trim(F.col("value"))
    rows = spark.read.text(path).where(F.trim("value") != "").where(~F.trim("value").startswith("#"))
    bare = F.regexp_replace(line, "^(?:aps|doi):", "")
    return rows.select(F.when(bare.rlike(r"^10\.\d{4,9}/"), "doi").otherwise("id").alias("kind"), F.when(bare.rlike(r"^10\.\d{4,9}/"), bare).otherwise(line).alias("value")).distinct()


def pages_of_items(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages of a paged query, one item a row, with the page's total for a check whether all have come."""
    raw = spark.read.json(path, multiLine=True)
    return raw.select(F.col("message.total-results").alias("total"), F.explode("message.items").alias("item"))


def query_summary(spark: SparkSession, path: str) -> DataFrame:
    """(query, reported_total, pages, items, truncated) of landed pages of paged queries, a folder a query: whether all items have come."""
    raw = spark.read.json(path, multiLine=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("query"), "message.*")
    total, items = F.max("total-results"), F.sum(F.coalesce(F.size("items"), F.lit(0)))
    one = raw.groupBy("query").agg(total.alias("reported_total"), F.count("*").alias("pages"), F.greatest(items, F.lit(0)).alias("items"))
    return one.withColumn("truncated", F.coalesce((F.col("reported_total") > 0) & (F.col("items") < F.col("reported_total")), F.lit(False)))


def feed(spark: SparkSession, path: str, defaults: dict[str, object]) -> DataFrame:
    """One row of a JSON file, missing fields filled from defaults."""
    df = spark.read.json(path, multiLine=True)
    return df.select(*[F.coalesce(F.col(k), F.lit(v)).alias(k) if k in df.columns else F.lit(v).alias(k) for k, v in defaults.items()], *[c for c in df.columns if c not in defaults])


def oai_records(spark: SparkSession, path: str, category: str) -> DataFrame:
    """(id, title, abstract, categories, created) of landed harvest pages; deleted records and other primary categories are left out."""
    schema = "header struct<_status string, identifier string>, metadata struct<arXiv struct<id string, title string, abstract string, categories string, created string>>"
    rows = spark.read.format("xml").option("rowTag", "record").option("ignoreNamespace", "true").schema(schema).load(path)
    a = "metadata.arXiv."
    live = rows.where("header._status is null or header._status <> 'deleted'").where(F.split_part(F.col(a + "categories"), F.lit(" "), F.lit(1)) == category)
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return live.select(
        F.concat(F.lit("arxiv:"), F.col(a + "id")).alias("id"), squeeze(a + "title").alias("title"), squeeze(a + "abstract").alias("abstract"),
        F.split(a + "categories", " ").alias("categories"), F.to_date(a + "created").alias("created"),
    )


def oai_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, records, deleted, token, error) of landed harvest pages. A harvest is whole when one page a request has no token left."""
    record = "array<struct<header: struct<_status: string>>>"
    schema = f"error struct<_code: string>, ListRecords struct<record: {record}, resumptionToken: string>"
    rows = spark.read.format("xml").option("rowTag", "OAI-PMH").option("ignoreNamespace", "true").schema(schema).load(path)
    records = F.coalesce("ListRecords.record", F.array().cast(record))
    return rows.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), F.size(records).alias("records"),
        F.size(F.filter(records, lambda r: F.coalesce(r["header"]["_status"] == "deleted", F.lit(False)))).alias("deleted"),
        F.nullif(F.trim("ListRecords.resumptionToken"), F.lit("")).alias("token"), F.col("error._code").alias("error"),
    )


def sqlite(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """The rows that sql gives on every SQLite file under path, a task a file; a file's bytes are the only thing a task holds."""
    names = [c.split()[0] for c in schema.split(",")]

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for raw in part["content"]:
                with tempfile.TemporaryDirectory() as own:
                    name = os.path.join(own, "db")
                    with open(name, "wb") as f:
                        f.write(raw)
                    db = sqlite3.connect(name)
                    rows = db.execute(sql)
                    while got := rows.fetchmany(10_000):
                        yield pd.DataFrame(got, columns=names)
                    db.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)


def dump(df: DataFrame, root: str, day: str, keep_days: int = 14) -> list[str]:
    """A compressed snapshot of df under root/day=..., then snapshots more than keep_days older are deleted; the days that stay."""
    df.write.mode("overwrite").option("compression", "gzip").json(f"{root.rstrip('/')}/day={day}")
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs, kept = top.getFileSystem(conf), []
    first = pd.Timestamp(day) - pd.Timedelta(days=keep_days)
    for entry in fs.listStatus(top):
        name = entry.getPath().getName()
        if name.startswith("day="):
            if pd.Timestamp(name[4:]) < first:
                fs.delete(entry.getPath(), True)
            else:
                kept.append(name[4:])
    return sorted(kept)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A result as CSV with a header; with an order the files follow it, written by range so that no task holds all rows."""
    (df.orderBy(*order) if order else df).write.csv(path, header=True, mode="overwrite")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="overwrite")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.text(path)


def markdown(df: DataFrame, title: str, order: list[str], most: int = 200) -> DataFrame:
    """(place, line): a report of df in Markdown, its first `most` rows in order and a last line that says how many more there are."""
    cell = lambda c: F.coalesce(F.regexp_replace(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), r"\s+", " "), F.lit(""))
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    first = df.orderBy(*order).limit(most).select(F.struct(*order).alias("_o"), line([cell(c) for c in df.columns]).alias("line"))
    ranked = first.groupBy().agg(F.array_sort(F.collect_list(F.struct("_o", "line"))).alias("all"))  # no more than `most` rows
    rows = ranked.select(F.posexplode("all").alias("p", "r")).select((F.col("p") + 5).cast("long").alias("place"), F.col("r.line").alias("line"))
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    top = df.sparkSession.createDataFrame(list(enumerate(head, 1)), "place long, line string")
    rest = df.agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.lit(most + 6).cast("long").alias("place"), F.concat(F.lit("\n"), (F.col("n") - most).cast("string"), F.lit(" more rows")).alias("line"))
    return top.unionByName(rows).unionByName(rest)


def write_markdown(df: DataFrame, path: str, title: str, order: list[str], most: int = 200) -> None:
    """A result as one Markdown file of at most `most` rows."""
    markdown(df, title, order, most).orderBy("place").coalesce(1).select("line").write.mode("overwrite").text(path)


def write_version(df: DataFrame, root: str, version: str) -> str:
    """A new version of a table in a folder of its own; readers switch by name, so a failed write is never seen."""
    path = f"{root.rstrip('/')}/{version}"
    df.write.parquet(path)
    return path
