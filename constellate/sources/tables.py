"""Reading: JSON documents and caches, HTML rows, partitioned details, keyed fetches."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from constellate.functions.text import unescape_html


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of whole-file JSON arrays, plain or gzipped; absent fields are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_cache(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """A cache: no rows where the file is missing.  Corrupt documents give no rows, or an error if ``strict``."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(schema).option("multiLine", True).option("mode", mode).json(path)


# Fixed value: what the links of a ranked list begin with.
LISTED = "everynoise1d-"


def html_rows(pages: DataFrame, html: str, keep: list[str], pattern: str | None = None, link: str = LISTED) -> DataFrame:
    """(keep, rank, name): of each table row of a page the first match of ``pattern``; name unescaped, trimmed, lower case.

    By default a row is a cell with a number and, somewhere after it, a link whose address begins with ``link``.  Rows
    without a match and pages without text give nothing.
    """
    pattern = pattern or rf'(?s)<td[^>]*>\s*(\d+)\s*</td>.*?<a[^>]*\bhref="{re.escape(link)}[^"]*"[^>]*>([^<]+)</a>'
    rows = pages.select(*keep, F.explode(F.split(html, "</tr>")).alias("__row"))
    rank, name = F.regexp_extract("__row", pattern, 1), F.regexp_extract("__row", pattern, 2)
    return rows.select(*keep, F.nullif(rank, F.lit("")).cast("int").alias("rank"), F.lower(F.trim(unescape_html(name))).alias("name")).where("rank is not null and name != ''")


def first_available(*pages: DataFrame, html: str = "html", least: int = 500_000) -> DataFrame:
    """The first table with a page of more than ``least`` characters, only such pages of it (a live page, else its
    snapshot); the last one as it is.  Truncated and empty pages count as missing."""
    for t in pages[:-1]:
        whole = t.where(F.length(html) > least)
        if whole.limit(1).count():
            return whole
    return pages[-1]


def listed_ids(shelves: DataFrame, title: str, entries: str, word: str = "playlist", prefix: str = "VLPL") -> DataFrame:
    """(position, id): distinct ids with ``prefix`` of the shelves whose title holds ``word``, in order of first mention.

    ``shelves`` is (shelf, title, entries array of ids).
    """
    e = shelves.where(F.contains(F.lower(title), F.lit(word))).select("shelf", F.posexplode(entries).alias("at", "id")).where(F.col("id").startswith(prefix))
    return e.groupBy("id").agg(F.min(F.struct("shelf", "at")).alias("position"))


def fetch_missing(keys: DataFrame, key: str, known: list[DataFrame], fetch: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch: int = 400) -> DataFrame:
    """Rows of the keys that no ``known`` table has, fetched in parallel in batches of at most ``batch`` keys."""
    todo = keys.select(key).where(F.col(key).isNotNull()).distinct()
    for k in known:
        todo = todo.join(k.select(key), key, "left_anti")

    def run(frames):
        for f in frames:
            for i in range(0, len(f), batch):
                yield fetch(f.iloc[i : i + batch])

    return todo.mapInPandas(run, schema)


def details(spark: SparkSession, path: str, community=None) -> DataFrame:
    """Partitioned details: all, or, by partition pruning, those of one community."""
    d = spark.read.parquet(path)
    return d if community is None else d.where(F.col("continentId") == community)
