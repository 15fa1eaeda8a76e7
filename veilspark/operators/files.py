"""Rules about files and clients: which paths are taken, which file of a document is shown, which new clients are refused."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """Texts in Unicode's composed form; only those beyond ASCII are sent here."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def clean_path(raw: Column) -> Column:
    """A pasted path without the white space and the pair of quotes around it, in Unicode's composed form."""
    trimmed = F.trim(raw)
    bare = F.when(F.char_length(trimmed) < 2, trimmed).when(trimmed.rlike("^(\".*\"|'.*')$"), F.regexp_extract(trimmed, "^.(.*).$", 1)).otherwise(trimmed)
    return F.when(bare.rlike("[^\\x00-\\x7F]"), composed(bare)).otherwise(bare)


def path_verdicts(lines: DataFrame, existing: DataFrame) -> DataFrame:
    """ord, path, verdict of lines(ord, raw) up to the first blank one: missing, not a PDF, or taken; existing: path."""
    stop = lines.where("trim(raw) = ''").agg(F.min("ord").alias("stop"))
    rows = lines.join(F.broadcast(stop)).where("stop is null or ord < stop").select("ord", clean_path(F.col("raw")).alias("path"))
    found = rows.join(existing.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    verdict = F.when(F.col("there").isNull(), "missing").when(~F.lower("path").rlike("[^/]\\.pdf$"), "not a pdf").otherwise("taken")
    return found.select("ord", "path", verdict.alias("verdict"))


def upload_name(name: Column) -> Column:
    """The name under which an upload is stored: the last part of its path, only PDFs; null where it is refused. A file of that name is replaced."""
    base = F.element_at(F.split(F.regexp_replace(F.coalesce(name, F.lit("")), r"\\", "/"), "/"), -1)
    return F.when(F.lower(base).endswith(".pdf"), base)


def served_file(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """id and the file to show: the cleaned output, else the source, else the output of that name; a path that climbs has none.

    requests: id, filename; existing: folder (output or data), filename.
    """
    stem = F.regexp_replace("filename", r"(?i)\.pdf$", "")
    way = lambda rank, folder, name: F.struct(F.lit(rank).alias("rank"), F.lit(folder).alias("folder"), name.alias("name"))
    ways = F.array(way(0, "output", F.concat(stem, F.lit("_clean.pdf"))), way(1, "data", F.col("filename")), way(2, "output", F.col("filename")))
    tried = requests.where("instr(filename, '..') = 0").select("id", F.explode(ways).alias("w")).select("id", "w.rank", "w.folder", F.col("w.name").alias("name"))
    there = tried.join(existing.select("folder", F.col("filename").alias("name")).distinct(), ["folder", "name"], "left_semi")
    best = there.groupBy("id").agg(F.min(F.struct("rank", "folder", "name")).alias("b"))
    return requests.select("id").join(best, "id", "left").select("id", F.concat_ws("/", "b.folder", "b.name").alias("file"))


def client_refusal(name: Column, custom_id: Column, taken: Column) -> Column:
    """Why a new client is refused: 400 without a name or with more than 200 characters, 409 where its id is taken in any case; else 200."""
    bare = F.trim(F.coalesce(name, F.lit("")))
    return F.when(bare == "", 400).when(F.char_length(bare) > 200, 400).when(F.exists(taken, lambda x: F.lower(x) == F.lower(custom_id)), 409).otherwise(200)
