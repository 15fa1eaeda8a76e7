"""Reviews and client configurations as JSON documents, out and in. What is missing or doesn't parse gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REC = "struct<id:string,entity:string,suggested_category:string,tokenize:boolean,token:string,n_occ:bigint,consensus_passed:boolean>"
DECISION = "struct<category:string,tokenize:boolean,token:string,rejected:boolean>"
REVIEW = f"struct<client_id:string,stem:string,status:string,recommendations:array<{REC}>,manual_additions:array<struct<entity:string,category:string,tokenize:boolean,token:string>>,decisions:map<string,{DECISION}>>"
CONFIG = "struct<client_id:string,updated_at:string,literals:array<struct<entity:string,category:string,tokenize:boolean,token:string,rejected:boolean,first_seen:string>>>"


def review_json(recs: DataFrame, manual: DataFrame, decisions: DataFrame, *, status: str = "analyzed") -> DataFrame:
    """client_id, stem and the review's shell as JSON: recommendations in order of their ids, manual additions, decisions by entity.

    recs: client_id, stem, id, entity, category, tokenize, token, n_occ, consensus_passed. Every review that any of the
    three tables names has a shell; keys that are null are left out.
    """
    key = ["client_id", "stem"]
    rec = F.struct("id", "entity", F.col("category").alias("suggested_category"), "tokenize", "token", F.col("n_occ").cast("bigint").alias("n_occ"), "consensus_passed")
    a = recs.groupBy(*key).agg(F.array_sort(F.collect_list(rec)).alias("recommendations"))
    b = manual.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("entity", "category", "tokenize", "token"))).alias("manual_additions"))
    c = decisions.groupBy(*key, "entity").agg(F.max(F.struct("category", "tokenize", "token", "rejected")).alias("d"))
    c = c.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity", "d")))).alias("decisions"))
    shell = a.join(b, key, "full").join(c, key, "full")
    return shell.select(*key, F.to_json(F.struct(*key, F.lit(status).alias("status"), F.coalesce("recommendations", F.array().cast(f"array<{REC}>")).alias("recommendations"), "manual_additions", "decisions")).alias("review"))


def parsed(rows: DataFrame, column: str, kind: str) -> DataFrame:
    """rows with v, the parsed JSON; those that don't parse or aren't objects are left out."""
    return rows.withColumn("v", F.from_json(column, kind, {"mode": "PERMISSIVE"})).where("v.client_id is not null")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path, wholetext=True), "value", REVIEW)


def recommendations(reviews: DataFrame) -> DataFrame:
    return reviews.select("v.client_id", "v.stem", F.explode("v.recommendations").alias("r")).select("client_id", "stem", "r.id", "r.entity", F.col("r.suggested_category").alias("category"), "r.tokenize", "r.token", "r.n_occ", "r.consensus_passed")


def decisions(reviews: DataFrame) -> DataFrame:
    return reviews.select("v.client_id", "v.stem", F.explode("v.decisions").alias("entity", "d")).select("client_id", "stem", "entity", "d.*")


def config_json(literals: DataFrame, updated_at: str) -> DataFrame:
    """client_id and its configuration as JSON, stamped; literals in the order of their entities. Written by client, it replaces the one before."""
    one = F.struct("entity", "category", "tokenize", "token", "rejected", "first_seen")
    return literals.groupBy("client_id").agg(F.array_sort(F.collect_list(one)).alias("literals")).select("client_id", F.to_json(F.struct("client_id", F.lit(updated_at).alias("updated_at"), "literals")).alias("config"))


def literals(configs: DataFrame) -> DataFrame:
    return configs.select("v.client_id", F.explode("v.literals").alias("l")).select("client_id", "l.*")
