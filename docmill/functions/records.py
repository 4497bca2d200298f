"""Entities, relationships and metadata out of a model's JSON answer, with defaults for what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import entity_type, json_part

SCHEMA = (
    "struct<entities:array<struct<id:string,name:string,type:string,description:string>>,"
    "relationships:array<struct<source:string,target:string,type:string,description:string>>,"
    "title:string,document_type:string,keywords:array<string>>"
)


def parsed(df: DataFrame, key: str, answer: str) -> DataFrame:
    return df.select(key, F.from_json(json_part(F.col(answer)), SCHEMA, {"mode": "PERMISSIVE"}).alias("r"))


def entities(df: DataFrame, key: str, answer: str) -> DataFrame:
    """One row per named entity; ids that are missing come from the place, and all carry the key in front."""
    e = parsed(df, key, answer).select(key, F.posexplode("r.entities").alias("no", "e")).where("trim(e.name) <> ''")
    own = F.coalesce(F.nullif(F.col("e.id"), F.lit("")), F.concat(F.lit("e"), F.col("no") + 1))
    return e.select(key, F.concat_ws(":", key, own).alias("id"), F.trim("e.name").alias("name"), entity_type(F.coalesce("e.type", F.lit("Concept"))).alias("type"), F.coalesce("e.description", F.lit("")).alias("description"))


def relationships(df: DataFrame, key: str, answer: str) -> DataFrame:
    """One row per relationship with two ends; types are upper-cased, unknown ones left to graph.resolved_relations."""
    r = parsed(df, key, answer).select(key, F.explode("r.relationships").alias("x")).where("x.source is not null and x.target is not null")
    return r.select(F.concat_ws(":", key, "x.source").alias("src"), F.concat_ws(":", key, "x.target").alias("dst"), F.upper(F.coalesce("x.type", F.lit("RELATED_TO"))).alias("rel_type"), F.coalesce("x.description", F.lit("")).alias("description"))


def metadata(df: DataFrame, key: str, answer: str) -> DataFrame:
    r = parsed(df, key, answer)
    return r.select(key, F.coalesce("r.title", F.lit("")).alias("title"), F.coalesce("r.document_type", F.lit("unknown")).alias("document_type"), F.coalesce("r.keywords", F.array().cast("array<string>")).alias("keywords"))
