"""Service payloads in JSON text: flattened by schema, malformed ones give nulls or empty arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CERTIFICATIONS = "array<struct<certification:string,certification_date:string,category:string,country:string>>"
RELATIONSHIPS = "array<struct<type:string,songs:array<struct<id:bigint,title:string>>>>"
MEDIA = "array<struct<provider:string,url:string,native_uri:string>>"


def array_of(text: Column, schema: str) -> Column:
    """A JSON array; malformed, null and empty ones give an empty array."""
    return F.filter(F.coalesce(F.from_json(text, schema), F.array().cast(schema)), lambda x: x.isNotNull())


def relationships(text: Column) -> Column:
    """Relationships that have songs."""
    return F.filter(array_of(text, RELATIONSHIPS), lambda r: F.size(F.coalesce(r["songs"], F.array().cast("array<struct<id:bigint,title:string>>"))) > 0)


def media_url(text: Column, provider: str) -> Column:
    """The first url of a provider."""
    return F.get(F.filter(array_of(text, MEDIA), lambda m: m["provider"] == provider), F.lit(0))["url"]


def song_fields(text: Column) -> Column:
    """struct<album, release_date, isrc> of a song payload."""
    at = lambda p: F.get_json_object(text, p)
    return F.struct(at("$.album.name").alias("album"), F.coalesce(at("$.release_date"), at("$.release_date_for_display")).alias("release_date"), at("$.isrc").alias("isrc"))


def first_track(text: Column) -> Column:
    """The first track of a reply that is a list, an object with a list or an object under 'content', or the object itself."""
    at = lambda p: F.get_json_object(text, p)
    return F.coalesce(F.when(F.trim(text).startswith("["), at("$[0]")), at("$.content[0]"), F.when(~F.coalesce(at("$.content"), F.lit("")).startswith("["), at("$.content")), F.when(F.trim(text).startswith("{") & at("$.content").isNull(), text))
