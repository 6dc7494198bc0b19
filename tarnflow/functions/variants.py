"""Session data as VARIANT: JSON of any shape, read by paths and types when it is asked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def data(json: Column) -> Column:
    """JSON as a variant; null where it isn't JSON."""
    return F.try_parse_json(json)


def field(v: Column, path: str, kind: str) -> Column:
    """A field of a variant in a type; null where it is missing, null, or of a kind that can't be that type."""
    return F.try_variant_get(v, path, kind)


def kind(v: Column, path: str) -> Column:
    """The type that a field has, as DDL; null where there is none."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def shape(v: Column) -> Column:
    """The merged type of all variants of a group: an aggregate, as DDL."""
    return F.schema_of_variant_agg(v)
