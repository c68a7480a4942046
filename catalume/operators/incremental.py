"""Search documents after changes: only those that a change can touch are made anew.

A change set names the rows that changed, by kind. The closure over the catalog's links, before and after the
change, gives the packages whose documents may differ; their documents are made from the catalog as it is now,
restricted to them, and all others are taken over as they are stored.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Catalog
from . import listing

#: The kinds of a change set, with the column that names what changed.
KINDS = {"package": "id", "resource": "package_id", "package_tag": "package_id", "package_group": "package_id", "tag": "tag", "grp": "id", "organization": "id"}
_OWN = {"package_core": "id", "package": "id", "package_notes": "id", "resource": "package_id", "package_tag": "package_id", "package_group": "package_id"}


def with_tables(catalog: Catalog, **tables: DataFrame) -> Catalog:
    """The catalog with other tables in place of its own; views over them follow."""
    out = Catalog(catalog.spark, catalog.path)
    out.__dict__.update(tables)
    return out


def restricted(catalog: Catalog, ids: DataFrame) -> Catalog:
    """The catalog of some packages alone (``id``, distinct), with all that hangs on them."""
    held = {name: getattr(catalog, name).join(ids.select(F.col("id").alias(key)), key, "left_semi") for name, key in _OWN.items()}
    return with_tables(catalog, **held, organization=catalog.organization, grp=catalog.grp)


def _touched(catalog: Catalog, kind: str, changed: DataFrame) -> DataFrame:
    own = changed.select(F.col(KINDS[kind]).alias("__key")).distinct()
    if kind in ("package", "resource", "package_tag", "package_group"):
        return own.select(F.col("__key").alias("id"))
    links, key, id = {
        "tag": (catalog.package_tag, "tag", "package_id"),
        "grp": (catalog.package_group, "group_id", "package_id"),
        "organization": (catalog.package_core, "owner_org", "id"),
    }[kind]
    return links.join(own, F.col(key) == F.col("__key"), "left_semi").select(F.col(id).alias("id"))


def affected(before: Catalog, after: Catalog, changes: Mapping[str, DataFrame]) -> DataFrame:
    """(id) of the packages whose documents a change set may touch: its links before and after count."""
    found = [_touched(c, kind, rows) for kind, rows in changes.items() for c in ((before, after) if kind in ("tag", "grp", "organization") else (after,))]
    return reduce(DataFrame.unionByName, found).distinct()


def rebuilt(documents: DataFrame, before: Catalog, after: Catalog, changes: Mapping[str, DataFrame]) -> DataFrame:
    """The documents after a change set: ``documents``, with those of affected packages made anew, or gone."""
    ids = affected(before, after, changes)
    new = listing.package_documents(restricted(after, ids)).select(*documents.columns)
    return documents.join(ids, "id", "left_anti").unionByName(new)
