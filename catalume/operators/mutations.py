"""Changes of the catalog as pure functions from tables to tables.

No table format with row-level merges is at hand, so a change returns the new table; publishing it is an
atomic swap of a path. Each is a keyed anti join or a projection, so it shuffles on the key at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalize_format, valid_name


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` take the place of those with their key, or are added. Of several new rows with one key the driver doesn't choose: give one."""
    return table.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(rows.select(*keys).distinct(), list(keys), "left_anti")


def delete_prefix(objects: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """Objects whose path doesn't begin with the prefix."""
    return objects.where(~F.col(path).startswith(prefix))


def patch(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Given values replace old ones; null means not given."""
    given = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in given])
    merged = table.join(new, key, "left")
    return merged.select(*[F.coalesce(f"__{c}", c).alias(c) if c in given else F.col(c) for c in table.columns])


def set_state(table: DataFrame, where: Column, state: str) -> DataFrame:
    """Soft delete and restore."""
    return table.withColumn("state", F.when(where, F.lit(state)).otherwise(F.col("state")))


def purge(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Packages ``ids`` and all that hangs on them go: resources, links, jobs."""
    gone = ids.select(F.col("id").alias("package_id"))
    resources = tables["resource"].join(gone, "package_id", "left_semi").select(F.col("id").alias("resource_id"))
    out = dict(tables)
    out["package"] = tables["package"].join(ids.select("id"), "id", "left_anti")
    for name in ("resource", "package_tag", "package_group"):
        out[name] = tables[name].join(gone, "package_id", "left_anti")
    out["pipeline"] = tables["pipeline"].join(resources, "resource_id", "left_anti")
    return out


def create_packages(packages: DataFrame, rows: DataFrame, organizations: DataFrame) -> DataFrame:
    """New rows with ``rejected``: why a row can't be created, or null."""
    taken = packages.select("name", F.lit(True).alias("__taken")).distinct()
    known = organizations.where("state = 'active'").select(F.col("id").alias("owner_org"), F.lit(True).alias("__org"))
    checked = rows.join(taken, "name", "left").join(known, "owner_org", "left")
    reason = (
        F.when(~valid_name(F.col("name")), "name")
        .when(F.col("__taken").isNotNull(), "taken")
        .when(F.col("owner_org").isNotNull() & F.col("__org").isNull(), "organization")
    )
    return checked.withColumn("rejected", reason).drop("__taken", "__org")


def find_or_create_tags(tags: DataFrame, names: DataFrame) -> DataFrame:
    """Tags with those of ``names`` that were missing; a new tag's id is its name's."""
    new = names.select("name").distinct().join(tags.select("name"), "name", "left_anti")
    return tags.unionByName(new.select(F.sha2("name", 256).alias("id"), "name"))


def replace_links(links: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All links of the keys in ``new`` are replaced by those of ``new``."""
    return links.join(new.select(key).distinct(), key, "left_anti").unionByName(new.distinct())


def linked(owners: DataFrame, packages: DataFrame, column: str) -> DataFrame:
    """Owners that can't be purged, as packages still point at them."""
    return owners.join(packages.select(F.col(column).alias("id")).distinct(), "id", "left_semi")


def create_resources(rows: DataFrame) -> DataFrame:
    return rows.withColumn("format", normalize_format(F.col("format")))


def reorder_errors(resources: DataFrame, package: str, ids: Sequence[str]) -> list[str]:
    """What is wrong with a new order of a package's resources; empty if nothing."""
    wanted = resources.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    own = resources.where((F.col("package_id") == package) & (F.col("state") == "active")).select("id")
    found = ["repeated"] if len(set(ids)) < len(ids) else []
    found += ["unknown"] if not wanted.join(own, "id", "left_anti").isEmpty() else []
    return found + (["missing"] if not own.join(wanted, "id", "left_anti").isEmpty() else [])


def reorder(resources: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Positions 0, 1, … in the order of ``ids``; other rows keep theirs."""
    order = resources.sparkSession.createDataFrame(list(enumerate(ids)), "__at int, id string")
    return resources.join(order, "id", "left").withColumn("position", F.coalesce("__at", "position")).drop("__at")


def delete_user(users: DataFrame, sessions: DataFrame, tokens: DataFrame, user: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The user is marked as deleted and loses all sessions and tokens."""
    keep = F.col("user_id") != user
    return set_state(users, F.col("id") == user, "deleted"), sessions.where(keep), tokens.where(keep)


def valid_tokens(tokens: DataFrame, users: DataFrame, raw: str, now) -> DataFrame:
    """The active user of an unexpired token, by its hash."""
    live = tokens.where(F.col("hash") == F.sha2(F.lit(raw), 256)).where(F.col("expires").isNull() | (F.col("expires") >= F.lit(now)))
    return live.join(users.where("state = 'active'").select(F.col("id").alias("user_id"), "name", "role"), "user_id").select("user_id", "name", "role")


def reset(tables: dict[str, DataFrame], keep: Sequence[str] = ("user",)) -> dict[str, DataFrame]:
    """Empty tables, but for those kept."""
    return {name: df if name in keep else df.limit(0) for name, df in tables.items()}


def create_with_links(tables: dict[str, DataFrame], rows: DataFrame) -> dict[str, DataFrame]:
    """``package``, ``tag`` and ``package_tag`` after new packages (with an array ``tags``) are created; rows that can't be are left out."""
    checked = create_packages(tables["package"], rows.drop("tags"), tables["organization"])
    good = rows.join(checked.where("rejected IS NULL").select("id"), "id", "left_semi")
    named = good.select(F.col("id").alias("package_id"), F.explode(F.array_distinct("tags")).alias("name"))
    tags = find_or_create_tags(tables["tag"], named)
    links = named.join(tags.select(F.col("id").alias("tag_id"), "name"), "name").select("package_id", "tag_id")
    package = tables["package"].unionByName(good.drop("tags"), allowMissingColumns=True)
    return {**tables, "package": package, "tag": tags, "package_tag": tables["package_tag"].unionByName(links)}


def update_with_links(tables: dict[str, DataFrame], changes: DataFrame) -> dict[str, DataFrame]:
    """Given fields replace old ones; a given array ``tags`` (null: not given) replaces all of a package's tags."""
    package = patch(tables["package"], changes.drop("tags"), "id")
    given = changes.where(F.col("tags").isNotNull()).join(tables["package"].select("id"), "id", "left_semi")
    named = given.select(F.col("id").alias("package_id"), F.explode(F.array_distinct("tags")).alias("name"))
    tags = find_or_create_tags(tables["tag"], named)
    links = named.join(tags.select(F.col("id").alias("tag_id"), "name"), "name").select("package_id", "tag_id")
    kept = tables["package_tag"].join(given.select(F.col("id").alias("package_id")), "package_id", "left_anti")
    return {**tables, "package": package, "tag": tags, "package_tag": kept.unionByName(links)}


def set_members(memberships: DataFrame, changes: DataFrame) -> DataFrame:
    """Members are added or get another role; one whose new role is null is removed."""
    keys = ["user_id", "organization_id"]
    return upsert(memberships, changes, keys).where(F.col("role").isNotNull())


def update_resources(resources: DataFrame, changes: DataFrame) -> DataFrame:
    """Given fields replace old ones; a given format is normalised."""
    return patch(resources, changes.withColumn("format", normalize_format(F.col("format"))), "id")


def complete_upload(resources: DataFrame, uploads: DataFrame) -> DataFrame:
    """Uploaded resources (id, url, size, hash) take what was stored and count as uploads."""
    done = uploads.select("id", F.col("url").alias("__url"), F.col("size").alias("__size"), F.col("hash").alias("__hash"))
    out = resources.join(done, "id", "left")
    new = F.col("__url").isNotNull()
    for c in ("url", "size", "hash"):
        out = out.withColumn(c, F.when(new, F.col(f"__{c}")).otherwise(F.col(c)))
    return out.withColumn("url_type", F.when(new, "upload").otherwise(F.col("url_type"))).drop("__url", "__size", "__hash")


def restore_users(users: DataFrame, ids: DataFrame) -> DataFrame:
    """Deleted users among ``ids`` are active again; others stay as they are."""
    asked = ids.select("id", F.lit(True).alias("__asked")).distinct()
    state = F.when(F.col("__asked").isNotNull() & (F.col("state") == "deleted"), "active").otherwise(F.col("state"))
    return users.join(asked, "id", "left").withColumn("state", state).drop("__asked")


def purge_users(tables: dict[str, DataFrame], ids: DataFrame, by: str) -> dict[str, DataFrame]:
    """Deleted users among ``ids`` without packages go for good: their activity and log entries lose the name, and the log gains a line each."""
    gone = tables["user"].where("state = 'deleted'").join(ids.select("id"), "id", "left_semi")
    gone = gone.join(tables["package"].select(F.col("creator_user_id").alias("id")), "id", "left_anti")
    named = gone.select(F.col("id").alias("user_id"), F.lit(True).alias("__gone"))
    out = dict(tables)
    for name in ("activity", "audit_log"):
        blank = tables[name].join(named, "user_id", "left")
        out[name] = blank.withColumn("user_id", F.when(F.col("__gone").isNull(), F.col("user_id"))).select(*tables[name].columns)
    changes = F.to_json(F.struct(F.col("id").alias("purgedUserId"), F.col("email").alias("purgedEmail"), F.col("name").alias("purgedName")))
    entries = gone.select(F.lit("user").alias("entity_type"), F.lit("purge").alias("action"), F.lit(by).alias("user_id"), changes.alias("changes"))
    out["audit_log"] = out["audit_log"].unionByName(entries, allowMissingColumns=True)
    out["user"] = tables["user"].join(gone.select("id"), "id", "left_anti")
    return out


def set_steps(steps: DataFrame, changes: DataFrame) -> DataFrame:
    """Steps of a job are added, or take a new status; what isn't given (null) stays."""
    keys = ["resource_id", "step_name"]
    new = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in changes.columns if c not in keys])
    both = steps.join(new, keys, "full")
    return both.select(*keys, *[F.coalesce(f"__{c}", c).alias(c) if c in changes.columns else F.col(c) for c in steps.columns if c not in keys])


def restart_jobs(jobs: DataFrame, steps: DataFrame, ids: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Jobs of ``ids`` are queued (again) without an error, and their steps go; other columns, as a preview key, stay."""
    asked = ids.select(F.col("id").alias("resource_id"), F.lit(True).alias("__asked")).distinct()
    both = jobs.join(asked, "resource_id", "full")
    new = F.col("__asked").isNotNull()
    values = {"status": F.lit("queued"), "error": F.lit(None).cast("string"), "updated": F.lit(now).cast(jobs.schema["updated"].dataType)}
    queued = both.select(*[F.when(new, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in jobs.columns])
    return queued, steps.join(asked, "resource_id", "left_anti")


def deleted_by_prefix(objects: DataFrame, prefix: str, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """What is left of the objects, and a row with the number of those that go."""
    return delete_prefix(objects, prefix, path), objects.where(F.col(path).startswith(prefix)).agg(F.count("*").alias("deleted"))
