"""Catalog queries: scopes, latest rows, counts with defaults, semi- and anti-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOCAL_TENANT = "000000"


def tenant_scope(c: Column, tenant: str | None) -> Column:
    """Rows of a tenant; the local tenant also owns rows without one."""
    if tenant in (None, "", LOCAL_TENANT):
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(LOCAL_TENANT)) == LOCAL_TENANT
    return c == tenant


def data_scope(rows: DataFrame, mode: str, department: str, user: str, departments: Sequence = (), users: DataFrame | None = None, user_key: str = "user_id") -> DataFrame:
    """``ALL`` keeps every row. ``RESTRICTED`` keeps rows of the listed departments or whose
    user is in ``users``; with neither list it keeps none."""
    if mode == "ALL":
        return rows
    if not departments and users is None:
        return rows.where(F.lit(False))
    listed = F.col(department).isin(list(departments)) if departments else F.lit(False)
    if users is None:
        return rows.where(listed)
    known = users.select(F.col(user_key).alias("__user")).distinct().withColumn("__in", F.lit(True))
    return rows.join(known, F.col(user) == F.col("__user"), "left").where(listed | F.col("__in")).drop("__user", "__in")


def latest_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``: a map-side combined maximum, no sort per key."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return best.select(*key, "last.*")


def counts_with_default(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, **aggregates: Column) -> DataFrame:
    """Parents with aggregates over their children, 0 where they have none."""
    found = children.groupBy(F.col(child_key).alias(parent_key)).agg(*(v.alias(k) for k, v in aggregates.items()))
    return parents.join(found, parent_key, "left").na.fill(0, list(aggregates))


def orphans(rows: DataFrame, links: DataFrame, on: str) -> DataFrame:
    return rows.join(links, on, "left_anti")


def nested(parents: DataFrame, children: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """Parents with their children as an ordered array of structs (empty without any)."""
    fields = [c for c in children.columns if c != key]
    lead = [*order, *(c for c in fields if c not in order)]
    own = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*lead))).alias(name))
    return parents.join(own, key, "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))


def page(rows: DataFrame, order: Sequence[str | Column], number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def compare(old: DataFrame, new: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Full outer comparison: one row per key with ``change`` same, changed, added or removed."""
    o, n = old.select(*key, F.col(value).alias("old"), F.lit(True).alias("o")), new.select(*key, F.col(value).alias("new"), F.lit(True).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return o.join(n, list(key), "full_outer").withColumn("change", change).drop("o", "n")


def deduplicate_uploads(docs: DataFrame, scope: str, content: str, order: str) -> DataFrame:
    """Per scope the first document of each content; deleted ones (null content hash) all stay."""
    w = Window.partitionBy(scope, F.sha2(content, 256)).orderBy(order)
    return docs.withColumn("__n", F.row_number().over(w)).where("__n = 1 or deleted" if "deleted" in docs.columns else "__n = 1").drop("__n")


def rate_limited(failures: DataFrame, key: str, ts: str, seconds: int = 60, most: int = 5) -> DataFrame:
    """Failures with how many their key had in the last ``seconds`` (itself included) and
    whether that reaches ``most``."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return failures.withColumn("recent", F.count("*").over(w)).withColumn("limited", F.col("recent") >= most)


def merge_events(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Union of event lists; of events with one key the newer list's stays."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def usage_counts(versions: DataFrame, bindings: DataFrame) -> DataFrame:
    """(template_id, uses, versions): bindings per template, 0 without any."""
    uses = bindings.groupBy("version_id").agg(F.count("*").alias("uses"))
    return versions.join(uses, "version_id", "left").groupBy("template_id").agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("uses"), F.count("*").alias("versions"))


def claimable_job(jobs: DataFrame, most_attempts: int = 3) -> DataFrame:
    """The pending job with the least id that may still be tried."""
    return jobs.where((F.col("status") == "pending") & (F.col("attempts") < most_attempts)).orderBy("id").limit(1)


def live_sessions(users: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    return users.join(sessions.where(F.col("expires_at") > now), "user_id")


def filtered_documents(docs: DataFrame, now: Column, status: str | None = None, size: str | None = None, age_days: int | None = None, has_chunks: bool | None = None, title: str | None = None) -> DataFrame:
    """Documents by shown status, size tier (small to 100 KiB, medium under 1 MiB, large), age,
    chunks and a part of the title; filters that are not given let all pass."""
    tests = []
    if status:
        tests.append(F.col("status") == status)
    if size:
        kib = F.col("bytes") / 1024
        tests.append({"small": kib <= 100, "medium": (kib > 100) & (kib < 1024), "large": kib >= 1024}[size])
    if age_days is not None:
        tests.append(F.unix_timestamp("created_at") >= F.unix_timestamp(now) - age_days * 86400)
    if has_chunks is not None:
        tests.append((F.coalesce("chunk_count", F.lit(0)) > 0) == has_chunks)
    if title:
        tests.append(F.contains(F.lower("title"), F.lower(F.lit(title))))
    for t in tests:
        docs = docs.where(t)
    return docs


def owned_documents(docs: DataFrame, kbs: DataFrame, owner: object) -> DataFrame:
    """Documents with their knowledge base's columns, where ``owner`` owns it."""
    return docs.join(kbs.where(F.col("owner_id") == owner), "kb_id")


def template_versions(versions: DataFrame, templates: DataFrame) -> DataFrame:
    """Versions with their template's columns, the newest of each template marked ``latest``."""
    newest = versions.groupBy("template_id").agg(F.max("version").alias("__newest"))
    both = versions.join(templates, "template_id").join(newest, "template_id")
    return both.withColumn("latest", F.col("version") == F.col("__newest")).drop("__newest")


def bound_versions(bindings: DataFrame, versions: DataFrame) -> DataFrame:
    """Each document's mapping version; more than one for a document is an error."""
    one = bindings.groupBy("document_id").agg(F.max("version_id").alias("version_id"), F.count("*").alias("__n"))
    sure = F.when(F.col("__n") == 1, F.col("version_id")).otherwise(F.raise_error(F.lit("a document has two bindings")))
    return one.select("document_id", sure.alias("version_id")).join(versions, "version_id")


def without_references(rows: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """Rows whose ``on`` is not among those of ``gone``: what a delete leaves; nulls stay."""
    return rows.join(gone.select(on).distinct(), on, "left_anti")


def backfilled(rows: DataFrame, links: DataFrame, sources: DataFrame, link: str, source: str, column: str) -> DataFrame:
    """``column`` filled, where it is null, from ``sources`` (source, value), which rows reach
    over ``links`` (link, source); else from the one greatest value of all sources."""
    most = sources.agg(F.max("value").alias("__most"))
    reached = links.join(sources, source).groupBy(link).agg(F.max("value").alias("__value"))
    both = rows.join(reached, link, "left").crossJoin(F.broadcast(most))  # one row
    return both.withColumn(column, F.coalesce(column, "__value", "__most")).drop("__value", "__most")


def owner_counts(rows: DataFrame, owner: str, enabled: Column, most: int = 20) -> DataFrame:
    """(owner, total, enabled, may_add): rows and enabled rows per owner, and whether the owner
    has fewer than ``most``."""
    n = rows.groupBy(owner).agg(F.count("*").alias("total"), F.count_if(enabled).alias("enabled"))
    return n.withColumn("may_add", F.col("total") < most)


def preview(rows: DataFrame, order: Sequence[str | Column], wanted: int = 5) -> DataFrame:
    """The first rows (1 to 50 of them) with how many there are in all (``of``)."""
    first = rows.orderBy(*order).limit(min(max(wanted, 1), 50))
    return first.crossJoin(F.broadcast(rows.agg(F.count("*").alias("of"))))  # one row


def keyword_on_page(rows: DataFrame, order: Sequence[str | Column], number: int, size: int, content: str, keyword: str) -> DataFrame:
    """Of one page, the rows whose content holds the keyword in any case; pages are cut before
    the filter, so one may come back short."""
    return page(rows, order, number, size).where(F.contains(F.lower(content), F.lit(keyword.lower())))


def recent_first(rows: DataFrame, updated: str, name: str, n: int = 50) -> DataFrame:
    """The ``n`` newest rows: those never updated first, then by time; ties by name, in the
    order of its collation without case."""
    order = [F.desc_nulls_first(updated), F.collate(F.col(name), "UNICODE_CI"), F.col(name)]
    return rows.orderBy(*order).limit(n)


def has_repeats(ids: Column) -> Column:
    return F.size(F.array_distinct(ids)) < F.size(ids)


def clamped_page(rows: DataFrame, order: Sequence[str | Column], number: int, size: int) -> DataFrame:
    """A page, or the last one where ``number`` lies behind it, or the first where it lies before.
    The rows are counted for that; an empty table has one empty page."""
    last = max(1, -(-rows.count() // size))
    return page(rows, order, min(max(number, 1), last), size)


def completed_messages(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("status") == "completed")


def present_documents(docs: DataFrame, gone: Sequence[str] = ("deleting", "deleted")) -> DataFrame:
    """Documents that are not on their way out; one without a status is there."""
    return docs.where(~F.coalesce(F.col("status").isin(*gone), F.lit(False)))


def enabled_kbs(kbs: DataFrame) -> DataFrame:
    return kbs.where(F.coalesce("enabled", F.lit(False)))


def may_create_first_admin(users: DataFrame) -> DataFrame:
    """One row: whether there is no user yet."""
    return users.agg(F.count("*").alias("n_users")).withColumn("allowed", F.col("n_users") == 0)


def guarded_versions(versions: DataFrame, mappings: DataFrame) -> DataFrame:
    """Versions with ``n_uses`` and ``immutable``: a version that any document's mapping uses cannot change."""
    uses = mappings.where("version_id is not null").groupBy("version_id").agg(F.count("*").alias("n_uses"))
    n = F.coalesce("n_uses", F.lit(0))
    return versions.join(uses, "version_id", "left").withColumns({"n_uses": n, "immutable": n > 0})


def linked_kbs(conversations: DataFrame, links: DataFrame, kbs: DataFrame) -> DataFrame:
    """Conversations with the different knowledge bases that they are linked to, by id: ``kb_ids``,
    ``kb_names`` (null where one is not among ``kbs``) and the first as ``kb_id``. Empty lists and null without links."""
    named = links.select("conv_id", "kb_id").distinct().join(kbs.select("kb_id", "kb_name"), "kb_id", "left")
    own = named.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("kb_id", "kb_name"))).alias("__kbs"))
    both = conversations.join(own, "conv_id", "left")
    none = F.array().cast(own.schema["__kbs"].dataType)
    kb = F.coalesce("__kbs", none)
    return both.withColumns({"kb_ids": F.transform(kb, lambda k: k.kb_id), "kb_names": F.transform(kb, lambda k: k.kb_name), "kb_id": F.get(kb, 0).kb_id}).drop("__kbs")


def saved_versions(versions: DataFrame, incoming: DataFrame) -> DataFrame:
    """Where each incoming definition (template_id, fingerprint, one a template) is kept: the template's
    newest version if that has the same fingerprint (``created`` false), else one more than
    the newest. ``versions`` (template_id, version, fingerprint); an older version is never taken up again."""
    newest = versions.groupBy("template_id").agg(F.max(F.struct("version", "fingerprint")).alias("__last"))
    both = incoming.join(newest, "template_id", "left")
    same = F.coalesce(F.col("__last.fingerprint") == F.col("fingerprint"), F.lit(False))
    return both.withColumns({"version": F.coalesce("__last.version", F.lit(0)) + F.when(same, 0).otherwise(1), "created": ~same}).drop("__last")
