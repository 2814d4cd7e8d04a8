"""Mapped records with their children: echoes removed from parents, parents before children."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jsonmap import Mapping, compile_path, get, map_records

OUT = ["source_pointer", "batch", "child_index", "record_type", "record_id", "parent_id", "title", "content", "keywords", "filters", "timestamps", "display", "issues", "chunk_policy", "rejected"]


def _children(rows: DataFrame, child: Mapping, keys: Sequence[str], batch: int, source_hash: str) -> DataFrame:
    """Mapped children of each row of ``rows``, with the raw values that the relation compares."""
    array = F.try_variant_get("record", compile_path(child.record_path, relative=True).spark, "array<variant>")
    each = rows.select(*keys, F.col("source_pointer").alias("__parent"), F.posexplode(array).alias("child_index", "record"))
    # Elements that are no objects are left out; the others keep their place.
    each = each.where(F.schema_of_variant("record").startswith("OBJECT"))
    name = child.record_path.split("[", 1)[0]
    each = each.withColumns({"source_pointer": F.concat_ws("/", "__parent", F.lit(name), F.col("child_index").cast("string")), "batch": F.lit(batch)})
    source, target = child.relation or (None, None)
    compared = {f"__{k}": get(F.col("record"), f) if f else F.lit(None).cast("string") for k, f in (("source", source), ("target", target))}
    return map_records(each.withColumns(compared), child, source_hash)


def _related(kids: DataFrame, within: Sequence[Column | str]) -> DataFrame:
    """Adds ``__near``: the id of the nearest earlier sibling with a target value, if that equals the
    child's source value. Rejected siblings do not count."""
    earlier = Window.partitionBy(*within, "batch").orderBy("child_index").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("__target").isNotNull(), F.struct(F.col("__target").alias("t"), F.col("record_id").alias("i"))), ignorenulls=True).over(earlier)
    return kids.withColumn("__last", last).withColumn("__near", F.when(F.col("__last.t") == F.col("__source"), F.col("__last.i"))).drop("__last")


def map_tree(rows: DataFrame, mapping: Mapping, keys: Sequence[str] = (), source_hash: str = "", rejected: bool = False) -> DataFrame:
    """Mapped records of ``rows`` (source_pointer, record variant, and ``keys``, which with the pointer tell
    records apart) and of their children, in one plan.

    Children are mapped first; their contents, those of rejected ones apart, are what
    ``remove_child_echo`` takes out of the parent's lines. Then come the parents, then the
    children of parents that were not rejected, under the parent or, by the mapping's relation, under the
    nearest earlier sibling. ``batch`` (0: the parent, then the child record types in order) and
    ``child_index`` give the order within a source record. Rejected records are left out, or kept
    with their issues if ``rejected`` is true (children of a rejected parent then have no parent_id).

    Only contents are gathered, by the parent they come from; so a group is never larger than
    the one source record that holds it."""
    mapping.validate()
    keys, on = list(keys), [*keys, "__parent"]
    kids = None
    for i, child in enumerate(mapping.children):
        one = _children(rows, child, keys, i + 1, source_hash)
        kids = one if kids is None else kids.unionByName(one)
    parents = rows.withColumn("__parent", F.col("source_pointer"))
    if kids is not None and any("remove_child_echo" in f.transforms for f in mapping.fields):
        said = kids.where("not rejected and content <> ''").groupBy(*on).agg(F.collect_set("content").alias("__echoes"))
        parents = parents.join(said, on, "left").withColumn("__echoes", F.coalesce("__echoes", F.array().cast("array<string>")))
        parents = map_records(parents, mapping, source_hash, "__echoes")
    else:
        parents = map_records(parents, mapping, source_hash)
    parents = parents.withColumns({"batch": F.lit(0), "child_index": F.lit(0), "parent_id": F.lit(None).cast("string")})
    columns = [*keys, *OUT]
    out = parents.select(*columns)
    if kids is not None:
        good = _related(kids.where("not rejected"), on)
        if rejected:
            good = good.unionByName(kids.where("rejected").withColumn("__near", F.lit(None).cast("string")))
        above = parents.where("not rejected").select(*on, F.col("record_id").alias("__above"))
        good = good.join(above, on, "left" if rejected else "inner")
        out = out.unionByName(good.withColumn("parent_id", F.when(F.col("__above").isNotNull(), F.coalesce("__near", "__above"))).select(*columns))
    return out if rejected else out.where("not rejected")


def preview(rows: DataFrame, mapping: Mapping, n: int = 20, keys: Sequence[str] = (), source_hash: str = "") -> DataFrame:
    """The first ``n`` source records, by ``keys`` and pointer, mapped with their children and every issue:
    what a mapping does before it is applied. A top-n report: only these records are mapped."""
    return map_tree(rows.orderBy(*keys, "source_pointer").limit(n), mapping, keys, source_hash, rejected=True)
