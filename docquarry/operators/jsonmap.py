"""Schema-on-read JSON: paths, profiles, role suggestions and mappings to records."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..functions.unicode import parsed_datetime

_STEP = re.compile(r"\.?([A-Za-z_㐀-鿿][\w㐀-鿿]*)|\[(\d+)\]|\[(\*)\]")


@dataclass(frozen=True)
class Path:
    """A compiled path: Spark's JSONPath up to the wildcard, and whether one ends it."""

    spark: str
    many: bool

    @property
    def pointer(self) -> str:
        """Base of the pointers of the records that the path yields."""
        return re.sub(r"[.\[\]$\"]+", "/", self.spark.replace("$", "", 1)).rstrip("/") + "/"


def compile_path(value: str, relative: bool = False) -> Path:
    """Compile ``$.a.b[0].c[*]`` (``a.b`` if relative). One wildcard may stand at the end;
    recursion, filters, functions, negative and repeated indexes are refused."""
    if not relative and not value.startswith("$"):
        raise ValueError(f"path must begin with $: {value!r}")
    rest, out, many, before = value.removeprefix("$"), "$", False, ""
    at = 0
    while at < len(rest):
        m = _STEP.match(rest, at)
        if not m or many or (m[1] and rest[at] != "." and not (relative and at == 0)):
            raise ValueError(f"unsupported path: {value!r}")
        if before == "index" and not m[1]:
            raise ValueError(f"repeated index: {value!r}")
        if m[3]:
            many = True
        else:
            out += f'["{m[1]}"]' if m[1] else f"[{m[2]}]"
        before = "field" if m[1] else "index"
        at = m.end()
    if relative and not value:
        raise ValueError("empty path")
    return Path(out, many)


def get(variant: Column, path: str, kind: str = "string", relative: bool = True) -> Column:
    """Value at a path, null if it is missing or of another kind."""
    return F.try_variant_get(variant, compile_path(path, relative).spark, kind)


def records(sources: DataFrame, path: str, json_column: str = "value") -> DataFrame:
    """(source_pointer, record variant, and the source's other columns): the elements of the
    array that a path with a wildcard names, or the one value of another path. Scalars become
    objects with the one field ``value``. A document that does not parse fails the job."""
    p = compile_path(path)
    whole = sources.withColumn("__v", F.parse_json(json_column)).drop(json_column)
    at = F.try_variant_get("__v", p.spark, "variant")
    if not p.many:
        return whole.withColumns({"source_pointer": F.lit("$") if p.spark == "$" else F.lit(p.pointer.rstrip("/")), "record": _boxed(at)}).where(F.col("record").isNotNull()).drop("__v")
    items = F.try_variant_get("__v", p.spark, "array<variant>")
    return whole.select("*", F.posexplode(items).alias("__i", "record")).withColumn("source_pointer", F.concat(F.lit(p.pointer), F.col("__i").cast("string"))).withColumn("record", _boxed(F.col("record"))).drop("__v", "__i")


def _boxed(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), v).otherwise(F.parse_json(F.concat(F.lit('{"value":'), F.to_json(v), F.lit("}"))))


def _holds(v: Column) -> Column:
    """Whether a variant is an object or an array."""
    kind = F.schema_of_variant(v)
    return kind.startswith("OBJECT") | kind.startswith("ARRAY")


def depth(rows: DataFrame, json_column: str = "value") -> int:
    """How deeply containers nest in any of the JSON texts: brackets outside of strings, counted.
    The one number that reaches the driver. A text that begins with its only bracket needs no
    look at its strings."""
    c = F.col(json_column)
    opens = F.char_length(c) - F.char_length(F.translate(c, "[{", ""))
    begins = F.substring(F.ltrim(c, F.lit(" \t\r\n")), 1, 1).isin("[", "{")
    bare = F.regexp_replace(F.regexp_replace(F.col(json_column), r"(?s)\\.", ""), r'"[^"]*"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]+", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda a, c: F.when(c.isin("[", "{"), F.struct((a.now + 1).alias("now"), F.greatest(a.most, a.now + 1).alias("most"))).when(c.isin("]", "}"), F.struct((a.now - 1).alias("now"), a.most.alias("most"))).otherwise(a)
    deep = F.when(opens == 0, 0).when((opens == 1) & begins, 1).otherwise(F.aggregate(marks, start, step, lambda a: a.most))
    return rows.agg(F.max(deep)).first()[0] or 0


def _observed(rows: DataFrame, json_column: str) -> DataFrame:
    """One row per observed element: (path, container, child_of, seen, nested, items, is_null,
    canon). ``seen`` marks the first row of each observation.

    Containers are opened level by level, each level one generator over variants in the same
    stage, as many as the deepest text needs; what is a leaf already passes through. An array
    that holds containers also gives a row of its own, which travels with its first element.
    Null texts give nothing; a text that does not parse fails the job, and so does an object
    with a name twice. Numbers that are equal count as one value."""
    own = "array<struct<path:string,child_of:string,items:int>>"
    level = rows.where(F.col(json_column).isNotNull()).select(
        F.lit("").alias("path"), F.lit("scalar").alias("container"), F.lit(None).cast("string").alias("child_of"), F.lit(True).alias("first"), F.array().cast(own).alias("own"), F.parse_json(json_column).alias("v"),
    )
    spark = rows.sparkSession
    for _ in range(depth(rows, json_column)):
        items = F.try_variant_get("v", "$", "array<variant>")
        nests = F.exists(items, _holds)
        at = level.select("*", items.isNotNull().alias("is_array"), F.coalesce(nests, F.lit(False)).alias("nests"), F.coalesce(F.size(items), F.lit(0)).alias("n"))
        opened = at.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()))
        inside = F.col("pos").isNotNull()
        below = F.when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key"))
        mark = F.array(F.struct("path", "child_of", F.col("n").alias("items")).cast("struct<path:string,child_of:string,items:int>"))
        level = opened.select(
            F.when(inside & ~F.col("is_array"), below).otherwise(F.col("path")).alias("path"),
            F.when(~inside, F.col("container")).when(F.col("is_array") & ~F.col("nests"), "array").otherwise("scalar").alias("container"),
            F.when(inside & F.col("nests"), F.substring_index("path", ".", -1)).otherwise(F.col("child_of")).alias("child_of"),
            F.when(inside, ~(F.col("is_array") & ~F.col("nests")) | (F.col("pos") == 0)).otherwise(F.col("first")).alias("first"),
            F.when(F.coalesce("pos", F.lit(0)) > 0, F.array().cast(own)).when(inside & F.col("nests"), F.concat("own", mark)).otherwise(F.col("own")).alias("own"),
            F.coalesce("value", "v").alias("v"),
        )
    level = level.select("*", F.schema_of_variant("v").alias("kind"), F.try_variant_get("v", "$", "string").alias("text"))
    kind, text = F.col("kind"), F.col("text")
    empty = F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
    is_text, none = kind == "STRING", lambda t: F.lit(None).cast(t)
    word = F.when(kind == "BOOLEAN", F.concat(F.lit("bool:"), text)).when(is_text, F.concat(F.lit("str:"), text)).otherwise(F.concat(F.lit("num:"), text))
    full = F.when(empty.isNull() & (kind != "VOID"), word)
    leaf = F.struct(
        F.col("path").alias("path"), F.coalesce(empty, F.col("container")).alias("container"), F.col("child_of").alias("child_of"), F.col("first").cast("int").alias("seen"), F.lit(0).alias("nested"),
        F.when(empty.isNotNull(), 0).otherwise(((F.col("container") == "array") | (kind != "VOID")).cast("int")).alias("items"), F.when(empty.isNull(), (kind == "VOID").cast("int")).alias("is_null"),
        full.alias("canon"),
    )
    whole = F.transform("own", lambda o: F.struct(
        o.path.alias("path"), F.lit("array").alias("container"), o.child_of.alias("child_of"), F.lit(1).alias("seen"), F.lit(1).alias("nested"), o["items"].alias("items"), none("int").alias("is_null"),
        none("string").alias("canon"),
    ))
    return level.select(F.inline(F.concat(whole, F.array(leaf))))


def _with_texts(observed: DataFrame) -> DataFrame:
    """Adds what follows from ``canon``: (text, length, is_date), the last two of texts only."""
    canon = F.col("canon")
    text = F.when(canon.startswith("bool:"), F.substr(canon, F.lit(6))).otherwise(F.substr(canon, F.lit(5)))
    is_text = canon.startswith("str:")
    return observed.withColumn("text", text).withColumns({"length": F.when(is_text, F.char_length("text")), "is_date": F.when(is_text, V.is_iso_datetime(F.col("text")).cast("int"))})


def leaves(rows: DataFrame, json_column: str = "value") -> DataFrame:
    """``_observed`` with (length, is_date, example) of each element."""
    empty = F.col("is_null").isNull() & (F.col("nested") == 0)
    blank = F.col("length").isNotNull() & (T.strip(F.col("text")) == "")
    example = F.when(empty, F.concat(F.lit("<empty-"), "container", F.lit(">"))).when(~blank, F.substring("text", 1, 200))
    return _with_texts(_observed(rows, json_column)).withColumn("example", example).drop("text")


def profile(rows: DataFrame, json_column: str = "value") -> DataFrame:
    """Statistics per path over all rows (JSON texts): container, types, observed, nulls,
    elements, exact distinct values, text lengths, rate of date-times, child arrays and up to
    five examples (the least texts, so the result is the same for any partitioning)."""
    # Equal values of a path are counted first, so that each is looked into once.
    each = _observed(rows, json_column).groupBy("path", "container", "child_of", "canon").agg(
        F.sum("seen").alias("seen"), F.sum("nested").alias("nested"), F.sum("items").alias("items"), F.sum("is_null").alias("is_null"), F.count("*").alias("n"),
    )
    texts = F.when(F.col("is_date").isNotNull(), F.col("n"))
    p = _with_texts(each).groupBy("path").agg(
        F.min_by("container", F.when(F.col("container") == "scalar", 0).when(F.col("container") == "array", 1).otherwise(2)).alias("container"),
        F.array_join(F.sort_array(F.collect_set("container")), ",").alias("types"), F.max("child_of").alias("child_of"),
        F.sum("seen").alias("observed"), F.coalesce(F.sum("is_null"), F.lit(0)).alias("nulls"), F.sum("items").alias("elements"),
        F.count_distinct("canon").alias("distinct_values"), F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.coalesce(F.sum(F.col("length") * F.col("n")), F.lit(0)).alias("length_sum"),
        F.coalesce(F.try_divide(F.sum(F.col("is_date") * F.col("n")), F.sum(texts)), F.lit(0.0)).alias("datetime_rate"), F.coalesce(F.sum(texts), F.lit(0)).alias("texts"), F.sum("nested").alias("child_arrays"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return p.withColumns({"null_rate": ratio("nulls", "observed"), "avg_length": ratio("length_sum", "elements"), "uniqueness": ratio("distinct_values", "elements")})


def fingerprint(profiled: DataFrame) -> DataFrame:
    """One row: a hash of paths, containers and types; no values enter it."""
    return profiled.agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("path", "container", "types")))), 256).alias("fingerprint"))


def compatibility(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: identical, compatible (paths were only added) or breaking, and the differences."""
    shape = lambda d, n: d.select("path", F.struct("container", "types").alias(n))
    j = shape(old, "o").join(shape(new, "n"), "path", "full_outer")
    kind = F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull(), "added").when(F.col("o") != F.col("n"), "changed")
    d = j.withColumn("kind", kind).where("kind is not null")
    out = d.agg(F.count_if(F.col("kind") != "added").alias("b"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.concat_ws(":", "kind", "path"))).alias("differences"))
    return out.select(F.when(F.col("n") == 0, "identical").when(F.col("b") > 0, "breaking").otherwise("compatible").alias("kind"), "differences")


#: Name patterns of the role rules, and words that mark a title.
ID_NAME = r"(?i)(^|[-_.])(id|uuid|guid|key|编号|标识)([-_.]|$)"
TITLE_WORDS = ("title", "subject", "主题", "标题")
RESOURCE_NAME = r"(?i)(^|[-_.])(url|uri|href|link|avatar|image|img|photo|icon|logo|background|thumbnail)([-_.]|$)"
CONTENT_PATH = r"(?i)(^|\.)(question|answer|article|post|message)\.(text|body|content)$"


def suggest_roles(profiled: DataFrame) -> DataFrame:
    """(path, name, role, rule, position): the first rule that fits each path of a profile;
    questions come before answers, then all by path."""
    name = F.regexp_replace(F.substring_index("path", ".", -1), r"\[.*", "")
    low = F.lower(name)
    titled = F.lit(False)
    for w in TITLE_WORDS:
        titled = titled | F.contains(low, F.lit(w))
    titled = titled | ((low == "name") & ~F.contains(F.col("path"), F.lit(".")))
    scalar = F.col("container") == "scalar"
    rules = [
        ("id", "unique_identifier", (F.col("elements") >= 2) & (F.col("uniqueness") >= 0.95) & (name.rlike(ID_NAME) | low.isin("id", "_id", "uid", "uuid"))),
        ("display", "resource_reference", name.rlike(RESOURCE_NAME)),
        ("timestamp", "datetime_parse_rate", (F.col("texts") > 0) & (F.col("datetime_rate") >= 0.8)),
        ("title", "short_title", scalar & (F.col("avg_length") <= 256) & titled),
        ("content", "semantic_content_path", scalar & F.col("path").rlike(CONTENT_PATH)),
        ("content", "long_text", (F.col("elements") > 0) & (F.col("avg_length") >= 64)),
        ("keyword", "short_repeated", F.col("avg_length") <= 32),
    ]
    role = rule = None
    for r, i, test in rules:
        role = F.when(test, r) if role is None else role.when(test, r)
        rule = F.when(test, i) if rule is None else rule.when(test, i)
    first = F.when(F.lower("path") == "question.text", 0).when(F.lower("path") == "answer.text", 1).otherwise(2)
    roots = profiled.where("child_of is null and child_arrays = 0 and observed > 0")
    return roots.select("path", name.alias("name"), role.otherwise("display").alias("role"), rule.otherwise("display").alias("rule"), F.concat(first.cast("string"), F.lower("path")).alias("position"))


@dataclass(frozen=True)
class Field:
    path: str
    role: str
    name: str | None = None
    transforms: tuple[str, ...] = ()
    conditions: tuple[tuple[str, object], ...] = ()

    @property
    def output(self) -> str:
        return self.name or re.sub(r"\[.*", "", self.path.rsplit(".", 1)[-1])


@dataclass(frozen=True)
class Mapping:
    """A record type: its fields, its child arrays and the relation among children."""

    name: str
    record_path: str
    fields: tuple[Field, ...]
    children: tuple[Mapping, ...] = ()
    relation: tuple[str, str] | None = None  # source field, target field of an earlier sibling
    chunk_policy: str = "semantic"
    extra: dict = field(default_factory=dict)

    def validate(self) -> None:
        """Paths must compile; a root record type (path from ``$``) needs content or a title."""
        root = self.record_path.startswith("$")
        compile_path(self.record_path, relative=not root)
        for f in self.fields:
            compile_path(f.path, relative=True)
        if root and self.chunk_policy != "ignore" and not any(f.role in ("content", "title") for f in self.fields):
            raise ValueError("a root record type needs a content or a title field")


#: Transforms of one text. ``join``, ``deduplicate``, ``to_string`` and ``remove_child_echo`` also
#: know lists or other records, see ``_Value``.
TRANSFORMS = {
    "trim": T.strip, "normalize_whitespace": T.one_spaced, "normalize_newlines": T.unix_lines, "strip_html": T.without_tags, "deduplicate": T.distinct_lines,
    "to_number": lambda c: V.to_number(c).cast("string"), "to_boolean": lambda c: V.to_boolean(c).cast("string"), "parse_datetime": parsed_datetime,
}
#: Transforms whose failure rejects the record.
STRICT = {"to_number", "to_boolean", "parse_datetime"}


class _Value:
    """A field's value as columns: the ``text`` of a scalar, or the ``items`` of a list (as
    texts; elements that are containers as JSON)."""

    def __init__(self, record: Column, f: Field, echoes: Column | None):
        at = compile_path(f.path, relative=True).spark
        self.raw = F.try_variant_get(record, at, "variant")
        self.kind = F.coalesce(F.schema_of_variant(self.raw), F.lit("VOID"))
        listed = self.kind.startswith("ARRAY")
        self.box = self.kind.startswith("OBJECT")
        self.nested = self.box | self.kind.rlike("^ARRAY<(OBJECT|ARRAY|VARIANT)")
        self.text = F.when(~listed & ~self.box, F.try_variant_get(record, at, "string"))
        self.items = F.when(listed, F.try_variant_get(record, at, "array<string>"))
        self.field, self.echoes, self.issues = f, echoes, []
        self.known = True

    def issue(self, test: Column, kind: str, code: str) -> None:
        self.issues.append(F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code"), F.lit(self.field.path).alias("field"))))

    def transform(self, name: str) -> None:
        if name == "join":
            self.text, self.items = F.when(self.items.isNotNull(), V.joined(self.items)).otherwise(self.text), F.lit(None).cast("array<string>")
        elif name == "to_string":
            word = F.when(self.kind == "BOOLEAN", F.initcap(self.text)).otherwise(self.text)
            self.text = F.coalesce(word, F.to_json(self.items), F.when(self.box, F.to_json(self.raw)), F.lit("None"))
            self.items = F.lit(None).cast("array<string>")
        elif name == "remove_child_echo":
            self.text = self.text if self.echoes is None else T.without_lines(self.text, self.echoes)
        elif name in TRANSFORMS:
            then = TRANSFORMS[name](self.text)
            if name in STRICT:
                self.issue((self.text.isNotNull() & then.isNull()) | self.items.isNotNull(), "record_error", "TRANSFORM_FAILED")
            self.text = then
            if name == "deduplicate":
                self.items = F.array_distinct(self.items)
        else:
            self.known = False
            self.issue(F.lit(True), "warning", "UNKNOWN_TRANSFORM")

    def condition(self, kind: str, arg: object) -> None:
        blank = F.coalesce(T.strip(self.text) == "", F.coalesce(F.size(self.items), F.lit(0)) < 1)
        if kind == "required":
            return self.issue(blank & ~self.box, "record_error", "FIELD_REQUIRED")
        test, code = {
            "min_length": (lambda: (F.char_length(self.text) < arg, "FIELD_TOO_SHORT")), "max_length": (lambda: (F.char_length(self.text) > arg, "FIELD_TOO_LONG")),
            "not_empty": (lambda: (blank & ~self.box, "FIELD_EMPTY")), "skip_if_only_emoji": (lambda: (T.only_emoji(self.text), None)), "skip_if_matches": (lambda: (self.text.rlike(str(arg)), None)),
        }[kind]()
        if code:
            self.issue(test, "warning", code)
        keep = ~F.coalesce(test, F.lit(False))
        self.text, self.items = F.when(keep, self.text), F.when(keep, self.items)


def _field(record: Column, f: Field, echoes: Column | None) -> _Value:
    value = _Value(record, f, echoes)
    for t in f.transforms:
        value.transform(t)
        if not value.known:
            value.text, value.items = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
            return value
    for kind, arg in f.conditions:
        value.condition(kind, arg)
    return value


def map_records(rows: DataFrame, mapping: Mapping, source_hash: str = "", echoes: str | None = None) -> DataFrame:
    """Mapped records of ``rows`` (source_pointer, record variant): record_id, record_type,
    title, content, keywords, filters, timestamps, display, issues, rejected. Everything is one
    projection built from the mapping. Lists give several keywords; filters and display hold
    them, and display other containers too, as JSON, while containers as filters are dropped with a
    warning. A missing id becomes a hash of source, pointer and type; a timestamp that does
    not parse moves to display with a warning. ``echoes`` names a column with the texts of a
    record's children, for ``remove_child_echo``."""
    mapping.validate()
    record, values, issues = F.col("record"), {}, []
    for f in mapping.fields:
        if f.role != "ignore":
            values[f] = _field(record, f, F.col(echoes) if echoes else None)
    of = lambda role: [(f, v) for f, v in values.items() if f.role == role]
    pairs = lambda items: F.map_filter(F.map_from_arrays(F.array(*(F.lit(f.output) for f, _ in items)), F.array(*(v for _, v in items))), lambda k, v: v.isNotNull()) if items else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    for _, v in of("filter"):
        v.issue(v.nested, "warning", "FILTER_TYPE_MISMATCH")
    plain = lambda v: F.coalesce(v.text, F.to_json(v.items))
    filters = [(f, F.when(~v.nested, plain(v))) for f, v in of("filter")]
    times = [(f, v.text, parsed_datetime(v.text)) for f, v in of("timestamp")]
    shown = [(f, F.coalesce(plain(v), F.when(v.box, F.to_json(v.raw)))) for f, v in of("display")] + [(f, F.when(p.isNull(), t)) for f, t, p in times]
    for v in values.values():
        issues += v.issues
    warn = lambda f: F.struct(F.lit("warning").alias("kind"), F.lit("TIMESTAMP_UNPARSED").alias("code"), F.lit(f.path).alias("field"))
    issues += [F.when(t.isNotNull() & p.isNull(), warn(f)) for f, t, p in times]
    first = lambda role: F.coalesce(*(v.text for _, v in of(role)), F.lit(None)) if of(role) else F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    words = F.concat(none, *(F.coalesce(v.items, F.array(v.text)) for _, v in of("keyword")))
    content = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(T.strip(v.text) != "", v.text) for _, v in of("content"))))
    all_issues = F.array_compact(F.array(*issues)) if issues else F.array().cast("array<struct<kind:string,code:string,field:string>>")
    ident = F.coalesce(F.nullif(T.strip(first("id")), F.lit("")), V.fallback_record_id(F.lit(source_hash), F.col("source_pointer"), F.lit(mapping.name)))
    out = rows.select(
        "*", ident.alias("record_id"), F.lit(mapping.name).alias("record_type"), first("title").alias("title"), F.array_join(content, "\n").alias("content"),
        F.filter(words, lambda w: T.strip(w) != "").alias("keywords"), pairs(filters).alias("filters"),
        pairs([(f, p) for f, _, p in times]).alias("timestamps"), pairs(shown).alias("display"), all_issues.alias("issues"), F.lit(mapping.chunk_policy).alias("chunk_policy"),
    )
    return out.withColumn("rejected", F.exists("issues", lambda i: i.kind == "record_error"))


def child_rows(parents: DataFrame, child: Mapping) -> DataFrame:
    """The children of mapped parents that were not rejected, as rows to map: record, pointer,
    parent_record_id and child_index. Elements that are no objects are left out but keep
    their place."""
    array = F.try_variant_get("record", compile_path(child.record_path, relative=True).spark, "array<variant>")
    rows = parents.where("not rejected").select(F.col("record_id").alias("parent_record_id"), "source_pointer", F.posexplode(array).alias("child_index", "record"))
    return rows.where(F.schema_of_variant("record").startswith("OBJECT")).withColumn("source_pointer", F.concat_ws("/", "source_pointer", F.lit(child.record_path.split("[", 1)[0]), F.col("child_index").cast("string")))


def related_parents(children: DataFrame, source: str, target: str) -> DataFrame:
    """Adds ``parent_id``: the nearest earlier sibling with a ``target`` value, if that equals
    the child's ``source``; else the record that holds the children."""
    from pyspark.sql import Window

    w = Window.partitionBy("parent_record_id").orderBy("child_index").rowsBetween(Window.unboundedPreceding, -1)
    near = F.last(F.when(F.col(target).isNotNull(), F.struct(F.col(target).alias("t"), F.col("record_id").alias("i"))), ignorenulls=True).over(w)
    c = children.withColumn("__near", near)
    return c.withColumn("parent_id", F.when(F.col("__near.t") == F.col(source), F.col("__near.i")).otherwise(F.col("parent_record_id"))).drop("__near")
