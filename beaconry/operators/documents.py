"""Contracts of whole JSON documents: a tree of rules compiled to one SQL expression per kind.

A document is parsed once to a variant.  The fields of an object and the type of a value are bound once for all rules
over them; lists and maps are walked with ``transform``, so an element's issue carries its own position.  The expression yields an array of ``(path, rule, message)``
that one ``explode`` turns into rows: one scan, no shuffle, no Python.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.operators.identity import carried_error, identity_uniqueness

_names = itertools.count()


@dataclass(frozen=True)
class Value:
    """A place in a document: an SQL expression of its variant, its JSON pointer as SQL, and the name its fields are bound to."""

    variant: str
    pointer: str = "''"
    fields: str | None = None

    def as_(self, kind: str) -> str:
        return f"try_variant_get({self.variant}, '$', '{kind}')"

    def child(self, name: str) -> Value:
        pointer = f"{self.pointer[:-1]}/{name}'" if self.pointer.endswith("'") else f"concat({self.pointer}, '/{name}')"
        return Value(f"{self.fields}['{name}']", pointer)


ISSUES = "ARRAY<STRUCT<path STRING, rule STRING, message STRING>>"
NONE = f"CAST(NULL AS {ISSUES})"


def let(value: str, body: Callable[[str], str]) -> str:
    """``body``, an array of issues, with a name for a value that is computed once.

    An aggregate over the one value has the type of its start.  ``get``, ``flatten`` and ``transform`` ask all that is below
    them for its type on every row, which in nested rules costs far more than the rules.
    """
    name = f"b{next(_names)}"
    return f"aggregate(array({value}), {NONE}, (a{name}, {name}) -> {body(name)})"


def on_fields(issues: Callable[[Rule, Value], list[str]]) -> Callable[[Rule, Value], list[str]]:
    """Binds the fields of an object once for all rules over them; rules inside find them bound."""
    def bound(rule: Rule, v: Value) -> list[str]:
        if v.fields:
            return issues(rule, v)
        return [let(v.as_("map<string, variant>"), lambda name: together(issues(rule, Value(v.variant, v.pointer, name))))]
    return bound


@dataclass(frozen=True)
class Scalar:
    """Type ``t`` of a value, null where there is none, and what reads it as a text or a number.

    A text is read as a number, or the other way round, nowhere: a failing cast costs more than all other rules.
    """

    t: str
    s: str
    d: str


def on_scalar(v: Value, body: Callable[[Scalar], str]) -> str:
    """``body`` with the value and its type, both computed once."""
    def typed(name: str) -> str:
        at = Value(f"{name}.v")
        return body(Scalar(f"{name}.t", at.as_("string"), at.as_("double")))
    return let(v.variant, lambda value: let(f"named_struct('t', schema_of_variant({value}), 'v', {value})", typed))


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def found(at: Value, rule: str, message: str) -> str:
    return f"array(named_struct('path', {at.pointer}, 'rule', '{rule}', 'message', {_text(message)}))"


def issue(condition: str, at: Value, rule: str, message: str) -> str:
    """An array of one issue where the condition holds, null otherwise."""
    return f"if({condition}, {found(at, rule, message)}, NULL)"


def together(parts: list[str]) -> str:
    return joined(f"array({', '.join(parts)})") if parts else NONE


def joined(lists: str) -> str:
    """One array of the issues in an array of arrays, of which some may be null; see ``let`` for its form."""
    a, x = f"a{next(_names)}", f"x{next(_names)}"
    return f"aggregate({lists}, CAST(array() AS {ISSUES}), ({a}, {x}) -> if({x} IS NULL, {a}, concat({a}, {x})))"


class Rule:
    def issues(self, v: Value) -> list[str]:
        raise NotImplementedError


@dataclass(frozen=True)
class Text(Rule):
    least: int = 0
    most: int | None = None
    pattern: str | None = None
    kind: str | None = None  # a format below

    def issues(self, v):
        def rules(text):
            out = []
            if self.least:
                out.append(issue(f"length({text}) < {self.least}", v, "min_length", f"must have at least {self.least} letters"))
            if self.most is not None:
                out.append(issue(f"length({text}) > {self.most}", v, "max_length", f"must have at most {self.most} letters"))
            if self.pattern:
                out.append(issue(f"NOT rlike({text}, r'{self.pattern}')", v, "pattern", "must match the pattern"))
            if self.kind:
                out.append(issue(f"NOT coalesce({FORMATS[self.kind].format(text)}, false)", v, "format", f"must be a {self.kind}"))
            return together(out)
        return [on_scalar(v, lambda b: f"CASE WHEN {b.t} = 'STRING' THEN {let(b.s, rules)} WHEN {b.t} IS NOT NULL THEN {found(v, 'type', 'must be a text')} END")]


_HOST = "regexp_extract({0}, r'^[Hh][Tt][Tt][Pp][Ss]?://([^/?#:]+)', 1)"
FORMATS = {
    "time": r"""rlike({0}, r'\A\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)\z') AND try_to_timestamp(substr({0}, 1, 19), "yyyy-MM-dd'T'HH:mm:ss") IS NOT NULL""",
    "web address": rf"""length({{0}}) <= 2048 AND rlike({{0}}, r'\A[^\s\\]+\z') AND replace({_HOST}, '.', '') <> ''
        AND rlike({{0}}, r'^[^:/?#]+://(?:\[[^\]@/?#]*\]|[^@:/?#]*)(?::\d{{{{0,5}}}})?(?:[/?#]|\z)')""",
    "repository": r"rlike({0}, r'\A[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+\z')",
}


@dataclass(frozen=True)
class Number(Rule):
    least: float | None = None
    most: float | None = None
    whole: bool = True

    def issues(self, v):
        wrong = found(v, "type", "must be a whole number" if self.whole else "must be a number")

        def rules(number):
            out = []
            if self.whole:
                out.append(f"if({number} <> floor({number}), {wrong}, NULL)")
            if self.least is not None:
                out.append(issue(f"{number} < {self.least}D", v, "minimum", f"must be at least {self.least}"))
            if self.most is not None:
                out.append(issue(f"{number} > {self.most}D", v, "maximum", f"must be at most {self.most}"))
            return together(out)
        return [on_scalar(v, lambda b: f"CASE WHEN {_is_number(b)} THEN {let(b.d, rules)} WHEN {b.t} IS NOT NULL THEN {wrong} END")]


@dataclass(frozen=True)
class Flag(Rule):
    def issues(self, v):
        return [issue(f"schema_of_variant({v.variant}) <> 'BOOLEAN'", v, "type", "must be true or false")]


@dataclass(frozen=True)
class Null(Rule):
    def issues(self, v):
        return [issue(f"NOT is_variant_null({v.variant})", v, "must_be_null", "must be null")]


def _is_number(b: Scalar) -> str:
    return f"({b.t} = 'BIGINT' OR {b.t} = 'DOUBLE' OR startswith({b.t}, 'DECIMAL'))"


def _is_one_of(b: Scalar, values: tuple) -> str:
    texts, numbers = [x for x in values if isinstance(x, str)], [x for x in values if not isinstance(x, str)]
    tests = [f"{b.t} = 'STRING' AND {b.s} IN ({', '.join(map(_text, texts))})"] if texts else []
    tests += [f"{_is_number(b)} AND {b.d} IN ({', '.join(f'{x}D' for x in numbers)})"] if numbers else []
    return "(" + " OR ".join(f"({t})" for t in tests) + ")"


@dataclass(frozen=True)
class OneOf(Rule):
    values: tuple

    def issues(self, v):
        message = "must be one of " + ", ".join(map(str, self.values))
        return [on_scalar(v, lambda b: issue(f"{b.t} IS NOT NULL AND NOT coalesce({_is_one_of(b, self.values)}, false)", v, "enum", message))]


@dataclass(frozen=True)
class OrNull(Rule):
    rule: Rule

    def issues(self, v):
        return [f"if({v.variant} IS NULL OR is_variant_null({v.variant}), NULL, {together(self.rule.issues(v))})"]


@dataclass(frozen=True)
class Not(Rule):
    """No match of a pattern anywhere."""

    pattern: str

    def issues(self, v):
        return [on_scalar(v, lambda b: issue(f"{b.t} = 'STRING' AND rlike({b.s}, r'{self.pattern}')", v, "forbidden_pattern", "must not match the pattern"))]


@dataclass(frozen=True)
class Items(Rule):
    """A list; None as ``each`` leaves its elements alone."""

    each: Rule | None = None
    least: int = 0
    most: int | None = None
    unique: bool = False

    def issues(self, v):
        def rules(rows):
            x, i, out = f"x{next(_names)}", f"i{next(_names)}", []
            if self.least:
                out.append(issue(f"size({rows}) < {self.least}", v, "min_items", f"must have at least {self.least} items"))
            if self.most is not None:
                out.append(issue(f"size({rows}) > {self.most}", v, "max_items", f"must have at most {self.most} items"))
            if self.unique:
                plain = f"transform({rows}, {x} -> to_json({x}))"
                out.append(issue(f"size({rows}) > 1 AND size(array_distinct({plain})) < size({rows})", v, "unique_items", "must not repeat items"))
            if self.each:
                inner = together(self.each.issues(Value(x, f"concat({v.pointer}, '/', {i})")))
                out.append(joined(f"transform({rows}, ({x}, {i}) -> {inner})"))
            wrong = issue(f"{v.variant} IS NOT NULL", v, "type", "must be a list")
            return f"if({rows} IS NULL, {wrong}, {together(out)})" if out else f"if({rows} IS NULL, {wrong}, NULL)"
        return [let(v.as_("array<variant>"), rules)]


@dataclass(frozen=True)
class Keyed(Rule):
    """An object whose keys are data."""

    each: Rule
    key: Rule | None = None
    least: int = 0
    most: int | None = None

    def issues(self, v):
        def rules(rows):
            e, out = f"e{next(_names)}", []
            if self.least:
                out.append(issue(f"size({rows}) < {self.least}", v, "min_properties", f"must have at least {self.least} entries"))
            if self.most is not None:
                out.append(issue(f"size({rows}) > {self.most}", v, "max_properties", f"must have at most {self.most} entries"))
            pointer = f"concat({v.pointer}, '/', replace(replace({e}.key, '~', '~0'), '/', '~1'))"
            parts = self.each.issues(Value(f"{e}.value", pointer))
            if self.key:
                parts += self.key.issues(Value(f"variant_get(to_variant_object(named_struct('k', {e}.key)), '$.k', 'variant')", pointer))
            if parts:
                out.append(joined(f"transform(map_entries({rows}), {e} -> {together(parts)})"))
            wrong = issue(f"{v.variant} IS NOT NULL", v, "type", "must be an object")
            return f"if({rows} IS NULL, {wrong}, {together(out)})"
        return [let(v.as_("map<string, variant>"), rules)]


@dataclass(frozen=True)
class Group(Rule):
    """Fields that are there all together or not at all."""

    fields: tuple

    @on_fields
    def issues(self, v):
        here = [f"map_contains_key({v.fields}, '{f}')" for f in self.fields]
        some = " OR ".join(here)
        return [issue(f"({some}) AND NOT {test}", v, "together", f"{name} must come with the rest of its group") for name, test in zip(self.fields, here)]


@dataclass(frozen=True)
class Needs(Rule):
    fields: tuple

    @on_fields
    def issues(self, v):
        return [issue(f"NOT map_contains_key({v.fields}, '{f}')", v, "required", f"{f} is required") for f in self.fields]


@dataclass(frozen=True)
class Lacks(Rule):
    fields: tuple

    @on_fields
    def issues(self, v):
        return [issue(f"map_contains_key({v.fields}, '{f}')", v, "forbidden", f"{f} is not allowed here") for f in self.fields]


@dataclass(frozen=True)
class When(Rule):
    """A rule that holds where a field has one of some values, or with ``no`` where it is there and has none of them."""

    name: str
    values: tuple
    rule: Rule
    no: bool = False

    @on_fields
    def issues(self, v):
        body = together(self.rule.issues(v))
        return [on_scalar(v.child(self.name), lambda b: f"if({b.t} IS NOT NULL AND {'NOT ' if self.no else ''}coalesce({_is_one_of(b, self.values)}, false), {body}, NULL)")]


@dataclass(frozen=True)
class Fields(Rule):
    """Rules of named fields, without saying which others there are."""

    rules: dict

    @on_fields
    def issues(self, v):
        return [x for name, r in self.rules.items() for x in r.issues(v.child(name))]


@dataclass(frozen=True)
class Keys(Rule):
    """An object, whatever its fields."""

    @on_fields
    def issues(self, v):
        return [issue(f"{v.variant} IS NOT NULL AND {v.fields} IS NULL", v, "type", "must be an object")]


@dataclass(frozen=True)
class All(Rule):
    rules: tuple

    def issues(self, v):
        out = [r.issues for r in self.rules]
        if v.fields or not any(isinstance(r, (Object, When, Needs, Lacks, Group, Fields, Keys)) for r in self.rules):
            return [x for issues in out for x in issues(v)]
        return on_fields(lambda _, w: [x for issues in out for x in issues(w)])(self, v)


@dataclass(frozen=True)
class Object(Rule):
    """A closed object: its fields, those of them that may be missing, and rules over several fields."""

    rules: dict
    optional: tuple = ()
    also: tuple = field(default=())

    @on_fields
    def issues(self, v):
        k, known = f"k{next(_names)}", ", ".join(_text(f) for f in self.rules)
        unknown = f"transform(array_except(map_keys({v.fields}), array({known})), {k} -> named_struct('path', {v.pointer}, 'rule', 'unknown_field', 'message', concat({k}, ' is not a known field')))"
        out = [*Needs(tuple(f for f in self.rules if f not in self.optional)).issues(v), unknown, *Fields(self.rules).issues(v)]
        out += [x for r in self.also for x in r.issues(v)]
        return [f"if({v.fields} IS NULL, {together(Keys().issues(v))}, {together(out)})"]


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that later filters do not pull down and compute anew: they stay above the generator."""
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def checked(documents: DataFrame, contracts: dict[str, Rule]) -> DataFrame:
    """Adds ``document``, the body as a variant, and ``issues``, all rules that it breaks in order, to ``kind, body`` rows.

    A body that is not strict JSON (duplicate keys and non-finite numbers are not) breaks ``unreadable`` alone, a kind
    without a contract ``unknown_kind``.  The root's pointer is ``/``.
    """
    at = Value("document")
    chain = " ".join(f"WHEN kind = {_text(name)} THEN {together(rule.issues(at))}" for name, rule in contracts.items())
    broken = F.expr(f"""CASE WHEN kind IS NULL OR kind NOT IN ({', '.join(map(_text, contracts))}) THEN {together([issue('true', at, 'unknown_kind', 'has no contract')])}
        WHEN document IS NULL THEN {together([issue('true', at, 'unreadable', 'must be strict JSON')])} {chain} END""")
    named = F.transform(broken, lambda i: F.struct(F.when(i["path"] == "", "/").otherwise(i["path"]).alias("path"), i["rule"].alias("rule"), i["message"].alias("message")))
    return once(once(documents, "document", F.try_parse_json("body")), "issues", F.array_sort(F.array_distinct(named)))


def document_issues(documents: DataFrame, contracts: dict[str, Rule]) -> DataFrame:
    """``kind, key, path, rule, message`` of every broken rule of every document."""
    rows = checked(documents.select("kind", F.col("key").cast("string").alias("key"), "body"), contracts).select("kind", "key", F.explode_outer("issues").alias("i")).filter("i IS NOT NULL")
    return rows.select("kind", "key", "i.path", "i.rule", "i.message")


def ingested(drafts: DataFrame, contracts: dict[str, Rule]) -> tuple[DataFrame, DataFrame]:
    """Accepted drafts ``draft, key, target, body`` and rejected ones ``draft, key, reason, path``.

    ``draft`` is project or signal.  A draft must keep its contract; a project draft must also be of version 2, written no
    earlier than the analysis it rests on, and carry the identity of its repository.  The first failing check is the
    reason.  Both outputs read one scan without a shuffle.
    """
    kinds = {"project": "project-enrichment", "signal": "signal-enrichment"}
    kind = F.coalesce(*[F.when(F.col("draft") == name, F.lit(known)) for name, known in kinds.items()])
    rows = checked(drafts.select("draft", F.col("key").cast("string").alias("key"), "body", kind.alias("kind")), {known: contracts[known] for known in kinds.values()})

    def field(name: str, kind: str = "string") -> Column:
        return F.expr(f"try_variant_get(document, '$.{name}', '{kind}')")

    first = F.get("issues", F.lit(0))
    project, written, bound = F.col("draft") == "project", F.try_to_timestamp(field("analyzedAt")), F.try_to_timestamp(field("sourceAnalysisAt"))
    identity = carried_error(field("repository"), field("projectId"), field("projectIdVersion", "int"))
    reason = (F.when(F.size("issues") > 0, first["rule"]).when(project & (field("schemaVersion", "int") != 2), "unsupported_version")
              .when(project & (written < bound), "analyzed_before_source").when(project & identity.isNotNull(), identity))
    path = (F.when(F.size("issues") > 0, first["path"]).when(F.col("reason") == "unsupported_version", "/schemaVersion")
            .when(F.col("reason") == "analyzed_before_source", "/analyzedAt").otherwise("/projectId"))
    rows = once(rows, "reason", reason)
    target = F.when(project, F.concat(F.lit("enrichment/"), field("projectId"), F.lit(".json"))).otherwise("signals/enrichment.json")
    return (rows.filter("reason IS NULL").select("draft", "key", target.alias("target"), "body"),
            rows.filter("reason IS NOT NULL").select("draft", "key", "reason", path.alias("path")))


def _rows_of(documents: DataFrame, name: str, version: int, key: str) -> DataFrame:
    """``key, i, row`` of the objects in a list of all documents of one version."""
    parsed = once(documents.select(F.col(key).cast("string").alias("key"), "body"), "_doc", F.try_parse_json("body"))
    version_of = F.expr("try_variant_get(_doc, '$.schemaVersion', 'int')")
    rows = parsed.filter(version_of == version).select("key", F.posexplode(F.expr(f"try_variant_get(_doc, '$.{name}', 'array<variant>')")).alias("i", "row"))
    return rows.filter(F.expr("try_variant_get(row, '$', 'map<string, variant>')").isNotNull())


def _field(name: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get(row, '$.{name}', '{kind}')")


def catalog_identity_issues(catalogs: DataFrame, key: str = "key") -> DataFrame:
    """``key, path, rule, message``: carried identities of every project, and names or ids that a catalog has twice."""
    rows = _rows_of(catalogs, "projects", 3, key).select("key", "i", _field("repo").alias("repository"), _field("projectId").alias("project_id"), _field("projectIdVersion", "int").alias("version"))
    rows = rows.withColumn("rule", carried_error(F.col("repository"), F.col("project_id"), F.col("version")))
    own = rows.filter("rule IS NOT NULL").select("key", F.format_string("/projects/%d/projectId", "i").alias("path"), "rule", F.coalesce("project_id", F.lit("")).alias("message"))
    twins = (identity_uniqueness(rows.withColumnRenamed("key", "document"), "document")
             .select(F.col("document").alias("key"), F.lit("/projects").alias("path"), F.col("code").alias("rule"), F.col("key").alias("message")))
    return own.unionByName(twins)


def queue_identity_issues(queues: DataFrame, key: str = "key") -> DataFrame:
    """``key, path, rule, message``: carried identities of every project item, then id, paths and fields that disagree with them."""
    texts = "array<string>"
    rows = _rows_of(queues, "items", 2, key).filter(_field("kind") == "project").select(
        "key", "i", _field("repository").alias("repository"), _field("projectId").alias("project_id"), _field("projectIdVersion", "int").alias("version"), _field("id").alias("id"),
        _field("outputPath").alias("output"), F.coalesce(_field("inputPaths", texts), F.array().cast(texts)).alias("paths"), _field("evidenceState").alias("state"),
        F.coalesce(_field("requiredFields", texts), F.array().cast(texts)).alias("fields"))
    rows = rows.withColumn("rule", carried_error(F.col("repository"), F.col("project_id"), F.col("version")))
    rows = rows.withColumn("catalogs", F.filter("paths", lambda p: p.endswith("/catalog/latest.json")))
    folder = F.regexp_extract(F.get("catalogs", F.lit(0)), r"\A(data(?:/generations/[A-Za-z0-9](?:[A-Za-z0-9._-]{0,126}[A-Za-z0-9])?)?)/catalog/latest\.json\z", 1)
    inspected = F.when(F.col("state") == "ready", F.array(F.concat(folder, F.lit("/analysis/"), "project_id", F.lit(".json")))).otherwise(F.array().cast(texts))
    expected = F.when((F.size("catalogs") == 1) & (folder != ""), F.concat(inspected, "catalogs"))
    wrong = F.array_compact(F.array(
        F.when(~F.col("id").eqNullSafe(F.concat(F.lit("project:"), "project_id")), F.lit("id")),
        F.when(~F.col("output").eqNullSafe(F.concat(F.lit("data/enrichment/"), "project_id", F.lit(".json"))), F.lit("outputPath")),
        F.when(~F.coalesce(F.col("paths") == expected, F.lit(False)), F.lit("inputPaths")),
        F.when(~(F.array_contains("fields", "projectIdVersion") & F.array_contains("fields", "projectId")), F.lit("requiredFields"))))
    rows = rows.withColumn("wrong", wrong).filter((F.col("rule").isNotNull()) | (F.size("wrong") > 0))
    bad = F.col("rule").isNotNull()
    return rows.select("key", F.when(bad, F.format_string("/items/%d/projectId", "i")).otherwise(F.format_string("/items/%d", "i")).alias("path"),
                       F.coalesce("rule", F.lit("queue_project")).alias("rule"),
                       F.when(bad, F.coalesce("project_id", F.lit(""))).otherwise(F.concat(F.lit("disagrees with "), F.array_join("wrong", ", "))).alias("message"))
