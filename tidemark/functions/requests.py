"""JSON requests checked against a schema of fields: what is wrong, where, and the values of those that are right.

A schema is a tuple of fields; a check is one expression over a parsed variant, so bodies are parsed once and never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let

KINDS = {"string": "string", "integer": "long", "boolean": "boolean", "strings": "array<string>"}


@dataclass(frozen=True)
class Field:
    """``kind`` is string, integer, boolean or strings; ``least`` and ``most`` bound lengths of strings, values of integers and numbers of strings."""

    name: str
    kind: str = "string"
    needed: bool = True
    null: bool = False
    least: int | None = None
    most: int | None = None
    choices: tuple[str, ...] = ()
    pattern: str | None = None
    trimmed: bool = False


# What the requests that create or change rows take.
URL = r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"
SCHEMAS = {
    "site": (Field("name", least=1), Field("primary_origin", needed=False, null=True, pattern=URL), Field("canonical_origins", "strings", needed=False, pattern=URL)),
    "site_name": (Field("name", least=1, most=200, trimmed=True),),
    "robots_override": (Field("canonical_origin", pattern=URL), Field("mode", choices=("ignore", "enforce")), Field("reason", needed=False)),
    "source": (Field("site_id", least=1), Field("type", choices=("page", "rss", "atom", "sitemap", "sitemap-index")), Field("url", least=1)),
    "sitemap_config": (
        Field("sitemap_mode", needed=False, choices=("direct", "traverse")), Field("lastmod_max_age_days", "integer", needed=False, least=1, most=30),
        Field("max_depth", "integer", needed=False, least=1, most=5), Field("child_include_patterns", "strings", needed=False, least=1, most=10),
    ),
    "monitor": (Field("source_id", least=1), Field("interval_seconds", "integer", least=1), Field("next_run_at", needed=False, null=True)),
    "destination": (Field("name", least=1), Field("webhook_url", least=1)),
    "subscription": (
        Field("destination_id", least=1), Field("site_id", needed=False, null=True, least=1), Field("monitor_id", needed=False, null=True, least=1),
        Field("tag", needed=False, null=True), Field("kind", needed=False, null=True, choices=("new", "updated", "removed")),
    ),
}


def _path(name: str) -> str:
    return f"$['{name}']"


def _value(body: Column, f: Field) -> Column:
    v = F.try_variant_get(body, _path(f.name), KINDS[f.kind])
    return F.trim(v) if f.trimmed else v


def _type(body: Column, f: Field) -> Column:
    """The type of a field as the variant tells it; null where the field is missing."""
    return F.schema_of_variant(F.try_variant_get(body, _path(f.name), "variant"))


def issue(body: Column, f: Field) -> Column:
    """What is wrong with a field, as one of missing, type, choice, too small, too big, form; null if nothing."""
    v, t = _value(body, f), _type(body, f)
    typed = {"string": t == "STRING", "integer": t == "BIGINT", "boolean": t == "BOOLEAN", "strings": t.isin("ARRAY<STRING>", "ARRAY<VOID>")}[f.kind]
    size = {"string": F.length, "integer": lambda c: c, "boolean": lambda c: F.lit(0), "strings": F.size}[f.kind](v)
    rules = [(t == "VOID", None if f.null else "type"), (~typed, "type")]
    if f.choices:
        rules.append((~v.isin(*f.choices), "choice"))
    if f.least is not None:
        rules.append((size < f.least, "too small"))
    if f.most is not None:
        rules.append((size > f.most, "too big"))
    if f.pattern:
        rules.append((F.exists(v, lambda x: ~x.rlike(f.pattern)) if f.kind == "strings" else ~v.rlike(f.pattern), "form"))
    found = F.when(t.isNull(), "missing" if f.needed else None)
    for when, what in rules:
        found = found.when(when, F.lit(what).cast("string"))
    return found


def checked(body: Column, content_type: Column, schema: Sequence[Field]) -> Column:
    """error, issues, value of a request.

    ``error`` is invalid_content_type, invalid_json, validation_error or null. A blank body counts as an empty object, whatever its type.
    ``issues`` lists ``field: what`` in the schema's order, ``(root): type`` for JSON that is no object. ``value`` has the fields of a
    request that is right, null where they are missing; keys that the schema does not name are left out. A null body counts as blank.
    """
    text = F.coalesce(body, F.lit(""))
    blank = text.rlike(r"^\s*$")
    typed = F.lower(F.coalesce(content_type, F.lit(""))).contains("application/json")
    parsed = F.try_parse_json(F.when(blank, "{}").otherwise(text))

    def judged(v: Column) -> Column:
        root = F.schema_of_variant(v)
        each = [F.when(issue(v, f).isNotNull(), F.concat(F.lit(f"{f.name}: "), issue(v, f))) for f in schema]
        issues = F.when(root.startswith("OBJECT"), F.array_compact(F.array(*each))).otherwise(F.array(F.lit("(root): type")))
        error = F.when(~blank & ~typed, "invalid_content_type").when(v.isNull(), "invalid_json").when(F.size(issues) > 0, "validation_error")
        fields = F.struct(*[_value(v, f).alias(f.name) for f in schema])
        none = F.array().cast("array<string>")
        return F.struct(error.alias("error"), F.when(error == "validation_error", issues).otherwise(none).alias("issues"), F.when(error.isNull(), fields).alias("value"))

    return let(parsed, judged)

