"""Rename templates such as `{date_taken:%Y}/{n:03}_{name}`, parsed once and compiled to Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fotolake.functions.media import sanitized

# Fields of a template, those read from file contents, and date directives with their patterns.
FIELDS = ("name", "ext", "parent", "folder", "size", "date_taken", "date_created", "date_modified", "date_accessed", "camera_make", "camera_model", "lens", "iso", "width", "height")
CONTENT_FIELDS = ("date_taken", "camera_make", "camera_model", "lens", "iso", "width", "height")
DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "j": "DDD", "y": "yy"}
DEFAULT_DATE = "%Y-%m-%d"
_TOKEN = re.compile(r"\{([^}]*)\}", re.DOTALL)


@dataclass(frozen=True)
class Literal:
    text: str


@dataclass(frozen=True)
class Field:
    name: str
    spec: str | None


def parse(template: str) -> list[Literal | Field]:
    """Literals and fields in order. A brace that is never closed is text; the first colon starts the format."""
    out: list[Literal | Field] = []
    at = 0
    for hit in _TOKEN.finditer(template):
        if hit.start() > at:
            out.append(Literal(template[at : hit.start()]))
        name, colon, spec = hit[1].partition(":")
        out.append(Field(name.strip(), spec if colon else None))
        at = hit.end()
    if at < len(template):
        out.append(Literal(template[at:]))
    return out


def fields_used(tokens: list[Literal | Field]) -> list[str]:
    return [t.name for t in tokens if isinstance(t, Field)]


def needs_contents(tokens: list[Literal | Field]) -> bool:
    """Whether rendering needs metadata from inside the files."""
    return any(n in CONTENT_FIELDS for n in fields_used(tokens))


def date_text(value: Column, spec: str | None) -> Column:
    """A timestamp by strftime directives, in the session's zone."""
    parts: list[Column] = []
    text = DEFAULT_DATE if spec is None else spec
    for chunk in re.findall(r"%.|[^%]+|%$", text, re.DOTALL):
        if chunk.startswith("%"):
            d = chunk[1:]
            if d == "%":
                parts.append(F.lit("%"))
            elif d in DIRECTIVES:
                parts.append(F.date_format(value, DIRECTIVES[d]))
            else:
                raise ValueError(f"date directive {chunk!r} is not supported")
        else:
            parts.append(F.lit(chunk))
    return F.concat(*parts) if parts else F.when(value.isNotNull(), "")


def counter_width(spec: str | None) -> int:
    """Pad width of `{n:spec}`: the number after leading zeros, else the length of the spec."""
    if spec is None:
        return 0
    digits = spec.lstrip("0")
    return int(digits) if re.fullmatch(r"\+?[0-9]+", digits) else len(spec.encode())


def field_value(field: Field, have: set[str]) -> Column:
    """Text of a field; null where it is unknown or the row has none."""
    name = "parent" if field.name == "folder" else field.name
    if name not in FIELDS or name not in have:
        return F.lit(None).cast("string")
    c = F.col(name)
    return date_text(c, field.spec) if name.startswith("date_") else c.cast("string")


def render(tokens: list[Literal | Field], columns: list[str], index: str = "n") -> tuple[Column, Column]:
    """(text, error): the rendered text, and why a row has none - its first field without value."""
    parts, error = [], None
    for t in tokens:
        if isinstance(t, Literal):
            parts.append(F.lit(t.text))
        elif t.name == "n":
            digits = F.col(index).cast("string")
            parts.append(F.lpad(digits, F.greatest(F.lit(counter_width(t.spec)), F.length(digits)), F.lit("0")))
        else:
            value = field_value(t, set(columns))
            message = F.lit("no value for {" + t.name + "}")
            error = F.when(value.isNull(), message) if error is None else error.when(value.isNull(), message)
            parts.append(sanitized(value))
    text = F.concat(*parts) if parts else F.lit("")
    return text, error if error is not None else F.lit(None).cast("string")
