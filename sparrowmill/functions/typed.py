"""Actions as structs of their kind, features of records as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparrowmill.functions.actions import value

#: fixed values: fields of each kind of action with their defaults; all kinds, also unknown ones, have those of ANY
ANY = {"action_type": "unknown", "element_index": -1}
KINDS = {
    "tap": {"x": 0, "y": 0},
    "swipe": {"x1": 0, "y1": 0, "x2": 0, "y2": 0, "duration_ms": 300},
    "input_text": {"text": "", "x": 0, "y": 0},
    "press_back": {},
    "press_home": {},
    "long_press": {"x": 0, "y": 0, "duration_ms": 1000},
    "open_app": {"package": "", "app_name": ""},
}


def _field(action: Column, name: str, default: str | int) -> Column:
    return F.coalesce(value(action, f"$.{name}", "string" if isinstance(default, str) else "int"), F.lit(default))


def typed(action: Column, kinds: dict[str, dict] = KINDS) -> Column:
    """An action (variant) as a struct of all kinds' fields: its own kind's hold its values or their defaults, the others are null.

    A key that the kind hasn't got drops out, a null value counts as missing, and a kind that isn't known keeps its name and has the
    common fields alone. Null for what isn't an object or is an empty one.
    """
    common = {name: _field(action, name, default) for name, default in ANY.items()}
    kind = common["action_type"]
    own = {}
    for name in dict.fromkeys(n for fields in kinds.values() for n in fields):
        options = [F.when(kind == k, _field(action, name, fields[name])) for k, fields in kinds.items() if name in fields]
        own[name] = F.coalesce(*options)
    return F.when(F.to_json(action).rlike(r"\A\{.+\}\z"), F.struct(*(c.alias(n) for n, c in (common | own).items())))


def as_json(action: Column) -> Column:
    """A typed action with its own kind's fields alone."""
    return F.to_json(action, {"ignoreNullFields": "true"})


def _text(raw: Column, most: int) -> Column:
    marker = F.concat(F.lit("<"), F.octet_length(raw).cast("string"), F.lit(" bytes omitted>"))
    return F.when(F.octet_length(raw) > most, marker).otherwise(F.make_valid_utf8(raw.cast("string")))


def feature_json(ints: Column, raw: Column, most: int = 64 * 1024) -> Column:
    """A feature's whole numbers or byte strings as JSON, a single one without its list; null if it has neither.

    Bytes are read as UTF-8 with the replacement sign for what isn't; of more than ``most`` bytes only the size is told (the
    limit is part of the definition).
    """
    bare = lambda values: F.when(F.size(values) == 1, F.regexp_extract(F.to_json(values), r"(?s)\A\[(.*)\]\z", 1)).otherwise(F.to_json(values))
    texts = F.transform(raw, lambda x: _text(x, most))
    return F.when(F.size(ints) > 0, bare(ints)).when(F.size(raw) > 0, bare(texts))
