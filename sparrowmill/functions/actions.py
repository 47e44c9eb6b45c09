"""Actions, coordinates, names and elements as Column expressions over texts and parsed JSON (variant)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: window labels that are no pages, and class prefixes that can't be navigated to
NON_PAGES = ("SoftInputWindow",)
NOT_NAVIGABLE = ("androidx.car.app.", "com.android.billingclient.", "com.google.android.gms.", "com.google.android.play.core.")
FLAT = r"(\{[^{}]*\})"
FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null, not empty, without a match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def tagged(text: Column, tag: str) -> Column:
    """The trimmed body of the first <tag>..</tag>, null if there is none."""
    return F.regexp_replace(found(text, f"(?s)<{tag}>(.*?)</{tag}>"), r"^\s+|\s+$", "")


def parsed(text: Column) -> Column:
    """The whole text as JSON, else a fenced block, else the first flat object; null if none of them parses."""
    return F.coalesce(*(F.try_parse_json(x) for x in (F.trim(text), found(text, FENCED), found(text, FLAT))))


def payload(text: Column) -> Column:
    """What stands in <action> tags, else the whole text; text that isn't JSON raises."""
    return F.parse_json(F.coalesce(F.nullif(tagged(text, "action"), F.lit("")), text))


def last_action(text: Column) -> Column:
    """The tagged action, else the first flat object after the last 'Action'."""
    return F.coalesce(F.try_parse_json(tagged(text, "action")), F.try_parse_json(found(text, r"(?s)^.*Action[^{]*" + FLAT)))


def value(action: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(action, path, kind)


def param(action: Column, key: str) -> Column:
    """A top-level key, else the key below ``params``."""
    return F.coalesce(value(action, f"$.{key}", "string"), value(action, f"$.params.{key}", "string"))


def action_type(action: Column, keys: tuple[str, ...] = ("action", "action_type", "type")) -> Column:
    """The first of the keys whose text isn't blank."""
    return F.coalesce(*(F.nullif(F.trim(value(action, f"$.{k}", "string")), F.lit("")) for k in keys))


def aliased(kind: Column) -> Column:
    return F.when(kind == "open", "open_app").otherwise(kind)


def point(action: Column, key: str) -> Column:
    """A pair of numbers, null unless both are there."""
    x, y = (value(action, f"$.{key}[{k}]", "double") for k in (0, 1))
    return F.when(x.isNotNull() & y.isNotNull(), F.array(x, y))


def points(action: Column) -> Column:
    return F.filter(F.array(*(point(action, k) for k in ("coordinate", "coordinate1", "coordinate2"))), lambda p: p.isNotNull())


def by_role(messages: Column, role: str) -> Column:
    """The text of the first message (role, text) of a role, empty if there is none."""
    return F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == role), 0)["text"], F.lit(""))


def between(text: Column, start: str, end: str) -> Column:
    """What stands between two marks, trimmed; null if either is missing."""
    return F.trim(found(text, rf"(?s)\Q{start}\E(.*?)\Q{end}\E"))


def episode_of(name: Column) -> Column:
    """The number after 'episode_' without leading zeros."""
    return found(name, "episode_0*([0-9]+)").cast("bigint")


def step_key(name: Column) -> Column:
    return F.struct(episode_of(name).alias("episode"), found(name, "step_0*([0-9]+)").cast("int").alias("step"))


def padded_episode(name: Column) -> Column:
    """The image name with an episode of six digits at least."""
    number = found(name, "episode_([0-9]+)")
    return F.when(F.length(number) >= 6, name).otherwise(F.regexp_replace(name, F.lit("episode_[0-9]+"), F.concat(F.lit("episode_"), F.lpad(number, 6, "0"))))


def qualified(activity: Column) -> Column:
    """'pkg/.Cls' as 'pkg/pkg.Cls'."""
    package, rest = F.substring_index(activity, "/", 1), F.regexp_replace(activity, "^[^/]*/", "")
    return F.when(~activity.contains("/"), activity).otherwise(F.concat(package, F.lit("/"), F.when(rest.startswith("."), F.concat(package, rest)).otherwise(rest)))


def page_activity(activity: Column) -> Column:
    """Trimmed; empty for null and for windows that are no pages."""
    text = F.trim(F.coalesce(activity, F.lit("")))
    return F.when(text.rlike("|".join(NON_PAGES)), "").otherwise(text)


def navigable(component: Column) -> Column:
    """By the class after the slash; a name without one is navigable."""
    name = F.coalesce(found(component, "^[^/]*/(.*)$"), F.lit(""))
    return ~F.array_contains(F.array(*(name.startswith(p) for p in NOT_NAVIGABLE)), True)


def ratios(spec: Column) -> Column:
    """'7:3,3:7' as pairs; null if any part isn't a pair of positive numbers."""
    pairs = F.transform(F.split(spec, ","), lambda p: F.transform(F.split(F.trim(p), ":"), lambda n: n.try_cast("int")))
    good = F.forall(pairs, lambda p: (F.size(p) == 2) & F.forall(p, lambda n: F.coalesce(n > 0, F.lit(False))))
    return F.when(good, pairs)


def setting_order(model: Column, path: Column) -> Column:
    """Sort key: base first, then variants, each by its trailing number."""
    head, tail = F.substring_index(path, "/", 1), F.regexp_replace(path, "^[^/]*/?", "")
    number = found(F.when(tail == "", head).otherwise(tail), r"([0-9]+(?:\.[0-9]+)?)\s*$").cast("double")
    return F.struct(model.alias("model"), (head != "base").cast("int").alias("variant"), head.alias("head"), F.coalesce(number, F.lit(-1.0)).alias("epoch"), path.alias("path"))


def centre(box: Column) -> Column:
    return F.struct(((box["l"] + box["r"]) / 2.0).alias("x"), ((box["t"] + box["b"]) / 2.0).alias("y"))


def distance(a: Column, b: Column) -> Column:
    """Between the centres of two boxes; null if either is missing."""
    p, q = centre(a), centre(b)
    return F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Of two arrays as sets; ``empty`` if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def n_different(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def slot(bounds: Column, index: Column) -> Column:
    """'b:' and the bounds, else 'i:' and the index, else empty."""
    filled = lambda mark, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(mark), c))
    return F.coalesce(filled("b:", bounds), filled("i:", index), F.lit(""))


def keycap(label: Column, text: Column) -> Column:
    """Whether the label, or else the text, is one to four signs that a keyboard's key shows."""
    shown = F.coalesce(F.nullif(F.trim(label), F.lit("")), F.trim(text), F.lit(""))
    return shown.rlike("^[A-Za-z0-9+*#]{1,4}$")


def digest(activity: Column, content: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(activity, F.lit("")), F.coalesce(content, F.lit(""))))


def multimodal_length(wrapper: Column, text: Column, images: Column, vision: Column) -> Column:
    """Wrapper and text tokens, and for each image its own tokens with one before and one after."""
    return wrapper + text + images * (vision + 2)


def token_weight(change: Column, derivable: Column, added: float = 1.0, modified: float = 1.0, unchanged: float = 0.25, attenuation: float = 0.5) -> Column:
    """Weight of a change; only what is added or modified is attenuated where it can't be derived."""
    changed = F.when(change == "ADDED", added).when(change == "MODIFIED", modified)
    return F.coalesce(changed * F.when(derivable == "NON_DERIVABLE", attenuation).otherwise(1.0), F.lit(unchanged))
