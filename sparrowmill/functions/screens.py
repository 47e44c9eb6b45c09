"""Raw screen dumps made into compact markup, with what is read from either as column expressions."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

#: fixed values: classes shown as buttons and as plain containers
BUTTONS = frozenset("FloatingActionButton ImageButton MaterialButton ExtendedFloatingActionButton Chip".split())
CONTAINERS = frozenset(
    """FrameLayout LinearLayout RelativeLayout ViewGroup ConstraintLayout unknown LinearLayoutCompat GridLayout GridView RadioGroup TableLayout TableRow CoordinatorLayout
    CardView AppBarLayout CollapsingToolbarLayout Toolbar NavigationView DrawerLayout ViewFlipper ViewSwitcher BottomNavigationView TabLayout ChipGroup RecyclerView ListView
    ScrollView HorizontalScrollView ViewPager ViewPager2 NestedScrollView node View""".split()
)
#: fixed values: names after clean-up, attributes that stay by name, attributes of a line in their order
NAMES = {"TextField": "p", "Scroll": "div", "Image": "img", "Button": "button", "Checker": "input"}
STAY = {"button": ("aria-label",), "p": ("aria-label",), "div": ("data-scroll", "aria-label"), "img": ("alt",), "input": ("type", "value", "checked", "aria-label", "role")}
LINE = ("aria-label", "alt", "type", "value", "checked", "role", "data-scroll")
#: fixed values: editable classes, ids of overlays that come and go, and how many children of a scroller count for its shape
EDITABLE = ("EditText", "AutoCompleteTextView", "MultiAutoCompleteTextView", "ExtractEditText", "SearchAutoComplete")
OVERLAYS = ("snackbar", "toast", "tooltip")
SCROLLED = 3
NO_BOUNDS = "[0,0][0,0]"


@dataclass(slots=True)
class Element:
    tag: str
    attributes: dict[str, str]
    text: str = ""
    children: list[Element] = field(default_factory=list)
    tidy: Element | None = None

    def walk(self) -> Iterator[tuple[Element, int]]:
        """Elements in document order with their depths; children that go while their parent is visited are passed over."""
        waiting = [(self, 0)]
        while waiting:
            element, depth = waiting.pop()
            yield element, depth
            waiting.extend((c, depth + 1) for c in reversed(element.children))


def parsed(xml: str | None, start, end, ordered: bool = False) -> bool:
    """Whether a text is strict XML; its elements are handed to ``start`` and ``end`` as they come, with attributes as a dict or (``ordered``) as a list."""
    reader = expat.ParserCreate()
    reader.ordered_attributes = ordered
    reader.StartElementHandler, reader.EndElementHandler = start, end
    try:
        reader.Parse((xml or "").encode("utf-8", "replace"), True)
    except expat.ExpatError:
        return False
    return True


def read(xml: str | None) -> Element | None:
    """The tree of strict XML without its texts, None for anything else."""
    top = Element("", {})
    inside = [top]

    def start(tag, attributes):
        inside[-1].children.append(Element(tag, attributes))
        inside.append(inside[-1].children[-1])

    return top.children[0] if parsed(xml, start, lambda tag: inside.pop()) else None


#: what an element of a dump keeps, in this order: name, source, the value that doesn't stay
KEPT = (
    ("text", "text", ""),
    ("description", "content-desc", ""),
    ("important", "important", ""),
    ("class", "class", ""),
    *((flag, flag, "false") for flag in ("checkable", "clickable", "scrollable", "long-clickable")),
    *((place, place, None) for place in ("bounds", "index")),
    ("id", "resource-id", ""),
)
#: kinds from the strongest to the weakest claim: kind, condition on class name, kept attributes and being a leaf
KINDS = (
    ("input", lambda name, kept, leaf: name == "EditText"),
    ("Checker", lambda name, kept, leaf: kept.get("checkable") == "true"),
    ("Button", lambda name, kept, leaf: kept.get("clickable") == "true" or name in BUTTONS),
    ("Scroll", lambda name, kept, leaf: kept.get("scrollable") == "true"),
    ("div", lambda name, kept, leaf: name in CONTAINERS),
    ("Image", lambda name, kept, leaf: name == "ImageView"),
    ("TextField", lambda name, kept, leaf: name == "TextView" or (leaf and "text" in kept)),
    ("div", lambda name, kept, leaf: True),
)
#: flags that a kind itself says, and what it takes from the dump instead: (name, value if missing)
SAID = {"Checker": ("checkable", ("checked", "false")), "Button": ("clickable", None)}


def last_part(name: str, sign: str) -> str:
    return name.rsplit(sign, 1)[-1]


def named(attributes: dict[str, str], leaf: bool) -> Element:
    """An element of a dump, without children, under the name of its kind."""
    kept = {name: value for name, source, gone in KEPT if (value := attributes.get(source)) is not None and value != gone}
    if "id" in kept:
        kept["id"] = last_part(kept["id"], "/")
    name = last_part(attributes.get("class") or "node", ".")
    for kind, fits in KINDS:  # noqa: B007
        if fits(name, kept, leaf):
            break
    out = Element(kind, kept)
    if kind in SAID:
        flag, instead = SAID[kind]
        kept.pop(flag, None)
        if instead:
            kept[instead[0]] = attributes.get(*instead)
    if leaf and kind in ("input", "TextField"):
        out.text = kept.pop("text", "")
    return out


#: how many elements that dumps repeat are held at once, and the characters of one
KNOWN, LONG = 4_096, 1_000
_known: dict[tuple, Element] = {}


def _made(attributes: list[str], leaf: bool) -> Element:
    """What ``named`` and ``_tidy`` make of an element, which is the same for equal attributes; not to be changed."""
    key = (leaf, *attributes)
    found = _known.get(key)
    if found is None:
        found = named(dict(zip(attributes[::2], attributes[1::2], strict=True)), leaf)
        found.tidy = Element(found.tag, dict(found.attributes), found.text)
        _tidy(found.tidy)
        if sum(map(len, attributes)) <= LONG:
            if len(_known) >= KNOWN:
                _known.clear()
            _known[key] = found
    return found


def simplified(xml: str | None) -> tuple[bool, Element | None]:
    """Whether a dump is strict XML, and its tree under names of kinds, without empty leaves and with wrappers of one child replaced by it; each element is made as it ends."""
    top: list[Element] = []
    inside: list[list] = [[None, top, False]]

    def start(tag, attributes):
        inside[-1][2] = True
        inside.append([attributes, [], False])

    def end(tag):
        attributes, children, parent = inside.pop()
        made = _made(attributes, not parent)
        touched = made.tag in ("Button", "Checker")
        if not children and not (touched or "description" in made.attributes or made.text) and (len(inside) > 1 or not parent):
            return
        if len(children) == 1 and not touched and "text" not in made.attributes and "description" not in made.attributes:
            inside[-1][1].append(children[0])
        else:
            inside[-1][1].append(Element(made.tag, made.attributes, made.text, children, made.tidy))

    return (True, top[0] if top else None) if parsed(xml, start, end, ordered=True) else (False, None)


_spoken, _ticked = (lambda e: e.attributes.get("description")), (lambda e: e.attributes.get("checked", "").lower() == "true")
#: attributes of markup by kind: (kinds, attribute, its value, whether it replaces one that is there); no value leaves none where it replaces
MARKUP = (
    ({"Scroll"}, "data-scroll", lambda e: "true", True),
    ({"Checker"}, "type", lambda e: "checkbox", True),
    ({"Checker"}, "checked", lambda e: "checked" if _ticked(e) else None, True),
    ({"input"}, "type", lambda e: "text", False),
    ({"input"}, "value", lambda e: e.text.strip() or e.attributes.get("text"), False),
    ({"Image"}, "alt", _spoken, False),
    ({"Scroll", "Checker", "input", "Button", "TextField", "div"}, "aria-label", _spoken, False),
)
#: texts by kind, where the rule changes them
SHOWN = {"input": lambda e: "" if e.text.strip() else e.text, "Button": lambda e: e.text if e.text.strip() else e.attributes.get("text") or e.text}


#: the same by kind; attributes that stay by name
_RULES = {tag: tuple(rule[1:] for rule in MARKUP if tag in rule[0]) for tag in set().union(*(rule[0] for rule in MARKUP))}
_STAY = {tag: frozenset(("index", "bounds", *names)) for tag, names in STAY.items()}
_PLACES = frozenset(("index", "bounds"))


def _tidy(e: Element) -> None:
    """One element in the names and attributes of markup."""
    a = e.attributes
    for name, value, replaces in _RULES.get(e.tag, ()):
        if replaces or name not in a:
            found = value(e)
            if found:
                a[name] = found
            elif replaces:
                a.pop(name, None)
    if e.tag in SHOWN:
        e.text = SHOWN[e.tag](e)
    e.tag = NAMES.get(e.tag, e.tag)
    stay = _STAY.get(e.tag, _PLACES)
    e.attributes = {name: value for name, value in a.items() if name in stay}


def _look(e: Element) -> tuple:
    return e.tag, tuple(sorted((k, v) for k, v in e.attributes.items() if k not in ("bounds", "index"))), e.text


def _listed(root: Element, visit=None) -> list[Element]:
    """Elements in document order, each visited before its children are."""
    out, waiting = [], [root]
    while waiting:
        e = waiting.pop()
        if visit:
            visit(e)
        out.append(e)
        if e.children:
            waiting += e.children[::-1]
    return out


def cleaned(root: Element) -> list[Element]:
    """Elements in order, after nodes without an area went, names and attributes became those of markup, a scroller's equal children went, and all were numbered."""

    def visit(e):
        if e.children:
            e.children = [c for c in e.children if c.attributes.get("bounds") != NO_BOUNDS]
        e.tag, e.attributes, e.text = e.tidy.tag, e.tidy.attributes.copy(), e.tidy.text

    found = _listed(root, visit)
    scrolling = [e for e in found if e.attributes.get("data-scroll") == "true"]
    for e in scrolling:
        first: dict[tuple, Element] = {}
        for c in e.children:
            first.setdefault((_look(c), tuple(map(_look, c.children))), c)
        e.children = list(first.values())
    found = _listed(root) if scrolling else found
    for k, e in enumerate(found):
        e.attributes["index"] = str(k)
    return found


_SIGNS = re.compile("[&<>\"\r\n\t]")


def _escaped(text: str, quoted: bool = False) -> str:
    if not _SIGNS.search(text):
        return text
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text.replace('"', "&quot;").replace("\r", "&#13;").replace("\n", "&#10;").replace("\t", "&#09;") if quoted else text


def written(root: Element, drop: tuple[str, ...] = (), texts: bool = True, indent: str = "") -> str:
    """The tree as text; with ``indent``, each child on a line of its own."""
    out: list[str] = []
    waiting: list[tuple[Element | str, int]] = [(root, 0)]
    line = lambda depth: f"\n{indent * depth}" if indent else ""
    while waiting:
        e, depth = waiting.pop()
        if isinstance(e, str):
            out.append(e)
            continue
        text = e.text if texts else ""
        head = f"<{e.tag}" + "".join(f' {k}="{_escaped(v, True)}"' for k, v in e.attributes.items() if k not in drop)
        if not e.children:
            out.append(f"{head}>{_escaped(text)}</{e.tag}>" if text else f"{head} />")
            continue
        out.append(f"{head}>" + (_escaped(text) if text.strip() or not indent else line(depth + 1)))
        waiting.append((f"</{e.tag}>", 0))
        for k, c in enumerate(reversed(e.children)):
            waiting.append((line(depth + 1 if k else depth), 0))
            waiting.append((c, depth + 1))
    return "".join(out)


def shape(root: Element) -> list[dict]:
    """tag, id and depth of elements, without overlays and all below them, and of a scroller's first children only (that is the definition)."""
    out, waiting = [], [(root, 0)]
    while waiting:
        e, depth = waiting.pop()
        name = e.attributes.get("id", "")
        if not any(o in name.lower() for o in OVERLAYS):
            out.append({"tag": e.tag, "id": name, "depth": depth})
            waiting.extend((c, depth + 1) for c in (e.children[:SCROLLED] if e.tag == "Scroll" else e.children))
    return out


_S, _I, _B = pa.string(), pa.int32(), pa.bool_()
_ITEM = pa.struct([("index", _I), ("tag", _S), ("text", _S), ("leaf", _B), ("bounds", _S), ("attributes", pa.map_(_S, _S))])
_SHAPE = pa.list_(pa.struct([("tag", _S), ("id", _S), ("depth", _I)]))
_SCREEN = pa.struct([("parsed", _S), ("hierarchy", _S), ("encoded", _S), ("pretty", _S), ("items", pa.list_(_ITEM)), ("shape", _SHAPE)])


#: how the forms that are texts are written
_WRITTEN = {"parsed": {}, "hierarchy": {"drop": ("bounds", "index"), "texts": False}, "encoded": {"drop": ("bounds",)}, "pretty": {"indent": "  "}}
FORMS = tuple(f.name for f in _SCREEN)


def _forms(xml: str | None, forms: tuple[str, ...]) -> dict:
    """Those forms of one dump; items are elements."""
    text = (xml or "").replace("$", "_")
    strict, root = simplified(text)
    # before the tree is changed
    found: dict = {"shape": shape(root or read(text)) if strict else []} if "shape" in forms else {}
    items = cleaned(root) if root else []
    return found | {n: written(root, **_WRITTEN[n]) if root else "" for n in forms if n in _WRITTEN} | ({"items": items} if "items" in forms else {})


def normalised(xml: str | None) -> dict:
    """All forms of one dump; empty texts and lists for what isn't XML or holds nothing that counts."""
    found = _forms(xml, FORMS)
    items = [{"index": k, "tag": e.tag, "text": e.text, "leaf": not e.children, "bounds": e.attributes.get("bounds") or "", "attributes": list(e.attributes.items())} for k, e in enumerate(found["items"])]
    return {n: found[n] for n in FORMS} | {"items": items}


def _ends(sizes) -> pa.Array:
    return pa.array([0, *accumulate(sizes)], pa.int32())


def _items(rows: list[list[Element]]) -> pa.Array:
    """Elements of each dump as Arrow, column by column."""
    flat = [e for row in rows for e in row]
    held = [e.attributes for e in flat]
    attributes = pa.MapArray.from_arrays(_ends(map(len, held)), pa.array([k for a in held for k in a], _S), pa.array([v for a in held for v in a.values()], _S))
    columns = [
        pa.array([k for row in rows for k in range(len(row))], _I),
        pa.array([e.tag for e in flat], _S),
        pa.array([e.text for e in flat], _S),
        pa.array([not e.children for e in flat], _B),
        pa.array([a.get("bounds") or "" for a in held], _S),
        attributes,
    ]
    return pa.ListArray.from_arrays(_ends(map(len, rows)), pa.StructArray.from_arrays(columns, fields=list(_ITEM)))


@lru_cache
def _screen(forms: tuple[str, ...]):
    kind = pa.struct([_SCREEN.field(n) for n in forms])

    @F.arrow_udf(from_arrow_type(kind))
    def run(xml: pa.Array) -> pa.Array:
        gc.disable()  # trees hold no cycles, and looking for some among them takes a third of the time
        try:
            found = [_forms(x, forms) for x in xml.to_pylist()]
            columns = [_items([x[n] for x in found]) if n == "items" else pa.array([x[n] for x in found], kind.field(n).type) for n in forms]
        finally:
            gc.enable()
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    return run


def screen(xml: Column | str, *forms: str) -> Column:
    """parsed, hierarchy, encoded, pretty, items (elements of the encoded form with their bounds) and shape of each dump, or some of these."""
    return _screen(tuple(n for n in FORMS if not forms or n in forms))(xml)


_FLAGS = {"clickable": "false", "scrollable": "false", "enabled": "true", "checkable": "false", "checked": "false", "long-clickable": "false", "password": "false", "selected": "false", "visible-to-user": "true", "important": "false"}
_TEXTS = ("resource-id", "class", "text", "content-desc", "package")
_KINDS = {"index": _I} | {n.replace("-", "_"): _S for n in _TEXTS} | {"bounds": _S} | {n.replace("-", "_"): _B for n in _FLAGS}


def _raw(xml: str | None) -> list[dict[str, str]]:
    """Attributes of the nodes of a dump."""
    found = []
    return found if parsed(xml, lambda tag, attributes: found.append(attributes) if tag == "node" else None, None) else []


def _values(rows: list[list[dict[str, str]]], name: str) -> list:
    """One column of all nodes."""
    if name == "index":
        return [k for row in rows for k in range(len(row))]
    source = name.replace("_", "-")
    if source in _FLAGS:
        known = {None: _FLAGS[source] == "true", "true": True, "false": False}
        values = [a.get(source) for row in rows for a in row]
        return [known[v] if v in known else v.lower() == "true" for v in values]
    other = NO_BOUNDS if name == "bounds" else ""
    return [a.get(source, other) for row in rows for a in row]


@lru_cache
def _raw_nodes(names: tuple[str, ...]):
    fields = [pa.field(n, _KINDS[n]) for n in names]

    @F.arrow_udf(from_arrow_type(pa.list_(pa.struct(fields))))
    def run(xml: pa.Array) -> pa.Array:
        gc.disable()
        try:
            rows = [_raw(x) for x in xml.to_pylist()]
        finally:
            gc.enable()
        return pa.ListArray.from_arrays(_ends(map(len, rows)), pa.StructArray.from_arrays([pa.array(_values(rows, f.name), f.type) for f in fields], fields=fields))

    return run


def raw_nodes(xml: Column | str, *names: str) -> Column:
    """All nodes of a dump with their places and attributes, or those named of them."""
    return _raw_nodes(tuple(n for n in _KINDS if not names or n in names))(xml)


def _let(c: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is read."""
    return F.get(F.transform(F.array(c), then), 0)


def raw_box(bounds: Column) -> Column:
    """Unsigned bounds at the start of a text; four zeros for anything else."""
    found = F.split(F.regexp_extract(bounds, r"^\[[0-9]+,[0-9]+\]\[[0-9]+,[0-9]+\]", 0), r"[^0-9]+")
    return _let(found, lambda p: F.struct(*(F.coalesce(F.get(p, k).cast("int"), F.lit(0)).alias(n) for k, n in enumerate("ltrb", 1))))


def raw_elements(xml: Column, *names: str) -> Column:
    """Shown elements of a dump that have bounds, with all their attributes or those named; the index counts all its nodes, also those left out."""
    nodes = F.filter(raw_nodes(xml, *(("index", "bounds", "visible_to_user", *names) if names else ())), lambda e: e["visible_to_user"] & (e["bounds"] != NO_BOUNDS))
    return F.filter(F.transform(nodes, lambda e: e.withField("box", raw_box(e["bounds"]))), lambda e: (e["box"]["l"] != 0) | (e["box"]["t"] != 0) | (e["box"]["r"] != 0) | (e["box"]["b"] != 0))


def area(e: Column) -> Column:
    return F.greatest(F.lit(0), (e["box"]["r"] - e["box"]["l"]).cast("bigint") * (e["box"]["b"] - e["box"]["t"]))


def editable(e: Column) -> Column:
    return e["enabled"] & e["class"].rlike("|".join(EDITABLE))


def clickable(e: Column) -> Column:
    return e["clickable"] & e["enabled"] & (area(e) > 0)


def interactable(e: Column) -> Column:
    return e["enabled"] & (area(e) > 0) & (e["clickable"] | e["scrollable"] | e["long_clickable"] | e["checkable"] | editable(e))


def short_class(e: Column) -> Column:
    return F.substring_index(e["class"], ".", -1)


def shown_name(e: Column) -> Column:
    """Description, else text, else the id in words, else the class."""
    words = F.replace(F.substring_index(e["resource_id"], "/", -1), F.lit("_"), F.lit(" "))
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in (e["content_desc"], e["text"])), F.when(e["resource_id"] != "", words), short_class(e))


def dialog_button(elements: Column, words: tuple[str, ...]) -> Column:
    """Index of the first clickable element whose text or description holds the earliest of the words; null if none does."""
    said = lambda e: F.lower(F.concat_ws(" ", e["text"], e["content_desc"]))
    wanted = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(w.lower()).alias("word")) for k, w in enumerate(words)))
    hits = F.transform(F.filter(elements, clickable), lambda e: F.struct(F.array_min(F.transform(F.filter(wanted, lambda w: said(e).contains(w["word"])), lambda w: w["place"])).alias("place"), e["index"].alias("index")))
    return F.array_min(F.filter(hits, lambda h: h["place"].isNotNull()))["index"]


def _get(item: Column, name: str) -> Column:
    return F.coalesce(F.element_at(item["attributes"], F.lit(name)), F.lit(""))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def element_lines(items: Column) -> Column:
    """A line for each leaf and each scroller, in page order, repeats kept."""
    lines = F.filter(items, lambda e: e["leaf"] | (_get(e, "data-scroll") == "true"))
    attributes = lambda e: F.concat(*(F.when(_get(e, n) != "", F.concat(F.lit(f' {n}="'), _get(e, n), F.lit('"'))).otherwise("") for n in LINE))
    return F.transform(lines, lambda e: F.concat(F.lit("<"), e["tag"], attributes(e), F.lit(">"), _trimmed(F.replace(e["text"], F.lit("\n"))), F.lit("</"), e["tag"], F.lit(">")))


def interactable_indexes(items: Column) -> Column:
    return F.transform(F.filter(items, lambda e: e["tag"].isin("button", "input")), lambda e: e["index"])


def bounds_of(items: Column, index: Column) -> Column:
    """Bounds of the element of that index, null if it has none."""
    return F.nullif(F.get(F.filter(items, lambda e: e["index"] == index), 0)["bounds"], F.lit(""))


def allowed(e: Column) -> Column:
    """Actions (fixed names) that an element of the encoded form takes."""
    names = lambda *x: F.array(*map(F.lit, x))
    return (
        F.when(e["tag"] == "button", names("touch", "long_touch"))
        .when((e["tag"] == "input") & (_get(e, "type") == "checkbox"), names("select"))
        .when(e["tag"] == "input", names("set_text"))
        .when((e["tag"] == "div") & (_get(e, "data-scroll") == "true"), names("scroll"))
        .otherwise(F.array().cast("array<string>"))
    )


def _label(e: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in (_trimmed(e["text"]), *(_get(e, n) for n in names))))


def _middle(box: Column) -> Column:
    half = lambda a, b: F.floor((a + b) / 2).cast("int")
    return F.struct(half(box["l"], box["r"]).alias("x"), half(box["t"], box["b"]).alias("y"))


def acting(items: Column) -> Column:
    """Elements that take an action: index, signature without places, actions, middle, a short text, key of kind and size."""

    def one(x):
        e, box, label = x["e"], x["box"], x["label"]
        kind = F.concat_ws(":", e["tag"], _get(e, "type"))
        named_by = F.coalesce(label, F.concat(F.lit("@"), e["index"]))
        size = F.concat_ws("x", box["r"] - box["l"], box["b"] - box["t"])
        short = F.concat(F.lit("<"), e["tag"], F.lit(">"), F.coalesce(label, F.lit("")), F.lit("</"), e["tag"], F.lit(">"))
        return F.struct(e["index"].alias("index"), F.concat_ws(":", kind, named_by).alias("signature"), x["actions"].alias("actions"), _middle(box).alias("middle"), short.alias("short"), F.concat_ws(":", kind, size).alias("struct_key"))

    known = F.transform(items, lambda e: F.struct(e.alias("e"), allowed(e).alias("actions")))
    acts = F.filter(known, lambda x: F.size(x["actions"]) > 0)
    read = F.transform(acts, lambda x: F.struct(x["e"].alias("e"), x["actions"].alias("actions"), raw_box(x["e"]["bounds"]).alias("box"), _label(x["e"], ("aria-label", "alt", "value")).alias("label")))
    return F.transform(read, one)


def scrollers(elements: Column) -> Column:
    """Scrollable elements of a raw dump in the shape of ``acting``, numbered -1, -2 and on."""

    def one(e, k):
        key = F.concat_ws(":", F.lit("scroll"), e["resource_id"], short_class(e))
        return F.struct((-1 - k).cast("int").alias("index"), key.alias("signature"), F.array(F.lit("scroll")).alias("actions"), _middle(e["box"]).alias("middle"), F.concat(F.lit("<scroll>"), shown_name(e), F.lit("</scroll>")).alias("short"), key.alias("struct_key"))

    return F.transform(F.filter(elements, lambda e: e["scrollable"]), one)


def fingerprint(shape_: Column) -> Column:
    """md5 over the sorted distinct parts of a shape, in this library's own notation."""
    return F.md5(F.to_json(F.array_sort(F.array_distinct(shape_))))
