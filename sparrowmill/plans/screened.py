"""Queries over screen dumps, which are built from the lines of orders: a frame around buttons, texts and empty leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowmill.functions import screens as S
from sparrowmill.operators.ordering import spread
from sparrowmill.plans.registry import query

LINES = "(SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS INT)) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"
BUTTON = "'<button index=\"' || k || '\">' || q || '</button>'"
ENCODED = f"(SELECT l_orderkey, any_value(n) AS n, '<div index=\"0\">' || string_agg({BUTTON}, '' ORDER BY k) || '</div>' AS encoded FROM {LINES} x GROUP BY l_orderkey)"


def dumps(t):
    """(l_orderkey, xml): per order a frame; per line a wrapper of one button and of an empty leaf, and a node without an area."""
    bounds = lambda a, b: F.concat(F.lit(' bounds="[0,'), a, F.lit("]["), b, F.lit(',99]"'))
    button = lambda x, q: F.concat(F.lit('<node class="android.widget.Button" clickable="true" text="'), q, F.lit('"'), bounds(x, q), F.lit("/>"))
    line = lambda x, q: F.concat(F.lit('<node class="LinearLayout">'), button(x, q), F.lit('<node class="View"/></node><node class="Button" clickable="true" bounds="[0,0][0,0]" text="gone"/>'))
    rows = spread(t["lineitem"].select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q")), "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))).alias("xs"))
    body = F.array_join(F.transform("xs", lambda r: line(r["l_linenumber"].cast("string"), r["q"].cast("string"))), "")
    return rows.select("l_orderkey", F.concat(F.lit('<hierarchy rotation="0"><node class="android.widget.FrameLayout">'), body, F.lit("</node></hierarchy>")).alias("xml"))


def screens(t, *forms):
    return dumps(t).select("l_orderkey", "xml", S.screen("xml", *forms).alias("s"))


@query("xml01_screens", "SELECT l_orderkey, md5(coalesce(encoded, '')) AS encoded, md5(regexp_replace(coalesce(encoded, ''), '(>[0-9]+</button>)|( index=\"[0-9]+\")', '', 'g')) AS stripped, n AS n_buttons FROM " + ENCODED + " e")
def xml01(t):
    """Encoded form; it and the form of structure alone agree once numbers and texts are gone."""
    bare = F.regexp_replace("s.hierarchy", " />", "")
    s = screens(t, "hierarchy", "encoded", "items").select("l_orderkey", "s.encoded", bare.alias("bare"), F.size(S.interactable_indexes(F.col("s.items"))).alias("n_buttons"))
    return s.select("l_orderkey", F.md5("encoded").alias("encoded"), F.md5("bare").alias("stripped"), "n_buttons")


@query("xml06_bounds_by_index", f"SELECT l_orderkey, k AS index, '[0,' || l_linenumber || '][' || q || ',99]' AS bounds FROM {LINES} x")
def xml06(t):
    items = screens(t, "items").select("l_orderkey", F.explode("s.items").alias("e"))
    return items.where("e.bounds <> ''").select("l_orderkey", F.col("e.index").alias("index"), F.col("e.bounds").alias("bounds"))


@query("fn55_raw_elements", f"SELECT l_orderkey, 4 * k - 2 AS index, CAST(q AS VARCHAR) AS text, (q * (99 - l_linenumber))::BIGINT AS area FROM {LINES} x WHERE q * (99 - l_linenumber) > 0")
def fn55(t):
    shown = dumps(t).select("l_orderkey", F.explode(F.filter(S.raw_elements(F.col("xml"), "text", "clickable", "enabled"), S.clickable)).alias("e"))
    return shown.select("l_orderkey", (F.col("e.index")).alias("index"), F.col("e.text").alias("text"), S.area(F.col("e")).alias("area"))


@query("fn56_acting_elements", f"SELECT l_orderkey, k AS index, 'button::' || q AS signature, 'touch,long_touch' AS actions, q // 2 AS x, (l_linenumber + 99) // 2 AS y, '<button>' || q || '</button>' AS short, 'button::' || q || 'x' || (99 - l_linenumber) AS struct_key FROM {LINES} x")
def fn56(t):
    acting = screens(t, "items").select("l_orderkey", F.explode(S.acting(F.col("s.items"))).alias("e"))
    return acting.select("l_orderkey", "e.index", "e.signature", F.array_join("e.actions", ",").alias("actions"), "e.middle.x", "e.middle.y", "e.short", "e.struct_key")


@query("fn59_screen_lines", f"SELECT l_orderkey, string_agg('<button>' || q || '</button>', '|' ORDER BY k) AS lines FROM {LINES} x GROUP BY l_orderkey")
def fn59(t):
    return screens(t).select("l_orderkey", F.array_join(S.element_lines(F.col("s.items")), "|").alias("lines"))


@query("fn60_dialog_button", f"SELECT l_orderkey, min_by(4 * k - 2, CASE WHEN q LIKE '%7%' THEN 0 ELSE 100 END + k) AS index FROM (SELECT l_orderkey, k, CAST(q AS VARCHAR) AS q FROM {LINES} x) y WHERE q LIKE '%7%' OR q LIKE '%1%' GROUP BY l_orderkey")
def fn60(t):
    """Buttons that show a 7 are preferred to those that show a 1."""
    elements = S.raw_elements(F.col("xml"), "text", "content_desc", "clickable", "enabled")
    found = F.array_compact(F.array(S.dialog_button(elements, ("7", "1"))))  # a filter on the index would read each dump twice
    return dumps(t).select("l_orderkey", F.explode(found).alias("index"))


@query("fn65_screen_fingerprint", f"SELECT n, count(*) AS orders, 1 AS shapes FROM {ENCODED} e GROUP BY n")
def fn65(t):
    """Screens of as many lines have one shape, whatever their texts and bounds."""
    by_size = screens(t).select(F.greatest(F.size("s.items") - 1, F.lit(1)).alias("n"), S.fingerprint(F.col("s.shape")).alias("f"))
    return by_size.groupBy("n").agg(F.count("*").alias("orders"), F.count_distinct("f").cast("int").alias("shapes"))


#: lines of an order as elements of all kinds, by their place; a scroller shows its text twice, of which one stays
KINDS = """k6 AS (SELECT l_orderkey, k, q, (k - 1) % 6 AS kind, 1 + coalesce(sum(CASE WHEN (k - 1) % 6 = 5 THEN 2 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS i FROM """ + LINES + """ x)"""
ELEMENT = """CASE kind WHEN 0 THEN '<button index="' || i || '">' || q || '</button>' WHEN 1 THEN '<input type="text" value="' || q || '" index="' || i || '" />' WHEN 2 THEN '<input checked="checked" type="checkbox" index="' || i || '" />'
  WHEN 3 THEN '<img alt="' || q || '" index="' || i || '" />' WHEN 4 THEN '<p index="' || i || '">' || q || '</p>' ELSE '<div data-scroll="true" index="' || i || '"><p index="' || (i + 1) || '">' || q || '</p></div>' END"""
SHOWN_LINE = """CASE kind WHEN 0 THEN '<button>' || q || '</button>' WHEN 1 THEN '<input type="text" value="' || q || '"></input>' WHEN 2 THEN '<input type="checkbox" checked="checked"></input>'
  WHEN 3 THEN '<img alt="' || q || '"></img>' WHEN 4 THEN '<p>' || q || '</p>' ELSE '<div data-scroll="true"></div>|<p>' || q || '</p>' END"""


def all_kinds(t):
    """(l_orderkey, xml): per order a frame with a button, a text field, a checked box, a picture, a text, a scroller and on; and a node without an area."""
    q, k = F.col("r.q").cast("string"), F.col("at")
    node = lambda name, more: F.concat(F.lit(f'<node class="a.{name}" bounds="[0,1][2,3]" '), *more, F.lit("/>"))
    value = lambda name: (F.lit(f'{name}="'), q, F.lit('"'))
    row = node("TextView", value("text"))
    made = (
        F.when(k % 6 == 0, node("Button", (F.lit('clickable="true" '), *value("text"))))
        .when(k % 6 == 1, node("EditText", value("text")))
        .when(k % 6 == 2, node("CheckBox", (F.lit('checkable="true" checked="true" clickable="true" '), *value("text"))))
        .when(k % 6 == 3, node("ImageView", value("content-desc")))
        .when(k % 6 == 4, row)
        .otherwise(F.concat(F.lit('<node class="RecyclerView" scrollable="true" bounds="[0,1][2,3]">'), row, row, F.lit("</node>")))
    )
    rows = t["lineitem"].groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("xs"))
    parts = rows.select("l_orderkey", F.posexplode("xs").alias("at", "r")).select("l_orderkey", "at", made.alias("x"))
    body = parts.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]), "").alias("body"))
    gone = '<node class="Button" clickable="true" bounds="[0,0][0,0]" text="gone"/>'
    return body.select("l_orderkey", F.concat(F.lit('<hierarchy><node class="android.widget.FrameLayout">'), "body", F.lit(f"{gone}</node></hierarchy>")).alias("xml"))


@query("xml03_screens_of_all_kinds", f"WITH {KINDS} SELECT l_orderkey, md5('<div index=\"0\">' || string_agg({ELEMENT}, '' ORDER BY k) || '</div>') AS encoded, string_agg({SHOWN_LINE}, '|' ORDER BY k) AS lines, count_if(kind <= 2) AS n_touchable FROM k6 GROUP BY l_orderkey")
def xml03(t):
    s = all_kinds(t).select("l_orderkey", S.screen("xml").alias("s"))
    items = F.col("s.items")
    return s.select("l_orderkey", F.md5("s.encoded").alias("encoded"), F.array_join(S.element_lines(items), "|").alias("lines"), F.size(S.interactable_indexes(items)).alias("n_touchable"))


@query("fn56_acting_elements_of_all_kinds", f"""WITH {KINDS} SELECT l_orderkey, i AS index, CASE kind WHEN 0 THEN 'button::' || q WHEN 1 THEN 'input:text:' || q WHEN 2 THEN 'input:checkbox:@' || i ELSE 'div::@' || i END AS signature,
  CASE kind WHEN 0 THEN 'touch,long_touch' WHEN 1 THEN 'set_text' WHEN 2 THEN 'select' ELSE 'scroll' END AS actions FROM k6 WHERE kind IN (0, 1, 2, 5)""")
def fn56_all(t):
    acting = all_kinds(t).select("l_orderkey", F.explode(S.acting(S.screen("xml")["items"])).alias("e"))
    return acting.select("l_orderkey", "e.index", "e.signature", F.array_join("e.actions", ",").alias("actions"))
