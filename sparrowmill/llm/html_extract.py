"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks (text between block-level tags). A numpy bidirectional LSTM reads for each block the mean of
learned vectors of its tag path (tags, classes, ids and roles of all open elements, hashed), the mean of learned vectors of
all its hashed words and a few measures (length, share of linked text, place in the page), and labels every block with the
whole page as context. The blocks labelled as main text are the result.

There are no labelled pages, so the labeller learns from the pages themselves: in a bounded sample of pages that have an
``article`` or ``main`` element, blocks inside it and outside any element that is or names a menu, notice, advert, form,
comment or the like are main text, all others aren't. An article's own names don't count, nor does a header inside it.
Blocks with such paths are also put in at random places with words of the page, elements are put in between, and path parts
are hidden at random, so that it relies on paths, words and neighbours together. Where no page of the sample has such an
element, pages made of the same parts and the words of the sample teach it.

White space in a block becomes one blank, blocks are joined by a line feed, character references are decoded, and
nothing is dropped or cut besides. Scripts, styles, comments and other text that isn't shown never become blocks; formulas
do. A slash at the end of a tag means nothing, as in HTML. Defined cases: null or empty html, and pages without main text,
give an empty text of length 0; very long and very deep pages are labelled whole, in time that goes with their length;
broken markup is read as far as it goes (a tag, script or comment that doesn't end takes the rest of the page); an empty
table gives no rows; repeated rows and extra columns don't matter.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPENED = re.compile(r"</?[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?)")
PARTS = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: elements whose content is text up to their end tag and isn't shown; elements that aren't shown but hold markup
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style textarea title iframe noembed noframes".split()}
HIDDEN = frozenset("head noscript template svg select object datalist audio video canvas annotation annotation-xml".split())
HEAD_ONLY = frozenset("head html base basefont bgsound link meta noscript script style template title".split())
QUIET = HIDDEN - {"head"}  # they stand within a block
INLINE = frozenset("math menclose mfenced mfrac mi mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
MAIN = frozenset(("article", "main"))
SIDE_TAGS = frozenset("nav header footer aside form button menu dialog label".split())
SIDE_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies disqus footer form header login menu modal nav navbar navigation newsletter notice notices "
    "notification pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: what else holds an article on other sites
CONTAINERS = (("main",), ("article",), ("div", "content"), ("div", "post"), ("div", "entry"), ("section", "body"), ("main", "article"), ("div", "main", "article"), ("div", "story"))
PLAIN = ("post", "entry", "body", "text", "page", "wrap")
#: forms that main text takes, forms of what readers write, and what heads it
FORMS = (("ul", "li"), ("ol", "li"), ("table", "tr", "td"), ("table", "tbody", "tr", "th"), ("blockquote", "p"), ("blockquote",), ("dl", "dd"), ("dl", "dt"), ("figure", "figcaption"), ("pre",), ("h2",), ("h3",), ("section", "p"), ("div", "p"))
POSTS = (("ul", "li"), ("ol", "li"), ("ol", "li", "p"), ("div", "p"), ("p",), ("div",), ("article", "p"), ("blockquote", "p"))
COMMENT_NAMES = ("comment", "comments", "replies", "respond", "disqus", "reply")
TAG_SLOTS, WORD_SLOTS, WIDTH, STATE, MEASURES = 512, 1024, 8, 12, 6


class Path:
    """An open element with its names and all elements around it; elements of like paths share one."""

    __slots__ = ("parent", "slots", "count", "depth", "main", "side", "children", "sums")

    def __init__(self, parent: Path | None, parts: tuple[str, ...]):
        self.parent, self.children, self.sums = parent, {}, None
        self.slots = [slot(p, TAG_SLOTS) for p in parts]
        self.count = len(parts) + (parent.count if parent else 0)
        self.depth = 1 + parent.depth if parent else 0
        self.main = self.side = False
        if parent:
            tag, *names = parts
            self.main = parent.main or tag in MAIN
            kept = tag in MAIN or (tag == "header" and parent.main)
            self.side = parent.side or (not kept and (tag in SIDE_TAGS or any(n in SIDE_NAMES for n in names)))

    def inside(self, *parts: str) -> Path:
        found = self.children.get(parts)
        if found is None:
            found = self.children[parts] = Path(self, parts)
        return found

    def all_slots(self) -> list[int]:
        out, at = [], self
        while at is not None:
            out += at.slots
            at = at.parent
        return out or [0]

    def mean(self, table: np.ndarray) -> np.ndarray:
        """Mean of the vectors of all parts; sums are kept with each path."""
        at, new = self, []
        while at is not None and at.sums is None:
            new.append(at)
            at = at.parent
        for path in reversed(new):
            path.sums = (path.parent.sums if path.parent is not None else 0) + table[path.slots].sum(0)
        return self.sums / self.count if self.count else table[0]


class Block:
    __slots__ = ("path", "linked", "text")

    def __init__(self, text: str, path: Path, linked: float):
        self.text, self.path, self.linked = text, path, linked


def tag_at(page: str, at: int) -> tuple[str, str, int]:
    """Name, names in class, id and role, and end (0 where the page ends first) of the tag that opens at ``at``."""
    m = OPENED.match(page, at)
    name, names, at = m[0].lower().lstrip("<"), "", m.end()
    while True:
        m = ATTRIBUTE.match(page, at)
        if m is None:
            return name, names, 0
        at = m.end()
        if m[1]:
            return name, names, at
        if m[2].lower() in ("class", "id", "role"):
            names += " " + (m[3] or m[4] or m[5] or "")


def blocks(page: str | None, root: Path | None = None) -> list[Block]:
    """The blocks of a page in order, each with the path of its open elements from the outside in."""
    out: list[Block] = []
    page, path = page or "", root or Path(None, ())
    stack: list[tuple[str, Path, bool, bool]] = []  # tag, path around it, whether it hides, whether it bounds a block
    opened: Counter[str] = Counter()
    held: list[str] = []
    links = anchors = hidden = at = 0

    def flush():
        nonlocal links
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(text, path, min(1.0, links / len(text))))
            held.clear()
        links = 0

    def leave(k: int):
        nonlocal path, hidden
        if any(bounds for *_, bounds in stack[k:]):
            flush()
        for tag, _, hides, _ in stack[k:]:
            opened[tag] -= 1
            hidden -= hides
        path = stack[k][1]
        del stack[k:]

    def close(tag: str) -> None:
        if opened[tag]:
            k = len(stack) - 1
            while stack[k][0] != tag:
                k -= 1
            leave(k)

    while at < len(page):
        cut = page.find("<", at)
        cut = cut if cut >= 0 else len(page)
        if cut > at and not hidden:
            held.append(page[at:cut])
            links += (cut - at) * anchors
        if cut + 1 >= len(page):
            if cut < len(page) and not hidden:
                held.append("<")
            break
        sign = page[cut + 1]
        if sign in "!?":
            end = page.find("-->", cut + 2) + 3 if page.startswith("<!--", cut) else page.find(">", cut) + 1
            if page.startswith(("<!-->", "<!--->"), cut):
                end = page.find(">", cut) + 1
            at = end if end > cut else len(page)
            continue
        if not OPENED.match(page, cut):
            if sign == "/":  # </ and no name: a comment
                at = page.find(">", cut) + 1 or len(page)
            else:
                if not hidden:
                    held.append("<")
                at = cut + 1
            continue
        tag, names, at = tag_at(page, cut)
        if not at:
            break
        closing, tag = tag[0] == "/", tag.lstrip("/")
        if tag in RAW and not opened["svg"]:
            if closing:
                continue
            end = RAW[tag].search(page, at)
            if end is None:
                break
            at = page.find(">", end.end()) + 1 or len(page)
            continue
        if tag not in INLINE and tag not in QUIET and not hidden:
            flush()
        if closing:
            if tag == "a":
                anchors = 0
            close(tag)
            continue
        if opened["head"] and tag not in HEAD_ONLY:
            close("head")
        if tag == "br" and not hidden:
            held.append(" ")
        if tag in VOID or (opened["svg"] and page[at - 2] == "/"):
            continue
        if tag == "a":
            anchors = 1
        if tag in CLOSES_P or tag == "li":
            ends = "p" if tag in CLOSES_P else "li"
            if opened[ends] and stack[-1][0] == ends:
                leave(len(stack) - 1)
        if tag not in INLINE:
            hides = tag in HIDDEN
            stack.append((tag, path, hides, not hidden and tag not in QUIET))
            opened[tag] += 1
            hidden += hides
            path = path.inside(tag, *sorted({*PARTS.findall(names.lower())})) if names else path.inside(tag)
    flush()
    return out


def is_main(path: Path) -> bool:
    """The rule that labels the sample."""
    return path.main and not path.side


def slot(word: str, slots: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % slots


class Inputs:
    """Paths, hashed words and the measures of the blocks of one page."""

    def __init__(self, found: list[Block]):
        n = len(found)
        self.n, self.paths = n, [b.path for b in found]
        self.words = [[slot(x, WORD_SLOTS) for x in b.text.split(" ")] for b in found]
        self.measures = np.array([[min(4.0, np.log1p(len(b.text)) / 2), b.linked, k / n, (n - k) / n, min(1.0, b.path.count / 10), b.text[-1] in ".!?:;\""] for k, b in enumerate(found)], np.float32).reshape(n, MEASURES)

    def tags(self) -> list[list[int]]:
        return [p.all_slots() for p in self.paths]


def averaged(table: np.ndarray, lists: list[list[int]]) -> np.ndarray:
    sizes = np.array([len(x) for x in lists])
    flat = np.fromiter((i for x in lists for i in x), np.int64, sizes.sum())
    return np.add.reduceat(table[flat], np.r_[0, np.cumsum(sizes)[:-1]], axis=0) / sizes[:, None]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Vectors of path parts and words, one LSTM for each direction, and the output weights."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        wide = 2 * WIDTH + MEASURES
        normal = lambda *shape, s=0.3: (s * rng.standard_normal(shape)).astype(np.float32)
        self.p = {"tags": normal(TAG_SLOTS, WIDTH), "words": normal(WORD_SLOTS, WIDTH), "out": normal(2 * STATE + 1)}
        for d in "fb":
            self.p[d] = normal(wide + STATE + 1, 4 * STATE)
            self.p[d][-1, STATE : 2 * STATE] = 1.0  # the forget gate starts open

    def inputs(self, pages: list[Inputs], frozen: bool = False) -> np.ndarray:
        """(steps, pages, features) of pages padded to the longest; once frozen, paths keep the sums of their vectors."""
        longest = max(p.n for p in pages)
        x = np.zeros((longest, len(pages), 2 * WIDTH + MEASURES), np.float32)
        for k, p in enumerate(pages):
            x[: p.n, k] = np.concatenate([np.array([q.mean(self.p["tags"]) for q in p.paths]) if frozen else averaged(self.p["tags"], p.tags()), averaged(self.p["words"], p.words), p.measures], 1)
        return x

    def run(self, x: np.ndarray, lengths: np.ndarray, d: str, keep: bool = False):
        """Hidden states of one direction; padding after a page's end leaves the state at zero."""
        steps, n, _ = x.shape
        w = self.p[d]
        h, c = np.zeros((n, STATE), np.float32), np.zeros((n, STATE), np.float32)
        out, saved = np.zeros((steps, n, STATE), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            on = (t < lengths)[:, None]
            z = np.concatenate([x[t], h, np.ones((n, 1), np.float32)], 1)
            g = z @ w
            i, f, o, u = sigmoid(g[:, :STATE]), sigmoid(g[:, STATE : 2 * STATE]), sigmoid(g[:, 2 * STATE : 3 * STATE]), np.tanh(g[:, 3 * STATE :])
            before = c
            c = np.where(on, f * c + i * u, 0)
            tc = np.tanh(c)
            h = np.where(on, o * tc, 0)
            out[t] = h
            if keep:
                saved.append((t, on, z, i, f, o, u, before, tc))
        return out, saved

    def label(self, pages: list[Inputs]) -> list[np.ndarray]:
        """Probabilities that each block of each page is main text."""
        x, lengths = self.inputs(pages, True), np.array([p.n for p in pages])
        both = np.concatenate([self.run(x, lengths, "f")[0], self.run(x, lengths, "b")[0]], 2)
        p = sigmoid(both @ self.p["out"][:-1] + self.p["out"][-1])
        return [p[: n, k] for k, n in enumerate(lengths)]

    def gradients(self, pages: list[Inputs], truth: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, lengths = self.inputs(pages), np.array([p.n for p in pages])
        steps, n, _ = x.shape
        (hf, sf), (hb, sb) = self.run(x, lengths, "f", True), self.run(x, lengths, "b", True)
        both = np.concatenate([hf, hb], 2)
        y = np.zeros((steps, n), np.float32)
        for k, t in enumerate(truth):
            y[: len(t), k] = t
        mask = np.arange(steps)[:, None] < lengths[None, :]
        err = (sigmoid(both @ self.p["out"][:-1] + self.p["out"][-1]) - y) * mask / mask.sum()
        g = {"out": np.r_[(both * err[:, :, None]).sum((0, 1)), err.sum()]}
        dx = np.zeros_like(x)
        for d, saved, part in (("f", sf, 0), ("b", sb, STATE)):
            w = self.p[d]
            gw, dh, dc = np.zeros_like(w), np.zeros((n, STATE), np.float32), np.zeros((n, STATE), np.float32)
            for t, on, z, i, f, o, u, before, tc in reversed(saved):
                dh = np.where(on, dh + err[t][:, None] * self.p["out"][part : part + STATE], 0)
                dc = np.where(on, dc + dh * o * (1 - tc**2), 0)
                dg = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u**2)], 1)
                gw += z.T @ dg
                dz = dg @ w.T
                dx[t] += dz[:, : x.shape[2]]
                dh, dc = dz[:, x.shape[2] : -1], dc * f
            g[d] = gw
        g["tags"], g["words"] = np.zeros_like(self.p["tags"]), np.zeros_like(self.p["words"])
        for k, p in enumerate(pages):
            for name, lists, at in (("tags", p.tags(), 0), ("words", p.words, WIDTH)):
                sizes = np.array([len(v) for v in lists])
                flat = np.fromiter((i for v in lists for i in v), np.int64, sizes.sum())
                np.add.at(g[name], flat, np.repeat(dx[: p.n, k, at : at + WIDTH] / sizes[:, None], sizes, 0))
        return g

    def learn(self, pages: list[tuple[Inputs, np.ndarray]], rounds: int, seed: int = 5) -> None:
        """Adam over small batches of pages of like length."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        order = sorted(range(len(pages)), key=lambda k: pages[k][0].n)
        for t in range(1, rounds + 1):
            at = rng.integers(0, max(1, len(order) - 24))
            batch = [pages[k] for k in order[at : at + 24]]
            for k, g in self.gradients([b[0] for b in batch], [b[1] for b in batch]).items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g**2
                self.p[k] = (self.p[k] - 0.03 * min(1.0, 2 - 2 * t / rounds) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)


def rebuilt(path: Path, change: Callable[[tuple[str, ...]], list[tuple[str, ...]]]) -> Path:
    """The same path with each element's parts changed."""
    out = Path(None, ())
    for parts in chain(path):
        for new in change(parts):
            out = out.inside(*new) if new else out
    return out


def chain(path: Path) -> list[tuple[str, ...]]:
    """Parts of each element of a path from the outside in."""
    out = []
    while path.parent is not None:
        out.append(next(parts for parts, child in path.parent.children.items() if child is path))
        path = path.parent
    return out[::-1]


def augmented(found: list[Block], rng: np.random.Generator) -> list[tuple[Block, bool]]:
    """A page's blocks with their labels, main text of other forms and what isn't main text put in, elements put in between, and parts of paths hidden."""
    out = [(b, is_main(b.path)) for b in found]
    sides, bodies = sorted(SIDE_NAMES), sorted(SIDE_TAGS)
    words = [w for b in found for w in b.text.split(" ")[:200]]
    plain = Path(None, ()).inside("html").inside("body")
    drawn = lambda n: " ".join(words[i] for i in rng.integers(0, len(words), n))
    for _ in range(rng.integers(0, 5)):
        at = int(rng.integers(0, len(out) + 1))
        near = out[min(at, len(out) - 1)][0].path if rng.random() < 0.5 else plain
        kind = near.inside("div", sides[rng.integers(len(sides))]) if rng.random() < 0.6 else near.inside(bodies[rng.integers(len(bodies))])
        if kind.parent.main and chain(kind)[-1] == ("header",):
            kind = plain.inside("header")
        for _ in range(rng.integers(1, 4)):
            low = kind.inside("p") if rng.random() < 0.5 else kind.inside("ul").inside("li") if rng.random() < 0.5 else kind
            out.insert(at, (Block(drawn(rng.integers(1, 40)), low, float(rng.random() < 0.3)), False))
    for _ in range(rng.integers(0, 4)):  # main text of any words, at a random place among it
        inside = [k for k, (_, y) in enumerate(out) if y]
        if inside:
            at = inside[rng.integers(len(inside))]
            text = " ".join([drawn(1)] * rng.integers(2, 40)) if rng.random() < 0.4 else drawn(rng.integers(1, 60))
            path = out[at][0].path
            path = path if rng.random() < 0.7 or path.parent is None else path.parent.inside(("h2", "p", "blockquote", "pre", "header")[rng.integers(5)])
            out.insert(at + 1, (Block(text, path, 0.0), True))
    draw = lambda options: options[rng.integers(len(options))]
    below = lambda path, tags: below(path.inside(tags[0]), tags[1:]) if tags else path
    text_of = lambda path, most: Block(drawn(rng.integers(1, most)), path, float(rng.random() < 0.2))
    inside = [k for k, (_, y) in enumerate(out) if y]
    if inside:
        holder = out[inside[0]][0].path
        while holder.parent is not None and holder.parent.main:
            holder = holder.parent
        for _ in range(rng.integers(0, 4)):  # lists, tables, quotes and headings of main text
            form, at = draw(FORMS), inside[rng.integers(len(inside))] + 1
            out[at:at] = [(text_of(below(holder, form), 25), True) for _ in range(rng.integers(1, 7))]
        end = 1 + max(k for k, (_, y) in enumerate(out) if y)
        if rng.random() < 0.4:  # what readers write, with a heading, in the article or behind it
            around = (holder if rng.random() < 0.6 else plain).inside(draw(("section", "div", "aside", "ul")), draw(COMMENT_NAMES))
            posts = [text_of(below(around, draw(POSTS)), 40) for _ in range(rng.integers(1, 6))]
            out[end:end] = [(b, False) for b in [text_of(around.inside(draw(("h2", "h3", "h4", "p"))), 4)] * (rng.random() < 0.7) + posts]
        if rng.random() < 0.3:  # a form in the article or beside it
            form = draw((holder, plain)).inside("form")
            at = int(rng.integers(0, end + 1)) if form.parent is plain else end
            out[at:at] = [(text_of(form.inside(draw(("label", "p", "div", "label", "button"))), 8), False) for _ in range(rng.integers(1, 4))]
    hide = rng.random() < 0.1
    if inside and not hide and rng.random() < 0.3:  # lists without a name beside the text
        at = draw((0, len(out)))
        out[at:at] = [(text_of(below(plain, draw(POSTS[:6])), 40), False) for _ in range(rng.integers(1, 6))]
    other = CONTAINERS[rng.integers(len(CONTAINERS))] if rng.random() < 0.5 else None
    deep = int(rng.integers(1, 15)) if rng.random() < 0.3 else 0  # elements without a meaning, around the main text or inside it
    named = sides[rng.integers(len(sides))] if rng.random() < 0.1 else None

    def change(parts):
        tag, *names = parts
        if tag not in MAIN:
            kept = tuple(p for p in parts if rng.random() > 0.03)
            return [kept] if rng.random() > 0.02 * deep else [kept, *[("div",)] * deep]
        if deep and rng.random() < 0.3:
            names.append(PLAIN[rng.integers(len(PLAIN))])
        new = [] if hide else [other] if other else [(tag, *names, *([named] if named else []))]
        return [*[("div",)] * (deep // 2), *new, *[("div",)] * (deep - deep // 2)]

    return [(Block(b.text, rebuilt(b.path, change), b.linked), y) for b, y in out]


def made(words: list[str], rng: np.random.Generator) -> list[Block]:
    """The blocks of a page of the usual parts with the given words."""
    body = Path(None, ()).inside("html").inside("body")
    text = lambda n: " ".join(words[i] for i in rng.integers(0, len(words), n))
    menu = [Block(text(rng.integers(1, 4)), body.inside("nav").inside("ul").inside("li"), 1.0) for _ in range(rng.integers(1, 8))]
    article = body.inside("article")
    inner = [Block(text(rng.integers(3, 12)), article.inside("h1"), 0.0)] + [Block(text(rng.integers(10, 120)), article.inside("p"), 0.0) for _ in range(rng.integers(2, 15))]
    return [*menu, *inner, Block(text(rng.integers(5, 25)), body.inside("footer"), 0.0)]


def train(pages: DataFrame, sample: int = 500, longest: int = 120, characters: int = 60_000, rounds: int = 600) -> Labeller | None:
    """From at most ``sample`` pages with an article (any pages, if none has), those with the smallest hash of the id.

    Pages of over ``longest`` blocks or ``characters`` characters don't teach; None without pages to take words from.
    """
    short = pages.where(F.col("html").isNotNull() & (F.length("html") < characters)).select("page_id", "html")

    def drawn(found: DataFrame) -> list[str]:
        """Texts of at most ``sample`` pages; ids are drawn first, so that tasks send no texts but those."""
        ids = found.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).distinct()
        one = found.join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html"))
        return [r.html for r in one.orderBy(F.xxhash64("page_id"), "page_id").collect()]

    rng = np.random.default_rng(3)
    taught = [found for found in map(blocks, drawn(short.where(F.col("html").rlike("(?i)<(article|main)[\\s>]")))) if 2 <= len(found) <= longest and any(is_main(b.path) for b in found)]
    if not taught:
        words = [w for page in drawn(short) for b in blocks(page) for w in b.text.split(" ")[:100]]
        taught = [made(words, rng) for _ in range(sample // 2)] if words else []
    if not taught:
        return None
    learned = []
    for found in taught:
        for _ in range(2):
            both = augmented(found, rng)
            learned.append((Inputs([b for b, _ in both]), np.array([y for _, y in both], np.float32)))
    out = Labeller()
    out.learn(learned, rounds)
    return out


def main_texts(found: list[list[Block]], labeller: Labeller | None) -> list[str]:
    out = [""] * len(found)
    if labeller is None:  # no page has a word
        return out
    order = sorted((k for k, f in enumerate(found) if f), key=lambda k: len(found[k]))
    while order:
        take = max(1, min(len(order), 128, 60_000 // len(found[order[-1]])))
        part, order = order[-take:], order[:-take]
        for k, p in zip(part, labeller.label([Inputs(found[k]) for k in part]), strict=True):
            out[k] = "\n".join(b.text for b, y in zip(found[k], p, strict=True) if y >= 0.5)
    return out


def extracted(pages: DataFrame, labeller: Labeller | None = None, learn: bool = True) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    if labeller is None and learn:
        labeller = train(pages)
    spread = pages.sparkSession.sparkContext.broadcast(labeller)  # 60 KB of weights

    def run(batches):
        for batch in batches:
            texts: list[str] = []
            column = batch.column(2).to_pylist()
            for at in range(0, len(column), 512):
                root = Path(None, ())  # paths are shared by the pages of a portion
                texts += main_texts([blocks(p, root) for p in column[at : at + 512]], spread.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
