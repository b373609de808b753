"""Main text of web pages by wrappers that are inferred per host.

Pages of one host are generalised step by step into one union-free regular
expression over their element trees: children are aligned, mismatches become
optional, equal neighbours become repeated groups, and texts that differ become
slots.  The wrapper says where a host's article stands (the element that holds
most of the slots' text outside links), which of its groups are lists of links,
and which texts at which of its places are the template's.  A page is matched
against its wrapper, children against children, and read by what the wrapper
says at each place; one that doesn't fit is its own wrapper.

A block is the template's where all its texts are, at the places where they
stand: a value of a slot counts as such that four fifths of the pages have, or
nearly all pages that have an optional element.  So that copies of one article
are not taken for a template, nothing counts where such values would be the
greater part of the article's text.  Element names (nav, form and the like) say
what is never an article's; class, id and role words decide only for groups
that these rules leave open, by their last word (a "cookie-notice" is a notice,
a "notice-period" none), and never for nearly all of the text.

Wrappers are fitted on all pages.  A page's outline (the containers near its
root) says which template it comes from, in a fine and in a coarse form.  Each
page is reduced to its own expression; these are joined in buckets, then over
the buckets, for each fine outline, each coarse outline and each host.  A page
is read along the wrapper of its fine outline if at least SUPPORT pages have
it, else of its coarse one, else of its host.  Copies of a page count once.

Defined results: a null or empty html has the text ""; pages without ``://`` in
their URL, or with none, share one wrapper; repeated rows stay rows.  A text is
known as the template's only where SUPPORT pages show it, so a host of fewer
pages has none.  Elements nested deeper than MAX_DEPTH count as neighbours of
their parents; their texts and order stay.  An unclosed script or style reaches
to the page's end, as in browsers; an unclosed svg, object and the like to its
parent's.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import worker
from loomwork.plans import storage

#: Pages that must share a text before it counts as the template's, and an outline before it has its own wrapper.
SUPPORT = 5
#: Levels of elements in the fine and the coarse outline; body is the first.
FINE, COARSE = 4, 2
#: Tasks that the pages of one host may be dealt to, and outlines of a host that a task holds before it passes them on.
BUCKETS, HELD = 256, 1000
#: Texts longer than this are kept as digests in wrappers.
PLAIN = 32
#: Elements that are nested deeper become neighbours.
MAX_DEPTH = 200
#: Wrappers are broadcast if all of them have at most so many characters, else joined.
WRAPPERS_TO_SEND = 32 << 20
#: Characters of wrappers that a task keeps ready to read by.
READINGS = 8 << 20
#: Frequent values that a text's place keeps with the number of pages.
VALUES = 8
#: Share of pages that make a value the template's; share of text in links that makes a group a list of links; no group of more than this share of the text is left out for its names or links.
SHARE, LINKED, MOST = 0.8, 0.6, 0.9

# fixed sets of element names
RAW = {"script", "style", "textarea", "iframe", "head", "title"}
FOREIGN = {"svg", "math"}
HIDDEN = FOREIGN | {"noscript", "template", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CONTAINER = {"html", "body", "div", "section", "article", "main", "center", "table", "tbody", "tr", "td", "form"}
OUTLINE = CONTAINER | {"nav", "footer", "aside", "header"}
NEVER = {"nav", "footer", "aside", "form", "button", "select", "option", "input", "label", "menu", "dialog"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTS = {"ul", "ol", "dl", "menu", "div", "section", "table", "tbody", "tr", "td", "nav", "aside"}
#: Last words of class, id and role values that mark what is not the article, words that may follow them, and words that mark the article.
AWAY = frozenset("ad ads adv advert adverts advertisement advertising advertisements banner breadcrumb breadcrumbs byline comment comments commenting consent cookie cookies disqus disclaimer footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices alert alerts overlay pager pagination popup promo promos promotion recommended recommendations related reply replies respond response responses search share sharing sidebar sidebars side signup skip social sponsor sponsored sponsors subscribe subscription teaser teasers toolbar topbar widget widgets".split())
AFTER = frozenset("area articles bar block body box button buttons center column container content fixed form group holder icons inner info item items left link links list main media new outer panel placeholder posts right row section slot small sticky stories text this thread top bottom title unit wrap wrapper zone".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")
TOWARDS = re.compile(r"(?:^|[-_\s])(?:article\w*|body|content|entry\w*|main\w*|post\w*|story\w*|text)(?:$|[-_\s])", re.IGNORECASE)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
NAMED = re.compile(r"class|id|role", re.IGNORECASE)


class Node:
    """An element: tag, its class and id words, and children (nodes and texts)."""

    __slots__ = ("tag", "names", "kids")

    def __init__(self, tag: str, names: str):
        self.tag, self.names, self.kids = tag, names, []

    @property
    def sign(self) -> str:
        return f"{self.tag}.{self.names}" if self.names else self.tag


def parse(source: str) -> Node:
    """A tolerant element tree; scripts, styles, comments and the head are left out."""
    root = Node("html", "")
    stack, at, n = [root], 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            stack[-1].kids.append(source[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in ("html", "body"):
                continue
            # a closing tag without its opening is dropped; inline ones don't close blocks
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(source, at)
            at = end.end() if end else n if tag != "head" else at
            continue
        if tag == "html":
            continue
        if tag in BLOCK:  # a block ends an open paragraph and foreign content
            while stack[-1].tag in FOREIGN:
                stack.pop()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES.get(tag, {"p"}):
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        names = " ".join(_name(name.lower(), v or w or x) for name, v, w, x in ATTRIBUTE.findall(m[3]) if name.lower() in ("class", "id", "role")) if NAMED.search(m[3]) else ""
        node = Node(tag, names.strip())
        if tag not in HIDDEN:
            stack[-1].kids.append(node)
        if tag not in VOID and not m[3].endswith("/") and (len(stack) < MAX_DEPTH or tag in HIDDEN):
            stack.append(node)
    return root


def _name(attribute: str, value: str) -> str:
    """A class, id or role value without the numbers that tell single elements apart: all of an id's, those of three digits or more elsewhere."""
    return re.sub(r"\d+" if attribute == "id" else r"\d{3,}", "", value)


def marked(names: str, inside: bool) -> bool:
    """Whether a class, id or role word says that an element is not the article's. inside: it stands within an article, which may have a header."""
    for name in names.split():
        words = [w.lower() for w in WORDS.findall(name)]
        while len(words) > 1 and words[-1] in AFTER:
            words.pop()
        if words and words[-1] in AWAY and not (inside and words[-1] == "header"):
            return True
    return False


def away(tag: str, names: str, inside: bool) -> bool:
    """Whether an element is not part of an article, by its names alone."""
    return never(tag, names, inside) or bool(names and tag not in ("html", "body", "article", "main") and marked(names, inside))


def never(tag: str, names: str, inside: bool) -> bool:
    """Whether an element of this kind is never part of an article."""
    return tag in NEVER or (tag == "header" and not inside) or bool(tag == "article" and names and re.search(r"comment|repl", names, re.IGNORECASE))


class Expr:
    """A node of a wrapper: sign, quantifiers, children; for a text's place, its frequent values and on how many pages it has these, and any."""

    __slots__ = ("sign", "optional", "repeated", "kids", "values", "seen", "pages", "chars")

    def __init__(self, sign: str, kids: list["Expr"], text: str | None = None, chars: int = 0):
        self.sign, self.kids, self.chars = sign, kids, chars
        self.values: dict[str, int] = {} if text is None else {text: 1}
        self.optional = self.repeated = False
        self.pages = self.seen = 1

    @property
    def text(self) -> str | None:
        """The one value of a place that has no other; None for a slot."""
        return next(iter(self.values)) if len(self.values) == 1 and self.seen in self.values.values() else None

    def add(self, other: "Expr") -> None:
        """Counts of both places' values; only frequent ones stay (Misra-Gries), each count at most 1 / (VALUES + 1) of all too low."""
        for v, n in other.values.items():
            self.values[v] = self.values.get(v, 0) + n
        self.seen += other.seen
        if len(self.values) > VALUES:
            less = sorted(self.values.values(), reverse=True)[VALUES]
            self.values = {v: n - less for v, n in self.values.items() if n > less}


TEXT = "#text"


def mark(text: str) -> str:
    """A text as wrappers hold it."""
    return text if len(text) <= PLAIN else f"\0{len(text)}:" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def length(value: str) -> int:
    """Characters of the text of a mark."""
    return int(value[1:].partition(":")[0]) if value.startswith("\0") else len(value)


def _number(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def outlines(root: Node) -> tuple[int, int]:
    """Hashes of a page's fine and coarse outline: the paths of its containers, each once; what an article holds is content."""
    found: dict[str, int] = {}
    todo = [(root, "", 0)]
    while todo:
        node, path, depth = todo.pop()
        for k in node.kids:
            if not isinstance(k, str) and k.tag in OUTLINE:
                at = f"{path}>{k.sign}"
                found[at] = depth + 1
                if depth + 1 < FINE and k.tag != "article":
                    todo.append((k, at, depth + 1))
    fine, coarse = ("\n".join(sorted(at for at, d in found.items() if d <= most)).encode("utf-8", "surrogatepass") for most in (FINE, COARSE))
    return _number(fine), _number(coarse)


def express(node: Node) -> Expr:
    """The wrapper of one page; each place and value counts once."""
    out = _expressed(node)
    todo = [out]
    while todo:
        e = todo.pop()
        e.pages = e.seen = 1
        e.values = dict.fromkeys(e.values, 1)
        todo += e.kids
    return out


def _expressed(node: Node) -> Expr:
    kids = []
    for k in node.kids:
        if isinstance(k, str):
            if t := " ".join(entities.unescape(k).split()):
                kids.append(Expr(TEXT, [], mark(t), len(t)))
        elif k.tag != "br":
            kids.append(_expressed(k))
    return Expr(node.sign, fold(kids))


def fold(kids: list[Expr]) -> list[Expr]:
    """Neighbouring equal runs of up to three children become one repeated run."""
    for size in (1, 2, 3):
        out: list[Expr] = []
        for k in kids:
            out.append(k)
            if len(out) >= 2 * size and all(a.sign == b.sign and a.sign != TEXT for a, b in zip(out[-2 * size : -size], out[-size:])):
                for a, b in zip(out[-2 * size : -size], out[-size:]):
                    join(a, b)
                    a.repeated = True
                    a.pages -= b.pages
                del out[-size:]
        kids = out
    return kids


def pack(e: Expr) -> str:
    """A wrapper as JSON, parents before children."""
    out: list = []
    todo = [e]
    while todo:
        x = todo.pop()
        out += (x.sign, sorted(x.values.items()), x.optional + 2 * x.repeated, x.pages, x.seen, x.chars, len(x.kids))
        todo.extend(reversed(x.kids))
    return json.dumps(out)


def unpack(packed: str) -> Expr:
    """The wrapper of pack()."""
    parts = iter(json.loads(packed))

    def read() -> Expr:
        sign, values, flags, pages, seen, chars, n = (next(parts) for _ in range(7))
        e = Expr(sign, [], None, chars)
        e.values, e.optional, e.repeated, e.pages, e.seen = dict(values), bool(flags & 1), bool(flags & 2), pages, seen
        e.kids = [read() for _ in range(n)]
        return e

    return read()


def join(a: Expr, b: Expr) -> Expr:
    """a becomes the union-free generalisation of both."""
    a.optional |= b.optional
    a.repeated |= b.repeated
    a.pages += b.pages
    a.chars += b.chars
    if a.sign == TEXT:
        a.add(b)
    else:
        a.kids = fold(_aligned(a.kids, b.kids))
    return a


def _suffixes(a: list[str], b: list[str]):
    """A function of (i, j): length of the longest common subsequence of a[i:] and b[j:].

    Rows are bits: bit j of row i says that the length falls from j to j + 1.
    Every k-th row is kept, the rows between are made again when i gets there,
    so 2 * sqrt(len(a)) rows are held at a time.
    """
    n, m = len(a), len(b)
    full, k = (1 << m) - 1, max(1, int(n**0.5))
    where: dict[str, int] = {}
    for j, sign in enumerate(reversed(b)):
        where[sign] = where.get(sign, 0) | (1 << j)

    def before(row: int, i: int) -> int:
        # Hyyrö's step; zero bits mark where the length grows, from b's end
        both = row & where.get(a[i], 0)
        return ((row + both) | (row - both)) & full

    kept, row = {n: full}, full
    for i in range(n - 1, -1, -1):
        row = before(row, i)
        if i % k == 0:
            kept[i] = row
    held: dict[int, int] = {}

    def length(i: int, j: int) -> int:
        if i not in held:
            held.clear()
            low = i // k * k
            top = min(low + k, n)
            held[top] = kept[top]
            for x in range(top - 1, low - 1, -1):
                held[x] = before(held[x + 1], x)
        size = m - j
        return size - (held[i] & ((1 << size) - 1)).bit_count()

    return length


def _aligned(a: list[Expr], b: list[Expr]) -> list[Expr]:
    """Both sequences' children in one, by their longest common subsequence of signs."""
    n, m = len(a), len(b)
    out, i, j, length = [], 0, 0, None
    while i < n or j < m:
        if i < n and j < m and a[i].sign == b[j].sign:
            out.append(join(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        if length is None and i < n and j < m:  # what both begin with needs none
            at_a, at_b = i, j
            length = _suffixes([x.sign for x in a[i:]], [x.sign for x in b[j:]])
        if j >= m or (i < n and length(i + 1 - at_a, j - at_b) >= length(i - at_a, j + 1 - at_b)):
            a[i].optional = True
            out.append(a[i])
            i += 1
        else:
            b[j].optional = True
            out.append(b[j])
            j += 1
    return out


def _tag(sign: str) -> tuple[str, str]:
    tag, _, names = sign.partition(".")
    return tag, names


def _volume(e: Expr, inside: bool) -> int:
    """Characters in slots below e that may be an article's: outside links and elements that never are."""
    if e.sign == TEXT:
        return 0 if e.seen >= SUPPORT and e.text is not None else e.chars
    tag, names = _tag(e.sign)
    if tag == "a" or never(tag, names, inside):
        return 0
    inside = inside or tag in ("article", "main")
    return sum(_volume(k, inside) for k in e.kids)


def _chars(e: Expr, linked: bool = False) -> tuple[int, int]:
    """All characters below e, and those in links."""
    if e.sign == TEXT:
        return e.chars, e.chars if linked else 0
    linked = linked or _tag(e.sign)[0] == "a"
    return tuple(map(sum, zip((0, 0), *(_chars(k, linked) for k in e.kids))))


def _left_out(e: Expr, inside: bool, volume: int, chars: int) -> bool:
    """Whether a group of the wrapper is not the article's; volume and chars: those of what holds it."""
    tag, names = _tag(e.sign)
    if never(tag, names, inside):
        return True
    if tag in LISTS and not inside:
        whole, linked = _chars(e)
        if whole and linked >= LINKED * whole and whole <= MOST * chars:
            return True
    # names decide where structure doesn't, but not for nearly all of the text
    return away(tag, names, inside) and _volume(e, inside) <= MOST * volume


def region(wrapper: Expr) -> list[int]:
    """Places, from the root's child on, that lead to the element that holds the article."""
    path, now, inside = [], wrapper, False
    while True:
        tag, _ = _tag(now.sign)
        inside = inside or tag in ("article", "main")
        if tag == "article":
            return path
        total, chars = _volume(now, inside), _chars(now)[0]
        volumes = [0 if k.sign != TEXT and _left_out(k, inside, total, chars) else _volume(k, inside) for k in now.kids]
        total = sum(volumes)
        kids = [(volumes[i], -i) for i, k in enumerate(now.kids) if k.sign != TEXT and _tag(k.sign)[0] in CONTAINER]
        if not kids or not total:
            return path
        volume, i = max(kids)
        k = now.kids[-i]
        name = _tag(k.sign)
        sure = name[0] in ("article", "main") or bool(TOWARDS.search(name[1]))
        titled = any(_tag(x.sign)[0] == "h1" and _volume(x, inside) for x in now.kids)
        if k.repeated or volume < (0.5 if sure else 0.7) * total or (titled and not sure) or not any(x.sign != TEXT and _tag(x.sign)[0] in BLOCK for x in k.kids):
            return path
        path.append(-i)
        now = k


def read_off(wrapper: Expr) -> dict:
    """How pages of a wrapper are read: the way to the article, by (signs, repeated, place) at each step, and the article's places.

    A place is [sign, repeated, whether it is left out, places within it], for
    a text the values that are the template's.
    """
    way, now, inside = [], wrapper, False
    for i in region(wrapper):
        inside = inside or _tag(now.sign)[0] in ("article", "main")
        way.append([[k.sign for k in now.kids], [k.repeated for k in now.kids], i])
        now = now.kids[i]
    inside = inside or _tag(now.sign)[0] in ("article", "main")
    total, whole = _volume(now, inside), _chars(now)[0]
    chars, known = 0, 0

    def walk(e: Expr, inside: bool, optional: bool, repeated: bool, heading: bool) -> list:
        nonlocal chars, known
        if e.sign == TEXT:
            chars += e.chars
            most = wrapper.pages
            if (optional or e.optional) and not (repeated or e.repeated or heading):
                most = min(most, e.seen)
            own = [v for v, n in e.values.items() if n >= SUPPORT and n >= SHARE * most]
            known += sum(e.values[v] * length(v) for v in own)
            return [TEXT, e.repeated, False, own]
        tag, _ = _tag(e.sign)
        out = e is not now and _left_out(e, inside, total, whole)
        kids = [] if out else [walk(k, inside or tag in ("article", "main"), optional or e.optional, repeated or (e.repeated and e is not now), heading or tag in HEADINGS) for k in e.kids]
        return [e.sign, e.repeated, out, kids]

    places = walk(now, inside, False, False, False)
    # the greater part of the text would be the template's: rather, most pages are copies of one article
    return {"way": way, "inside": inside, "places": places, "use": total > 0 and 2 * known <= chars}


class Places:
    """The places within one of a wrapper's, to be matched with a page's children."""

    __slots__ = ("left_out", "repeated", "kids", "values", "where")

    def __init__(self, place: list, use: bool = True):
        sign, self.repeated, self.left_out, more = place
        self.values = set(more) if sign == TEXT and use else set()
        self.kids = [] if sign == TEXT else [Places(k, use) for k in more]
        self.where: dict[str, list[int]] = {}
        if sign != TEXT:
            for i, k in enumerate(more):
                self.where.setdefault(k[0], []).append(i)


def match(signs: list[str], where: dict[str, list[int]], repeated: list[bool]) -> list[int | None]:
    """Which of a wrapper's children each of a page's is: the next one of its sign, or in a repeated group the last one."""
    out: list[int | None] = []
    ahead = 0
    for sign in signs:
        at = where.get(sign)
        if at is None:
            out.append(None)
            continue
        i = bisect.bisect_left(at, ahead)
        place = at[i] if i < len(at) else at[-1]
        out.append(place)
        ahead = place if repeated[place] else place + 1
    return out


class Reading:
    """read_off()'s result, ready to read pages by."""

    def __init__(self, read: dict):
        self.inside, self.top = read["inside"], Places(read["places"], read["use"])
        self.way = []
        for signs, repeated, place in read["way"]:
            where: dict[str, list[int]] = {}
            for i, sign in enumerate(signs):
                where.setdefault(sign, []).append(i)
            self.way.append((where, repeated, place))

    def locate(self, root: Node) -> Node | None:
        """The element of a page that stands where the wrapper has the article."""
        now = root
        for where, repeated, place in self.way:
            kids = [k for k in now.kids if not blank(k)]
            fit = [k for k, at in zip(kids, match([_sign(k) for k in kids], where, repeated)) if at == place]
            if not fit:
                return None
            now = fit[0] if len(fit) == 1 else max(fit, key=_size)
        return now


def blank(k) -> bool:
    """Whether a child has no part in wrappers."""
    return not entities.unescape(k).strip() if isinstance(k, str) else k.tag == "br"


def _sign(k) -> str:
    return TEXT if isinstance(k, str) else k.sign


def infer(pages: list[str]) -> dict:
    """read_off() of the wrapper of some pages."""
    wrapper = None
    for source in pages:
        e = express(parse(source))
        wrapper = e if wrapper is None else join(wrapper, e)
    return read_off(wrapper if wrapper is not None else Expr("html", []))


def constants(read: dict) -> list[str]:
    """The template's texts within the article, of read_off()'s result."""
    out, todo = [], [read["places"]]
    while todo:
        sign, _, _, more = todo.pop()
        if sign == TEXT:
            out += more
        else:
            todo += reversed(more)
    return out if read["use"] else []


def _size(node: Node) -> int:
    return sum(len(k) if isinstance(k, str) else _size(k) for k in node.kids)


def blocks(node: Node, places: Places | None, inside: bool) -> list[str]:
    """The texts of node's blocks in page order, without what is not the article's; places: what the wrapper has there."""
    out: list[str] = []
    held: list[str] = []
    own = False  # whether a text of the block is the page's own

    def flush() -> None:
        nonlocal own
        if own and (t := " ".join(entities.unescape("".join(held)).split())):
            out.append(t)
        held.clear()
        own = False

    todo: list = [(node, places, inside, True)]
    while todo:
        x, at, within, first = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
            if not own and not blank(x):
                own = at is None or not at.values or mark(" ".join(entities.unescape(x).split())) not in at.values
        elif x.tag == "br":
            held.append(" ")
        elif first or not (at.left_out if at is not None else away(x.tag, x.names, within)):
            within = within or x.tag in ("article", "main")
            if x.tag in BLOCK:
                flush()
                todo.append((None, None, within, False))
            if at is None or not at.kids:
                todo.extend((k, None, within, False) for k in reversed(x.kids))
            else:
                real = [i for i, k in enumerate(x.kids) if not blank(k)]
                found = dict(zip(real, match([_sign(x.kids[i]) for i in real], at.where, [k.repeated for k in at.kids])))
                for i in range(len(x.kids) - 1, -1, -1):
                    place = found.get(i)
                    todo.append((x.kids[i], at.kids[place] if place is not None else None, within, False))
    flush()
    return out


def extract(source: str | None, reading: Reading | None) -> str:
    """The main text of a page along its host's wrapper."""
    if not source:
        return ""
    root = parse(source)
    node = reading.locate(root) if reading is not None else None
    found = blocks(node, reading.top, reading.inside) if node is not None else []
    if not found:
        # the page doesn't fit, or has nothing there
        own = Reading(read_off(express(root)))
        node = own.locate(root) or root
        found = blocks(node, own.top, own.inside)
    return "\n".join(found)


def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)), F.lit(""))


def _described(batches):
    """Each page's (host, digest, fine and coarse outline, expression); batches: host, html."""
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            out = []
            for source in part.column(1).to_pylist():
                root = parse(source)
                out.append((_number(source.encode("utf-8", "surrogatepass")), *outlines(root), pack(express(root))))
            digest, fine, coarse, expr = zip(*out)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (digest, fine, coarse)), pa.array(expr, pa.string())], names=["host", "digest", "fine", "coarse", "expr"])


#: Partial wrappers: level 2 is of a fine outline, whose coarse one is up; 1 of a coarse outline; 0 of a host.
_PARTS = pa.schema([("host", pa.string()), ("level", pa.int64()), ("key", pa.int64()), ("up", pa.int64()), ("expr", pa.string())])


def _joined(batches):
    """Partial wrappers of pages that come by host and digest; copies count once."""
    fine: dict[int, tuple[int, Expr]] = {}
    host = digest = None

    def parts():
        out, coarse, whole = [], {}, None
        for key, (up, e) in sorted(fine.items(), key=lambda x: x[0]):
            out.append((host, 2, key, up, pack(e)))
            coarse[up] = join(coarse[up], e) if up in coarse else e
        for key, e in sorted(coarse.items(), key=lambda x: x[0]):
            out.append((host, 1, key, 0, pack(e)))
            whole = join(whole, e) if whole else e
        if whole:
            out.append((host, 0, 0, 0, pack(whole)))
        fine.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _PARTS)], schema=_PARTS)

    for batch in batches:
        for h, d, key, up, expr in zip(*(c.to_pylist() for c in batch.columns)):
            if fine and (h != host or len(fine) >= HELD):
                yield parts()
            if (h, d) == (host, digest):
                continue
            host, digest = h, d
            e = unpack(expr)
            fine[key] = (up, join(fine[key][1], e) if key in fine else e)
    if fine:
        yield parts()


_LEARNED = pa.schema([("host", pa.string()), ("level", pa.int64()), ("key", pa.int64()), ("up", pa.int64()), ("pages", pa.int64()), ("wrapper", pa.string())])


def _learned(batches):
    """What whole wrappers say, from partial ones that come by host, level and key."""
    now, whole, out = None, None, []

    def line():
        return (*now, whole.pages, json.dumps(read_off(whole)))

    def ready():
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _LEARNED)], schema=_LEARNED)

    for batch in batches:
        for *key, expr in zip(*(c.to_pylist() for c in batch.columns)):
            if whole and key != now:
                out.append(line())
                whole = None
                if len(out) >= 500:
                    yield ready()
                    out.clear()
            now = key
            whole = join(whole, unpack(expr)) if whole else unpack(expr)
    if whole:
        out.append(line())
    if out:
        yield ready()


def wrappers(pages: DataFrame) -> DataFrame:
    """host, key (a fine outline), wrapper (JSON of path and constants) of every outline of pages (url, html)."""
    described = pages.where("html <> ''").select(_host().alias("host"), "html").mapInArrow(_described, "host string, digest long, fine long, coarse long, expr string")
    parts = described.repartition("host", F.pmod("digest", F.lit(BUCKETS))).sortWithinPartitions("host", "digest").mapInArrow(_joined, "host string, level long, key long, up long, expr string")
    learned = storage.written(parts.repartition("host", "level", "key").sortWithinPartitions("host", "level", "key", "up", "expr").mapInArrow(_learned, "host string, level long, key long, up long, pages long, wrapper string"), "learned")
    fine = learned.where("level = 2").select("host", "key", "up", F.when(F.col("pages") >= SUPPORT, F.col("wrapper")).alias("fine"))
    coarse = learned.where(f"level = 1 and pages >= {SUPPORT}").select("host", F.col("key").alias("up"), F.col("wrapper").alias("coarse"))
    whole = learned.where("level = 0").select("host", F.col("wrapper").alias("whole"))
    known = fine.join(coarse, ["host", "up"], "left").join(whole, "host").select("host", "key", F.coalesce("fine", "coarse", "whole").alias("wrapper"))
    known = storage.written(known, "wrappers")
    storage.drop(learned)
    return known


def _keyed(batches):
    """Rows with their fine outline; batches: page_id, url, html, host."""
    for batch in batches:
        keys = [outlines(parse(source))[0] if source else None for i in range(0, batch.num_rows, 500) for source in batch.column(2).slice(i, 500).to_pylist()]
        yield batch.append_column("key", pa.array(keys, pa.int64()))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    worker.small_batches(pages.sparkSession)
    known = wrappers(rows)
    size = known.agg(F.coalesce(F.sum(F.char_length("wrapper") + F.char_length("host")), F.lit(0))).first()[0]
    known = F.broadcast(known) if size <= WRAPPERS_TO_SEND else known
    keyed = rows.withColumn("host", _host()).mapInArrow(_keyed, "page_id long, url string, html string, host string, key long")
    lines = keyed.join(known, ["host", "key"], "left").select("page_id", "url", "html", "wrapper")

    def run(batches):
        read: dict[str, Reading] = {}
        held = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                out = []
                for source, w in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if w is not None and w not in read:
                        if held + len(w) > READINGS:
                            read.clear()
                            held = 0
                        read[w] = Reading(json.loads(w))
                        held += len(w)
                    out.append(extract(source, read[w] if w is not None else None))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return lines.mapInArrow(run, "page_id long, url string, text string, n_chars long")
