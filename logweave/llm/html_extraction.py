"""HTML main-text extraction with wrappers inferred per host.

Every page's tree becomes a union-free regular expression: elements, groups that are optional or
repeated, fixed text and text slots.  Pages of a host are aligned one after the other: text that
differs becomes a slot, elements that one side lacks become optional, runs of alike elements
become one repeated element.  A host's pages are dealt by their content into parts of bounded size,
each part is aligned in one task, and the parts' wrappers are merged in a tree, in an order that
doesn't depend on how the rows lie.  The wrapper says where the host keeps its main text (the
element whose slots hold most of it) and which texts there are the template's; tags (article, main)
decide for hosts of too few pages only.
"""

from __future__ import annotations

import bisect
import functools
import html as html_lib
import json
import re
from urllib.parse import urlsplit

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

#: Wrappers are broadcast up to this many characters in all, else joined by host.
BROADCAST_CHARS = 8 << 20
#: Pages that one part of a host has on average; parts that one step of the tree merges.
PART_PAGES, FAN_IN = 500, 32
#: Fixed text of a host counts as its template's from this many different pages on.
MIN_PAGES = 5
# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object canvas".split())
DROPPED = RAW | frozenset("head nav header footer aside form button select option dialog menu label fieldset".split())
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body", "dd", "dt", "li"} | {"nav", "header", "footer", "aside", "form"}
LABELS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer footer header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
# Words that say what a labelled part looks like, not what it is about.
FORMS = frozenset("area articles bar block body bottom box button buttons column container content footer form group header holder icon icons inner item items left link links list main mobile module outer panel posts primary region right row secondary section slot stories text this title top unit wrap wrapper zone".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|([^<]+)|<", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# The same where a quote never ends.
_TOKEN_PLAIN = re.compile(_TOKEN.pattern.replace(r"""((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)""", "([^>]*)"), re.S)
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
#: Repeated groups of these hold records: a value that all pages have among others is a value, no template text.
RECORDS = frozenset("li dd dt tr td th".split())
_NESTED = frozenset("li dd dt tr td th option p".split())
#: An element beside the one that holds most of the main text is main text too from this share of its text on.
BESIDE = 0.2
#: Longer lists of children are aligned by the first element of each kind.
LONG_LIST = 250
#: Elements nested deeper than this are kept as children of the deepest one, as browsers do.
MAX_DEPTH = 200


class Node:
    """An element or a text. Of an element: name, key (name and class), whether a label says it is
    no main text, children; ``many`` and ``maybe`` for repeated and optional groups of a wrapper.
    Of a text: ``fixed``, hashes of the texts that all pages have there, each with marks of these pages."""

    __slots__ = ("name", "key", "off", "kids", "text", "many", "maybe", "pages", "chars", "fixed")

    def __init__(self, name, key="", off=False, text=None):
        self.name, self.key, self.off, self.text = name, key or name, off, text
        self.kids, self.many, self.maybe, self.pages, self.chars, self.fixed = [], False, False, 1, 0, {}


@functools.lru_cache(100_000)
def _labelled(label: str) -> bool:
    """Whether a class, id or role names a part that is no main text: a label as its last word, or followed by
    words of form alone (ad-slot, comment-list, but not notice-board or related-work)."""
    for token in label.lower().split():
        words = [w for w in re.split(r"[-_\d]+", token) if w]
        at = max((i for i, w in enumerate(words) if w in LABELS), default=-1)
        if at >= 0 and all(w in FORMS for w in words[at + 1 :]):
            return True
    return False


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(text)}


def _shape(node: Node) -> None:
    """Divisions without a class are told apart by what they begin with."""
    for x in node.kids:
        if x.name != "#":
            _shape(x)
    if node.key in ("div", "section"):
        first = next((x for x in node.kids if x.name != "#" or not x.text.isspace()), None)
        if first is not None:
            node.key = f"{node.key}({first.name})"


def parse(text: str | None) -> Node:
    """The tree of a page; unclosed and misnested elements are closed as browsers do. A tag that never ends
    takes the rest of the page with it; once a quote in a tag never ends, tags end at the next ">"."""
    root = Node("#root")
    stack, at, source = [root], 0, text or ""
    deeper: dict[str, int] = {}
    last, token = source.rfind(">"), _TOKEN
    while at < len(source):
        if at > last and source[at] == "<" and source[at + 1 : at + 2].isalpha():
            break
        m = token.match(source, at) if at <= last or source[at] != "<" else None
        if m is not None and m.group() == "<" and source[at + 1 : at + 2].isalpha():
            token = _TOKEN_PLAIN
            m = token.match(source, at)
        if m is None:  # no tag ends after here
            closing, name, attrs, words, at = "", None, "", source[at:], len(source)
        else:
            at = m.end()
            closing, name, attrs, words = m.groups()
            if name is None and words is None:
                if m.group() != "<":
                    continue
                words = "<"
        if name is None:
            kids = stack[-1].kids
            if kids and kids[-1].name == "#":
                kids[-1].text += words
            else:
                kids.append(Node("#", text=words))
            continue
        name = name.lower()
        if closing:
            if deeper.get(name):
                deeper[name] -= 1
            elif any(x.name == name for x in stack[1:]):
                while stack.pop().name != name:
                    pass
            continue
        if name in CLOSES_P and any(x.name == "p" for x in stack):
            k = max(i for i, x in enumerate(stack) if x.name == "p")
            if not any(x.name in ("div", "table", "article", "section", "li", "td") for x in stack[k + 1 :]):
                del stack[k:]
        if name in _NESTED and name != "p":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in ("ul", "ol", "dl", "table", "select"):
                    break
                if stack[i].name == name or (name in ("td", "th") and stack[i].name in ("td", "th")) or (name in ("dd", "dt") and stack[i].name in ("dd", "dt")):
                    del stack[i:]
                    break
        key, off = name, name in DROPPED
        if attrs and not attrs.isspace():
            found = _attributes(attrs)
            if found.get("class"):
                key = f"{name}.{found['class']}"
            if not off:
                off = "hidden" in found or found.get("aria-hidden") == "true" or bool(_HIDDEN.search(found.get("style", "")))
                off = off or (name not in ("html", "body", "main", "article") and any(_labelled(found[k]) for k in ("class", "id", "role") if found.get(k)))
        node = Node(name, key, off)
        stack[-1].kids.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif name not in VOID and not attrs.endswith("/"):
            if len(stack) < MAX_DEPTH:
                stack.append(node)
            else:
                deeper[name] = deeper.get(name, 0) + 1
    _shape(root)
    return root


def _clean(text: str) -> str:
    return " ".join((html_lib.unescape(text) if "&" in text else text).split())


# --- wrappers -------------------------------------------------------------------------------


def _fold(kids: list[Node], one_page: int = 0) -> list[Node]:
    """Runs of alike groups (up to four elements long) as one repeated group's elements."""
    for size in (1, 2, 3, 4):
        out, i = [], 0
        while i < len(kids):
            group = kids[i : i + size]
            keys = [x.key for x in group]
            n = 1
            while len(group) == size and keys == [x.key for x in kids[i + n * size : i + (n + 1) * size]]:
                n += 1
            if n > 1:
                for k in range(size):
                    one = group[k]
                    for r in range(1, n):
                        one = _align(one, kids[i + r * size + k], 2 if one_page and one.name in RECORDS else one_page)
                    one.many, one.pages = True, max(x.pages for x in kids[i : i + n * size])
                    out.append(one)
                i += n * size
            else:
                out.append(kids[i])
                i += 1
        kids = out
    return kids


def mark_of(page: str | None) -> int:
    return xxhash.xxh3_64_intdigest((page or "").encode("utf-8", "surrogatepass"))


def marks(*sides: list[int]) -> list[int]:
    """MIN_PAGES marks of different pages, the least ones, or all if fewer."""
    return sorted(set().union(*sides))[:MIN_PAGES]


def template(node: Node, mark: int = 0) -> Node:
    """The regular expression of one page's tree."""
    if node.name == "#":
        node.text, node.key = _clean(node.text), "#"
        node.chars, node.fixed = len(node.text), {mark_of(node.text): [mark]}
        return node
    kids = [template(x, mark) for x in node.kids]
    node.kids = _fold([x for x in kids if x.name != "#" or x.text], 1)
    return node


def _align(a: Node, b: Node, one_page: int = 0) -> Node:
    """Both sides in one: mismatching text becomes a slot (text None), elements of one side optional.
    A repeated group of one page (1) has the fixed texts of all its members; two pages, and records of
    one page (2), have those of both sides."""
    out = Node(a.name, a.key, a.off and b.off)
    out.many, out.maybe, out.pages, out.chars = a.many or b.many, a.maybe or b.maybe, max(a.pages, b.pages) if one_page else a.pages + b.pages, a.chars + b.chars
    if a.name == "#":
        out.text = a.text if a.text == b.text else None
        if one_page == 1:
            out.fixed = a.fixed  # a goes, so a long run doesn't copy it again and again
            for t, m in b.fixed.items():
                out.fixed[t] = marks(out.fixed[t], m) if t in out.fixed else m
        else:
            out.fixed = {t: marks(a.fixed[t], b.fixed[t]) for t in sorted(a.fixed.keys() & b.fixed.keys())}
        return out
    x, y = a.kids, b.kids
    if len(x) > LONG_LIST or len(y) > LONG_LIST:
        x, y = _kinds(x, one_page), _kinds(y, one_page)
        out.kids = _fold([z for pair in _in_order(x, y) for z in _joined(*pair, one_page)], one_page)
        return out
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i].key == y[j].key else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    kids = []
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i].key == y[j].key:
            kids.append(_align(x[i], y[j], one_page))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
            x[i].maybe = True
            kids.append(x[i])
            i += 1
        else:
            y[j].maybe = True
            kids.append(y[j])
            j += 1
    out.kids = _fold(kids, one_page)
    return out


def _kinds(kids: list[Node], one_page: int) -> list[Node]:
    """One repeated element of each kind, in the order of their first ones."""
    first: dict[str, Node] = {}
    for x in kids:
        if x.key in first:
            first[x.key] = _align(first[x.key], x, 2 if one_page and x.name in RECORDS else one_page or 1)
            first[x.key].many = True
        else:
            first[x.key] = x
    return list(first.values())


def _in_order(x: list[Node], y: list[Node]):
    """(element of x or None, element of y or None) of two lists without repeated kinds: a longest common
    subsequence, which is a longest increasing run of places, meets; the others stay alone."""
    place = {n.key: i for i, n in enumerate(x)}
    both = [(place[n.key], j) for j, n in enumerate(y) if n.key in place]
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (i, _) in enumerate(both):
        n = bisect.bisect_left(ends, i)
        before.append(at[n - 1] if n else -1)
        if n == len(ends):
            ends.append(i)
            at.append(k)
        else:
            ends[n], at[n] = i, k
    met, k = [], at[-1] if at else -1
    while k >= 0:
        met.append(both[k])
        k = before[k]
    i = j = 0
    for a, b in [*reversed(met), (len(x), len(y))]:
        yield from ((n, None) for n in x[i:a])
        yield from ((None, n) for n in y[j:b])
        if a < len(x) and b < len(y):
            yield x[a], y[b]
        i, j = a + 1, b + 1


def _joined(a: Node | None, b: Node | None, one_page: int) -> list[Node]:
    if a is not None and b is not None:
        return [_align(a, b, one_page)]
    alone = a if a is not None else b
    alone.maybe = True
    return [alone]


def dump(node: Node) -> list:
    if node.name == "#":
        return ["#", node.text, node.pages, node.chars, node.fixed]
    return [node.key, int(node.off) | 2 * node.many | 4 * node.maybe, node.pages, [dump(x) for x in node.kids]]


def load(data: list) -> Node:
    if data[0] == "#":
        node = Node("#", text=data[1])
        node.pages, node.chars, node.fixed = data[2], data[3], {int(k): v for k, v in data[4].items()}
        return node
    node = Node(re.split(r"[.(]", data[0])[0], data[0], bool(data[1] & 1))
    node.many, node.maybe, node.pages = bool(data[1] & 2), bool(data[1] & 4), data[2]
    node.kids = [load(x) for x in data[3]]
    return node


def _template_texts(node: Node) -> list[int]:
    """Hashes of the texts of a wrapper's text node that enough different pages have."""
    return [t for t, m in node.fixed.items() if len(m) >= MIN_PAGES]


def _mass(node: Node, linked: bool = False) -> int:
    """Characters of text outside links and labelled parts; a text that is the template's has none."""
    if node.name == "#":
        return 0 if linked or (node.text is not None and _template_texts(node)) else node.chars
    if node.off:
        return 0
    return sum(_mass(x, linked or node.name == "a") for x in node.kids)


def _chars(node: Node) -> int:
    """Characters of text outside labelled parts."""
    return node.chars if node.name == "#" else 0 if node.off else sum(map(_chars, node.kids))


def rule(wrapper: Node) -> dict:
    """Where the main text is: ``places``, the paths (keys from the root on) of the element that
    holds most of it and of those beside it that hold text rather than links, and a share of it;
    ``fixed``, by path the hashes of the template's texts there."""
    node, path, places = wrapper, [], []
    while True:
        kids = [x for x in node.kids if x.name != "#" and not x.off]
        total = _mass(node)
        top = max(kids, key=_mass, default=None)
        if top is None or top.many or top.name not in BLOCK or total == 0 or _mass(top) < 0.7 * total:
            break
        if top.name in ("p", "pre", "li", "td", "blockquote") or re.fullmatch("h[1-6]", top.name):
            break
        if any(x.key == top.key for x in kids if x is not top):
            break  # the path would not tell them apart
        places += [[*path, x.key] for x in node.kids if x is not top and not x.off and 2 * _mass(x) > _chars(x) and _mass(x) >= BESIDE * _mass(top)]
        path = [*path, top.key]
        node = top
    places.append(path)
    fixed: dict[str, set[int]] = {}
    slots = 0

    def texts(x: Node, at: list[str]) -> None:
        nonlocal slots
        if x.name == "#":
            slots += x.text is None
            fixed.setdefault("\n".join(at), set()).update(_template_texts(x))
        elif not x.off:
            for y in x.kids:
                texts(y, [*at, y.key] if y.name != "#" else at)

    texts(wrapper, [])
    return {"places": places, "fixed": {k: sorted(v) for k, v in fixed.items() if v} if slots else {}}


# --- extraction ------------------------------------------------------------------------------


def _blocks(node: Node, out: list[list[tuple[str, bool]]], fixed: dict, at: str, places: set[str] | None = None) -> None:
    """Texts of ``node`` in page order, each with whether it is the template's; each block element
    starts a new list.  With ``places`` only what is in these paths counts."""
    for x in node.kids:
        if x.name == "#":
            if places is None or (f"{at}\n#" if at else "#") in places:
                out[-1].append((x.text, at in fixed and mark_of(_clean(x.text)) in fixed[at]))
            continue
        path = f"{at}\n{x.key}" if at else x.key
        inside = None if places is None or path in places else places
        if x.off:
            if x.name in CLOSES_P or x.name in BLOCK:
                out.append([])
        elif x.name == "br":
            out[-1].append((" ", True))
        elif x.name in BLOCK:
            out.append([])
            _blocks(x, out, fixed, path, inside)
            out.append([])
        else:
            _blocks(x, out, fixed, path, inside)


def _outermost(node: Node, names: tuple[str, ...]) -> list[Node]:
    if node.off:
        return []
    if node.name in names:
        return [node]
    return [y for x in node.kids if x.name != "#" for y in _outermost(x, names)]


def _has(node: Node, path: list[str]) -> bool:
    return not path or any(x.key == path[0] and not x.off and _has(x, path[1:]) for x in node.kids)


def extract(page: str | None, rules: dict | None = None) -> str:
    """Main text of a page under its host's rule: what is in the rule's places, without blocks that are
    the template's.  A page that the rule doesn't fit, or without one, is judged by its own tree."""
    root = parse(page)
    lists: list[list[tuple[str, bool]]] = [[]]
    if rules and _has(root, rules["places"][-1]):
        _blocks(root, lists, {k: set(v) for k, v in rules["fixed"].items()}, "", None if [] in rules["places"] else {"\n".join(x) for x in rules["places"]})
    if not any(t.strip() for x in lists for t, _ in x):
        places = _outermost(root, ("article",)) or _outermost(root, ("main",))
        if not places:
            node = root
            for key in rule(template(parse(page)))["places"][-1]:
                node = next((x for x in node.kids if x.key == key and not x.off), node)
            places = [node]
        for place in places:
            lists.append([])
            _blocks(place, lists, {}, "")
    blocks = (_clean("".join(t for t, _ in x)) for x in lists if not all(f or not t.strip() for t, f in x))
    return "\n\n".join(b for b in blocks if b)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _infer(pdf: pd.DataFrame) -> pd.DataFrame:
    """The wrapper of one part of a host; pages that repeat another's bytes count once."""
    pages = {mark_of(page): page for page in pdf["html"]}
    node = None
    for mark in sorted(pages):
        one = template(parse(pages[mark]), mark)
        node = one if node is None else _align(node, one)
    return pd.DataFrame([(pdf["host"].iloc[0], pdf["part"].iloc[0], json.dumps(dump(node)), json.dumps(marks([*pages])))], columns=["host", "part", "wrapper", "marks"])


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("part")
    node = None
    for x in pdf["wrapper"]:
        one = load(json.loads(x))
        node = one if node is None else _align(node, one)
    several = marks(*map(json.loads, pdf["marks"]))
    decided = json.dumps(rule(node)) if len(several) >= MIN_PAGES else None
    return pd.DataFrame([(pdf["host"].iloc[0], pdf["part"].iloc[0] // FAN_IN, json.dumps(dump(node)), json.dumps(several), decided)], columns=["host", "part", "wrapper", "marks", "rule"])


def infer_wrappers(pages: DataFrame, part_pages: int = PART_PAGES) -> DataFrame:
    """(host, part, wrapper, marks, rule) of every host in ``pages`` (host, html), part being 0.  A host of
    fewer than MIN_PAGES different pages has no rule.  Equal pages fall into one part and count once."""
    pages = pages.where("html IS NOT NULL")
    large = pages.groupBy("host").agg(F.ceil(F.count("*") / F.lit(part_pages)).alias("parts")).where("parts > 1")
    large = Scratch(pages.sparkSession, "hosts").keep(large, "large")  # its size is known when it is joined
    most = large.agg(F.max("parts")).first()[0] or 1
    part = F.pmod(F.xxhash64("html"), F.coalesce("parts", F.lit(1)))
    # Dealt by host and part: else pages dealt by host for the join would stay so, a hot host in one task.
    dealt = pages.join(large, "host", "left").select("host", "html", part.alias("part")).repartition("host", "part")
    found = dealt.groupBy("host", "part").applyInPandas(_infer, "host string, part long, wrapper string, marks string")
    while True:
        found = found.groupBy("host", F.floor(F.col("part") / F.lit(FAN_IN)).alias("node")).applyInPandas(_merge, "host string, part long, wrapper string, marks string, rule string")
        if most <= FAN_IN:
            return found
        found, most = found.drop("rule"), -(-most // FAN_IN)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, host`` of every page.

    Null html counts as empty and gives empty text; pages without a host share one wrapper.  Rows
    that repeat a page give its text again.  Blocks are joined by two line feeds in page order.  Pages of any
    length are read whole, in time that grows little faster than their length.  An empty table gives an
    empty result.  Other columns are not read, so their names can't clash.
    """
    scratch = Scratch(pages.sparkSession, "wrappers")

    @F.pandas_udf("string")
    def host(urls: pd.Series) -> pd.Series:
        return pd.Series([host_of(None if pd.isna(u) else u) for u in urls], dtype="object")

    rows = pages.select("page_id", "url", "html").withColumn("host", host("url"))
    rules = scratch.keep(infer_wrappers(rows.select("host", "html")).select(F.col("host").alias("__host"), "rule"), "rules")
    chars = rules.agg(F.coalesce(F.sum(F.length("__host") + F.coalesce(F.length("rule"), F.lit(0))), F.lit(0))).first()[0]

    @F.pandas_udf("string")
    def run(texts: pd.Series, rules: pd.Series) -> pd.Series:
        known = {r: json.loads(r) for r in rules.dropna().unique()}
        return pd.Series([extract(None if pd.isna(t) else t, known.get(r)) for t, r in zip(texts, rules)], dtype="object")

    joined = rows.join(F.broadcast(rules) if chars <= BROADCAST_CHARS else rules, F.col("host") == F.col("__host"), "left")
    text = joined.withColumn("text", run("html", "rule"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
