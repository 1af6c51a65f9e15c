"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

Pages of one host come from one template. A bounded sample of a host's distinct pages, of any
length, is read as token streams nested by their tags and aligned page by page, element by
element: children that only some pages have become optional groups, runs of equal children or
of equal stretches of children become repeated groups, and texts that differ become slots.
What is left, a union-free regular expression for each element, is the host's wrapper.

The wrapper decides what the main text is. Its place is told by how the slots behave over the
pages of the host: texts that are no links, no runs of short items, and whose length differs from page
to page weigh by their characters, and the place is the smallest element that holds most of that
weight; a mark (article, main) only breaks ties. Every page is matched against its host's
expression, and its main text is what stands in the slots and repeated groups of the place,
without menus, headers, footers, asides, notices, adverts, forms, scripts, styles and comments,
and without texts that the expression holds as constants there. A page that the expression does
not describe, and one without a host, is matched against the expression of itself alone. One
page shows no differences, so there only marks tell the place, and without them all stays that
does not stand in an element that never holds an article.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import checkpointed, free_names, small_batches, text_values

#: A host's wrapper is inferred from at most so many of its distinct pages.
SAMPLE_PAGES = 12
#: Wrappers are broadcast up to so many hosts and characters, else joined by host.
BROADCAST_HOSTS, BROADCAST_CHARS = 20_000, 8 << 20
#: Elements nest so deep in a tree; text of deeper ones belongs to the last.
DEPTH = 100
#: An element's expression of more children than this becomes a repeated group of all its labels, in any
#: order; of more labels than this, a repeated slot for anything.
WIDEST = 64
ANYTHING = ""
#: Repeated groups of at most so many children are looked for.
LONGEST_GROUP = 8
#: The place holds this share of the weight; a marked element is preferred from MARKED_SHARE on, on a page by itself from ALONE_SHARE of all text on.
PLACE_SHARE, MARKED_SHARE, ALONE_SHARE = 0.7, 0.3, 0.5
#: A slot weighs in full from this spread of its characters over pages on, as a share of their mean; items shorter than SHORT that stand several times on a page weigh nothing.
SPREAD, SHORT = 0.25, 25
#: A page is described by a wrapper if matching it bends the expressions down to the place by no more than this.
BENT = 2
#: A host of more pages than this meets its wrapper in several tasks; as the bound grows with all pages, at most HOT_HOSTS hosts do.
BUCKET, HOT_HOSTS = 1000, 100_000
#: From so many pages on that agree a constant within a marked element belongs to the template.
TEMPLATE_PAGES = 4

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z][^>]*(?:>|\Z)|[^<]+|<", re.DOTALL)
NAME = re.compile(r"</?([A-Za-z][\w:-]*)")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
#: Kinds of HTML elements.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES_OWN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Elements of no meaning of their own are told apart by what they hold: texts only, prose, or else lists.
PLAIN = {"div", "section", "td"}
PROSE, LISTS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}, {"ul", "ol", "dl"}
PARTS_OF_TEXT = {"p", "li", "ul", "ol", "dl", "dt", "dd", "td", "th", "tr", "table", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}
NEVER = {"head", "title", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "input", "fieldset", "legend"} | RAW
NEVER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"}
NEVER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscri\w+|nav\w*|menus?|breadcrumbs?|sidebar|footer|masthead|topbar|comments?|commentlist|repl(?:y|ies)|disqus|social|shar(?:e|ing)|related|recommended|pagination|pager|widgets?|login|signup|search|toolbar|skip)(?:$|[\s_-])",
    re.IGNORECASE,
)
HEADER_NAMES = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")


# Pages as trees.


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", name, attributes), ("close", name, "") and ("text", decoded text, "") of a page, in order."""
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        token = m.group()
        if token.startswith("<!--") or token.startswith("<!") or token.startswith("<?"):
            if token.startswith("<![CDATA["):
                yield "text", token[9:].removesuffix("]]>"), ""
            continue
        name = NAME.match(token)
        if not name:
            yield "text", html.unescape(token), ""
            continue
        tag = name.group(1).lower()
        if token.startswith("</"):
            yield "close", tag, ""
            continue
        yield "open", tag, token[name.end() :]
        if token.endswith("/>") and tag not in INLINE or tag in VOID:
            yield "close", tag, ""
        elif tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, m.end())
            at = end.end() if end else len(page)
            yield "close", tag, ""


class Text:
    """A block of text, its number of characters, and how many of them are links."""

    __slots__ = ("text", "chars", "linked")
    label = "#"

    def __init__(self, text: str, linked: int):
        self.text, self.chars, self.linked = text, len(text), min(linked, len(text))


class Element:
    """An element with its children: label is its tag with class and id, numbers in them being alike, and of a plain one a mark of what it holds.

    never: it holds no main text; main: it is marked as the place of it."""

    __slots__ = ("tag", "label", "never", "main", "kids")

    def __init__(self, tag: str, attributes: str, inside_main: bool):
        named = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
        self.tag, self.label, self.kids = tag, tag, []
        kind, name, role = named.get("class", ""), named.get("id", ""), named.get("role", "").lower()
        if kind:
            self.label += "." + ".".join(sorted(_DIGITS.sub("0", kind).split()))
        if name:
            self.label += "#" + _DIGITS.sub("0", name)
        names = f"{kind} {name}".strip()
        frame = tag in ("html", "body", "main")
        shut = tag in NEVER or role in NEVER_ROLES or bool(names and not frame and NEVER_NAMES.search(names))
        self.never = shut or (not inside_main and (tag == "header" or bool(names and not frame and tag != "article" and HEADER_NAMES.search(names))))
        self.main = not shut and (tag in ("article", "main") or role in ("main", "article"))


def _holding(node: Element) -> str:
    """A mark for an element that holds texts only, and for a nameless one that holds prose or, if none, lists."""
    kids = [kid for kid in node.kids if isinstance(kid, Element)]
    if not kids:
        return "'"
    if node.label != node.tag:
        return ""
    if any(kid.tag in PROSE or kid.label.endswith("~p") for kid in kids):
        return "~p"
    return "~l" if any(kid.tag in LISTS or kid.label.endswith("~l") for kid in kids) else ""


def tree(page: str) -> Element:
    """The page as an element without a tag; what is open at the end is closed there."""
    root = Element("", "", False)
    # (tag, where texts go, whether they are never main text, inside of a marked element)
    stack: list[tuple[str, Element | None, bool, bool]] = [("", root, False, False)]
    nodes, open_tags = [root], Counter()
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text and not (stack[-1][2] and not nodes[-1].never and len(nodes) >= DEPTH):
                nodes[-1].kids.append(Text(text, linked))
            linked = 0

    def push(tag: str, more: str, block: bool) -> None:
        _, _, shut, inside = stack[-1]
        element = Element(tag, more, inside)
        node = None
        if block or element.never:
            flush()
            if len(nodes) < DEPTH:
                node = element
                nodes[-1].kids.append(node)
                nodes.append(node)
        stack.append((tag, node, shut or element.never, inside or element.main))
        open_tags[tag] += 1

    def pop_to(k: int) -> None:
        if any(node is not None for _, node, _, _ in stack[k:]):
            flush()
        for tag, node, _, _ in stack[k:]:
            open_tags[tag] -= 1
            if node is not None:
                nodes.pop()
                if tag in PLAIN:
                    node.label += _holding(node)
        del stack[k:]

    def close(name: str, stops: set[str] | None) -> None:
        """Close the last open name; with stops, only if none of those (or, if empty, no block) stands between."""
        if open_tags[name] <= 0:
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = stack[k][0]
            if tag == name:
                return pop_to(k)
            if stops is not None and (tag in stops if stops else tag not in INLINE):
                return

    for kind, name, more in events(page):
        if kind == "text":
            held.append(name)
            if open_tags["a"] > 0:
                linked += len(name)
        elif name in RAW:  # never shown, and no break between what stands around it
            continue
        elif name == "br":
            held.append(" ")
        elif name in INLINE:
            if name in VOID:
                continue
            if kind == "open":
                push(name, more, False)
            else:
                close(name, set())
        else:
            flush()
            if kind == "open":
                if name in CLOSES_P:
                    close("p", set())
                if name in CLOSES_OWN:
                    close(name, CLOSES_OWN[name])
                push(name, more, True)
            else:
                close(name, None)
    pop_to(1)
    flush()
    return root


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def packed(kid: Element | Text) -> list:
    """A tree without its texts, for the way to the task that infers: digests and lengths stand for them."""
    if isinstance(kid, Text):
        return [digest(kid.text), kid.chars, kid.linked]
    return [kid.label, kid.tag, int(kid.never) + 2 * int(kid.main), [packed(k) for k in kid.kids]]


# Expressions over the labels of an element's children: lists of items [mark, label] or
# [mark, items], where mark is "1" (once), "?" (or not), "+" (once or more) or "*".


def _mark(optional: bool, repeated: bool) -> str:
    return "1?+*"[optional + 2 * repeated]


def _optional(item: list) -> list:
    return [_mark(True, item[0] in "+*"), item[1]]


def _key(item: list):
    return item[1] if isinstance(item[1], str) else tuple(map(_key, item[1]))


def _joined(one: list, two: list) -> list:
    """An item that stands for either of two items of one key."""
    inner = one[1] if isinstance(one[1], str) else [_joined(a, b) for a, b in zip(one[1], two[1], strict=True)]
    return [_mark(one[0] in "?*" or two[0] in "?*", one[0] in "+*" or two[0] in "+*"), inner]


def folded(items: list[list]) -> list[list]:
    """items with stretches that stand there twice or more, the shortest first, as repeated groups."""
    size, rounds = 1, 0
    while size <= LONGEST_GROUP and rounds < 4 * LONGEST_GROUP:
        rounds += 1
        keys, out, k, changed = [_key(x) for x in items], [], 0, False
        while k < len(items):
            unit, end = keys[k : k + size], k + size
            group = items[k:end]
            while len(unit) == size and keys[end : end + size] == unit:
                group = [_joined(a, b) for a, b in zip(group, items[end : end + size], strict=True)]
                end += size
            if end > k + size:
                # once at least where one of the items of size 1 has to be there; a group of more is a sequence of items
                once = size > 1 or any(x[0] in "1+" for x in items[k:end])
                out.append([_mark(not once, True), group[0][1]] if size == 1 else ["+", group])
                k, changed = end, True
            elif size > 1 and isinstance(items[k][1], list) and len(items[k][1]) == size and [_key(x) for x in items[k][1]] == keys[k + 1 : k + 1 + size]:
                out.append([_mark(items[k][0] in "?*", True), [_joined(a, b) for a, b in zip(items[k][1], items[k + 1 : k + 1 + size], strict=True)]])
                k, changed = k + 1 + size, True
            else:
                out.append(items[k])
                k += 1
        items = out
        size = 1 if changed and size > 1 else size + 1
    return items


class Expression:
    """An expression made ready for matching: its atoms, numbered in order, and which may follow which."""

    def __init__(self, items: list[list]):
        self.items = items
        self.labels: list[str] = []
        self.repeated: list[bool] = []
        self.follow: list[set[int]] = []
        first, self.last, self.empty = self._sequence(items, False)
        self.follow.append(first)  # at -1: the start
        self.where: dict[str, list[int]] = {}
        for k, label in enumerate(self.labels):
            self.where.setdefault(label, []).append(k)

    def _sequence(self, items, repeated):
        first, last, empty = set(), set(), True
        for mark, inner in items:
            again = repeated or mark in "+*"
            if isinstance(inner, str):
                k = len(self.labels)
                self.labels.append(inner)
                self.repeated.append(again)
                self.follow.append(set())
                f, e, none = {k}, {k}, False
            else:
                f, e, none = self._sequence(inner, again)
            if mark in "+*":
                for a in e:
                    self.follow[a] |= f
            none = none or mark in "?*"
            for a in last:
                self.follow[a] |= f
            first = first | f if empty else first
            last = last | e if none else e
            empty = empty and none
        return first, last, empty

    def match(self, labels: list[str]) -> tuple[int, list[int | None]]:
        """(cost, atom of each label, or none): 0 if the expression describes the labels, else the cheapest way to bend it.

        A step past atoms that should be there, or back to an atom that should not repeat,
        costs 1, and a label outside of the expression 2."""
        front: dict[int, tuple[int, tuple | None]] = {-1: (0, None)}
        follow, anything = self.follow, self.where.get(ANYTHING, ())
        for label in labels:
            new: dict[int, tuple[int, tuple | None]] = {}
            for b in self.where.get(label, anything):
                best = None
                for a, (cost, way) in front.items():
                    if b in follow[a]:
                        pass
                    elif b >= a:
                        cost += 1
                    else:
                        continue
                    if best is None or cost < best[0]:
                        best = (cost, way)
                if best is not None:
                    new[b] = (best[0], (b, best[1]))
            for a, (cost, way) in front.items():
                if a not in new or new[a][0] > cost + 2:
                    new[a] = (cost + 2, (None, way))
            low = min(cost for cost, _ in new.values())
            front = {a: x for a, x in new.items() if x[0] <= low + 3}
        done = min(((cost + (0 if a in self.last or (a < 0 and self.empty) else 1), a, way) for a, (cost, way) in front.items()), key=lambda x: x[:2])
        out, way = [], done[2]
        while way is not None:
            out.append(way[0])
            way = way[1]
        return done[0], out[::-1]


def _atoms(item: list) -> int:
    return 1 if isinstance(item[1], str) else sum(map(_atoms, item[1]))


def _labels(items: list[list]) -> Iterator[str]:
    for _, inner in items:
        yield from [inner] if isinstance(inner, str) else _labels(inner)


def _bent(items: list[list], at: int, skips: list[tuple[int, int]], again: set[int], added: dict[int, list[list]]) -> list[list]:
    """items, whose first atom is at, with atoms inside of skips (a, b) optional, those of again repeated, and added items behind atoms."""
    out = []
    for item in items:
        lo, hi = at, at + _atoms(item) - 1
        at = hi + 1
        if isinstance(item[1], str):
            made = [_mark(item[0] in "?*", item[0] in "+*" or lo in again), item[1]]
        else:
            made = [item[0], _bent(item[1], lo, skips, again, added)]
        out.append(_optional(made) if any(a < lo and hi < b for a, b in skips) else made)
        if isinstance(item[1], str):
            out += added.get(lo, [])
    return out


def widened(items: list[list], labels: list[str]) -> list[list]:
    """items made wide enough to describe labels too; what they described before they still do."""
    for _ in range(12):
        if sum(map(_atoms, items)) > WIDEST:
            break
        ready = Expression(items)
        cost, found = ready.match(labels)
        if not cost:
            break
        skips, again, added = [], set(), {}
        before, loose = -1, []
        for label, atom in [*zip(labels, found, strict=True), (None, len(ready.labels))]:
            if atom is None:
                loose.append(["1", label])
                continue
            if loose:
                added.setdefault(before, []).extend(_optional(x) for x in folded(loose))
                loose = []
            if label is None:
                if not (before in ready.last or (before < 0 and ready.empty)):
                    skips.append((before, atom))
            elif atom not in ready.follow[before]:
                if atom == before:
                    again.add(atom)
                else:
                    skips.append((before, atom))
            before = atom
        items = folded(added.get(-1, []) + _bent(items, 0, skips, again, added))
    if sum(map(_atoms, items)) > WIDEST or Expression(items).match(labels)[0]:
        every = dict.fromkeys([*_labels(items), *labels])
        items = [["*", [["?", x] for x in every]]] if len(every) <= WIDEST and ANYTHING not in every else [["*", ANYTHING]]
    return items


def expression(sequences: list[list[str]]) -> list[list]:
    """A union-free expression that describes all the sequences, aligned one after another."""
    items: list[list] = []
    for k, labels in enumerate(sequences):
        items = widened(items, labels) if k else widened(folded([["1", x] for x in labels]), labels)
    return items


# Wrappers: an element's is {"s": expression, "k": one wrapper for each atom, "t": tag, "n":
# never, "m": main}; a text's is {"d": digest or none for a slot, "p": pages, "c": characters,
# "a": characters of links, "w": weight}.


def _text_wrapper(found: list[tuple[int, list]]) -> dict:
    same = {x[0] for _, x in found}
    each = Counter()
    for page, x in found:
        each[page] += x[1]
    constant = len(same) == 1 and len(each) > 1
    chars, linked = each.total(), sum(x[2] for _, x in found)
    items = len(found) > 1.5 * len(each) and chars < SHORT * len(found)
    return {"d": next(iter(same)) if constant else None, "p": len(each), "c": chars, "a": linked, "w": 0 if constant or items else _weight_of(each, linked)}


def _weight_of(each: Counter, linked: int) -> float:
    """The characters of a slot by page that are no links, as far as they differ from page to page."""
    chars, pages = each.total(), len(each)
    if not chars:
        return 0
    mean = chars / pages
    spread = (sum((n - mean) ** 2 for n in each.values()) / pages) ** 0.5 / mean
    return (chars - linked) * min(1, spread / SPREAD)


def _anything_wrapper(found: list[tuple[int, list]]) -> dict:
    each = Counter()
    for page, x in found:
        each[page] += sum(_packed_texts(["", "", 0, [x]]).values())
    return {"d": None, "p": len(each), "c": each.total(), "a": 0, "w": _weight_of(each, 0)}


def _element_wrapper(found: list[tuple[int, list]]) -> dict:
    """The wrapper of elements of one label: (page, packed element)."""
    label = lambda kid: "#" if len(kid) == 3 else kid[0]
    sequences = [list(map(label, x[3])) for _, x in found]
    items = expression([list(s) for s in dict.fromkeys(map(tuple, sequences))])
    ready = Expression(items)
    kids: list[list] = [[] for _ in ready.labels]
    known: dict[tuple, list] = {}
    for (page, x), labels in zip(found, sequences, strict=True):
        atoms = known.get(tuple(labels))
        if atoms is None:
            atoms = known[tuple(labels)] = ready.match(labels)[1]
        for kid, atom in zip(x[3], atoms, strict=True):
            if atom is not None:
                kids[atom].append((page, kid))
    makers = {"#": _text_wrapper, ANYTHING: _anything_wrapper}
    made = [makers.get(name, _element_wrapper)(k) for name, k in zip(ready.labels, kids, strict=True)]
    _, first = found[0]
    return {"s": items, "k": made, "t": first[1], "n": bool(first[2] & 1), "m": bool(first[2] & 2)}


def _chars(node: dict, constants: bool) -> int:
    """Characters of text in slots, and in constants where asked, outside of elements that never hold main text."""
    total = 0
    for kid in node["k"]:
        if "s" in kid:
            total += 0 if kid["n"] else _chars(kid, constants)
        elif (constants or kid["d"] is None) and kid["a"] <= 0.6 * kid["c"]:
            total += kid["c"]
    return total


def _weight(node: dict) -> float:
    """The weight of the slots of a wrapper outside of elements that never hold main text."""
    return sum(kid["w"] if "s" not in kid else 0 if kid["n"] else _weight(kid) for kid in node["k"])


def _holds_mark(node: dict) -> bool:
    return node["m"] or any(_holds_mark(kid) for kid in node["k"] if "s" in kid and not kid["n"])


def inferred(pages: list[list]) -> dict:
    """The wrapper of packed pages, with place (atoms from the root down to the element of the main text) and drop (whether its constants are template)."""
    wrapper = _element_wrapper(list(enumerate(pages)))
    lone = len(pages) == 1
    copies = not lone and _chars(wrapper, False) < 0.2 * _chars(wrapper, True)  # near copies: what they share is the article
    even = not _weight(wrapper)  # nothing differs in length: characters alone have to tell
    measure = (lambda node: _chars(node, lone or copies)) if lone or copies or even else _weight
    total = measure(wrapper)
    place, node, marked = [], wrapper, False
    while total:
        ready = Expression(node["s"])
        heavy = [(measure(kid), kid["m"], -k) for k, kid in enumerate(node["k"]) if "s" in kid and not kid["n"] and kid["t"] not in PARTS_OF_TEXT and not ready.repeated[k]]
        best = max(heavy, default=(0, False, 0))
        if lone or best[0] < PLACE_SHARE * total:
            best = max((x for x in heavy if x[1] or (lone and not marked and _holds_mark(node["k"][-x[2]]))), default=(0, False, 0))
            if not best[0] or best[0] < (ALONE_SHARE if lone else MARKED_SHARE) * total:
                break
        place.append(-best[2])
        node, marked = node["k"][-best[2]], marked or best[1]
    wrapper |= {"place": place, "drop": len(pages) >= (TEMPLATE_PAGES if marked else 2) and _shared(wrapper, place, pages) <= 0.5}
    return wrapper


def _packed_texts(kid: list) -> dict[str, int]:
    """Digests and characters of the texts of a packed element outside of elements that never hold main text."""
    found: dict[str, int] = {}
    for x in kid[3]:
        if len(x) == 3:
            found[x[0]] = x[1]
        elif not x[2] & 1:
            found |= _packed_texts(x)
    return found


def _shared(wrapper: dict, place: list[int], pages: list[list]) -> float:
    """Of the distinct texts in the place on each page, the share of characters that stand in half of the pages or more: near copies share most."""
    seen: Counter = Counter()
    chars: Counter = Counter()
    for page in pages:
        kid, node = page, wrapper
        for atom in place:
            labels = ["#" if len(x) == 3 else x[0] for x in kid[3]] if kid else []
            kid = next((x for x, a in zip(kid[3], Expression(node["s"]).match(labels)[1], strict=True) if a == atom), None) if kid else None
            node = node["k"][atom]
        texts = _packed_texts(kid) if kid else {}
        seen.update(texts.keys())
        chars.update(texts)
    return sum(n for x, n in chars.items() if 2 * seen[x] >= len(pages)) / max(1, chars.total())


def ready_wrapper(text: str) -> dict:
    """A wrapper from JSON, its expressions made ready."""
    wrapper = json.loads(text)
    prepare(wrapper)
    return wrapper


def prepare(node: dict) -> None:
    node["e"] = Expression(node["s"])
    node["seen"] = {}
    for kid in node["k"]:
        if "s" in kid:
            prepare(kid)


def _matched(element: Element, node: dict) -> tuple[int, list[int | None]]:
    """What it costs to match an element's children, and their atoms."""
    labels = tuple([kid.label for kid in element.kids])
    seen = node["seen"]
    found = seen.get(labels)
    if found is None:
        found = node["e"].match(labels)
        if len(seen) < 256 and len(labels) < 256:
            seen[labels] = found
    return found


def _texts(element: Element, node: dict | None, drop: bool, out: list[str]) -> int:
    """Add the texts of an element that are no constants of its wrapper to out; their characters."""
    total = 0
    atoms = _matched(element, node)[1] if node else [None] * len(element.kids)
    for kid, atom in zip(element.kids, atoms, strict=True):
        under = node["k"][atom] if node and atom is not None else None
        if isinstance(kid, Element):
            if not kid.never:
                total += _texts(kid, under if under and "s" in under else None, drop, out)
        elif not (drop and under and under["d"] is not None and under["d"] == digest(kid.text)):
            out.append(kid.text)
            total += kid.chars
    return total


def main_text(page: Element, wrapper: dict) -> str | None:
    """The texts in the place of a prepared wrapper, one line a block; None where it does not describe the page."""
    element, node, bent = page, wrapper, 0
    for atom in wrapper["place"]:
        cost, atoms = _matched(element, node)
        bent += cost
        element = next((kid for kid, a in zip(element.kids, atoms, strict=True) if a == atom), None)
        if element is None or bent > BENT:
            return None
        node = node["k"][atom]
    found: list[str] = []
    _texts(element, node, wrapper["drop"], found)
    return "\n".join(found)


def page_text(page: str, wrapper: dict | None) -> str:
    """The main text of a page by its host's prepared wrapper or, where that does not describe it, by its own."""
    read = tree(page)
    text = main_text(read, wrapper) if wrapper else None
    if text is None:
        own = inferred([packed(read)])
        prepare(own)
        text = main_text(read, own)
        if text is None:  # the place of most text is all there is to go by
            text = main_text(read, own | {"place": []}) or ""
    return text


# Spark.


def samples(named: DataFrame) -> DataFrame:
    """(host, hash, html): for each host at most SAMPLE_PAGES distinct pages, those of the smallest hashes.

    Copies are one page from the start; hashes are ranked first, and only the pages of those
    that stay are fetched."""
    hashed = named.where("host <> '' and html is not null").select("host", F.xxhash64("html").alias("hash_"), "html")
    rank = F.row_number().over(Window.partitionBy("host").orderBy("hash_"))
    kept = hashed.select("host", "hash_").distinct().withColumn("rank_", rank).where(F.col("rank_") <= SAMPLE_PAGES).select("host", "hash_")
    kept = checkpointed(kept)
    few = kept.count() <= SAMPLE_PAGES * BROADCAST_HOSTS
    fetched = hashed.join(F.broadcast(kept) if few else kept, ["host", "hash_"], "left_semi")
    return fetched.groupBy("host", "hash_").agg(F.min("html").alias("html"))


def wrappers(named: DataFrame) -> DataFrame:
    """(host, wrapper): a wrapper in JSON for each host."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json.dumps(packed(tree(page))) for page in text_values(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=["host", "hash_", "tree"])

    def infer(rows: pd.DataFrame) -> pd.DataFrame:
        made = inferred([json.loads(x) for x in rows.sort_values("hash_")["tree"]])
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(made)]})

    trees = samples(named).mapInArrow(pack, "host string, hash_ bigint, tree string")
    return trees.groupBy("host").applyInPandas(infer, "host string, wrapper string")


def _with_wrappers(named: DataFrame, known: DataFrame, host: str, wrapper: str) -> DataFrame:
    """named with the wrapper of each row's host, or null. A host of many pages meets it in several tasks; rows without a host do not move."""
    hosts, chars = known.agg(F.count("*"), F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()
    at = known.withColumnsRenamed({"host": host, "wrapper": wrapper})
    if hosts <= BROADCAST_HOSTS and chars <= BROADCAST_CHARS:
        return named.join(F.broadcast(at), host, "left")
    pages, salts, salt = free_names(named.columns, "pages_", "salts_", "salt_")
    sized = checkpointed(named.where(F.col(host) != "").groupBy(host).agg(F.count("*").alias(pages)))
    bucket = max(BUCKET, -(-sized.agg(F.sum(pages)).first()[0] // HOT_HOSTS))
    times = F.ceil(F.col(pages) / bucket).cast("int")
    hot = F.broadcast(sized.where(F.col(pages) > bucket).select(host, times.alias(salts)))  # at most HOT_HOSTS rows
    some = named.where(F.col(host) != "").join(hot, host, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64("html", "url"), F.col(salts)), F.lit(0)).cast("int")).drop(salts)
    spread = at.join(sized, host).withColumn(salt, F.explode(F.sequence(F.lit(0), times - 1))).drop(pages)
    return some.join(spread, [host, salt], "left").drop(salt).unionByName(named.where(F.col(host) == "").withColumn(wrapper, F.lit(None).cast("string")))


def extracted(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html and others) with main_text.

    A null or empty html has an empty text; so has a page that is all boilerplate. A page
    whose url is null or has no host has a wrapper of its own. Repeated rows are kept and
    count once for a wrapper; other columns are passed on, whatever they are called, but one
    named main_text is replaced."""
    small_batches(pages.sparkSession)
    own = [f for f in pages.schema.fields if f.name != "main_text"]
    host, wrapper = free_names([f.name for f in own], "host", "wrapper")
    named = pages.select([f.name for f in own]).withColumn(host, F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit("")))
    known = checkpointed(wrappers(named.select(F.col(host).alias("host"), "html")))
    joined = _with_wrappers(named, known, host, wrapper).select(*[f.name for f in own], wrapper)
    at = [f.name for f in own].index("html")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, dict] = {}
        for batch in batches:
            made = []
            for page, wrapper in zip(text_values(batch.column(at)), batch.column(len(own)).to_pylist(), strict=True):
                if wrapper is not None and wrapper not in memo:
                    if len(memo) > 2000:
                        memo.clear()
                    memo[wrapper] = ready_wrapper(wrapper)
                made.append(page_text(page, memo.get(wrapper)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], names=[*batch.schema.names[:-1], "main_text"])

    return joined.mapInArrow(extract, T.StructType([*own, T.StructField("main_text", T.StringType())]))
