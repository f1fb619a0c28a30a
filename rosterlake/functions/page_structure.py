"""Entries of a page found by its repeated structure; plain Python, one page at a time."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

# --- fixed values: elements that make up the structure of a page -------------
CONTAINERS = frozenset(
    "article aside body dd div dl dt footer header li main nav ol section table tbody td tfoot th thead tr ul".split()
)
NOT_CONTENT = frozenset("aside footer header nav".split())
#: entries that may stand within entries, and whose end may be left out
LISTED = {"li": ("ul", "ol"), "dt": ("dl",), "tr": ("table",)}
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dd",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
WITHIN = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl", "dt"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
# -----------------------------------------------------------------------------

_TOKEN = re.compile(
    r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+)|<",
    re.I | re.S,
)
_ATTRIBUTE = r"""\b%s\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_CLASS = re.compile(r"(?<![\w-])" + _ATTRIBUTE % "class", re.I)
_HREF = re.compile(r"(?<![\w-])" + _ATTRIBUTE % "href", re.I)
_EMAIL = re.compile(r"[\w.+-]+(?:@|\s*\[\s*(?:@|at)\s*\]\s*)[\w-]+(?:\.[\w-]+)+", re.I)


@dataclass(slots=True)
class _Node:
    tag: str
    path: tuple
    """(path of the parent, own tag and classes, number of the path): equal paths are one object."""
    parent: _Node | None
    content: bool
    inside: list = field(default_factory=list)
    """In page order: nodes, (text, number of its link or 0), and links (href, - number)."""
    terms: _Node | None = None
    entry: bool = False
    listed_entry: bool = False
    covered: bool = False


def _value(pattern: re.Pattern, attributes: str) -> str:
    found = pattern.search(attributes)
    return entities.unescape(next((g for g in found.groups() if g is not None), "")).strip() if found else ""


def _parse(page: str) -> list[_Node]:
    """The containers of a page in page order; other elements are part of the text."""
    paths: dict[tuple[int, str], tuple] = {}

    def path_below(above: tuple, step: str) -> tuple:
        return paths.setdefault((above[2], step), (above, step, len(paths) + 1))

    top = _Node("", (None, "", 0), None, True)
    stack, open_tags, nodes = [top], Counter(), [top]
    link = n_links = 0

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            open_tags[stack.pop().tag] -= 1

    for token in _TOKEN.finditer(page):
        _, end, tag, attributes, text = token.groups()
        if text is not None:
            stack[-1].inside.append((entities.unescape(text), link))
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            link = 0
            href = "" if end else _value(_HREF, attributes)
            if href:
                n_links += 1
                link = n_links
                stack[-1].inside.append((href, -link))
        elif tag not in CONTAINERS:
            stack[-1].inside.append((" ", link))
        elif end:
            if open_tags[tag]:
                close_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
        else:
            if any(open_tags[t] for t in ENDED_BY.get(tag, ())):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in ENDED_BY[tag]:
                        # a term ends what was said of the one before, and that term
                        close_to(depth - 1 if tag == "dt" and stack[depth - 1].tag == "dt" else depth)
                        break
                    if stack[depth].tag in WITHIN[tag]:
                        break
            above = stack[-1]
            if tag == "dd" and above.terms:  # what is said of a term belongs to it
                above = above.terms
            step = " ".join([tag, *sorted(set(_value(_CLASS, attributes).split()))])
            path = path_below(above.path, step)
            outer = above.path[0]
            if tag in LISTED and outer and outer[1] == step and outer[0] and outer[0][1] == above.path[1]:
                path = outer  # a list within an entry of a list counts as one with it
            node = _Node(tag, path, above, above.content and tag not in NOT_CONTENT)
            if tag == "dt":
                above.terms = node
            above.inside.append(node)
            nodes.append(node)
            stack.append(node)
            open_tags[tag] += 1
    return nodes


def _own(node: _Node) -> tuple[str, str, dict[int, list[str]]]:
    """Text, first piece of text and links (href, texts) of an entry without entries within it."""
    said, links, todo = [], {}, list(reversed(node.inside))
    while todo:
        piece = todo.pop()
        if isinstance(piece, _Node):
            said.append(" ")
            if not piece.entry:
                todo.append((" ", 0))
                todo.extend(reversed(piece.inside))
        elif piece[1] < 0:
            links[-piece[1]] = [piece[0]]
        else:
            said.append(piece[0])
            if piece[1] in links:
                links[piece[1]].append(piece[0])
    first = next((piece for piece in said if not piece.isspace()), "")
    return " ".join("".join(said).split()), " ".join(first.split()), links


def _mail_of(href: str) -> str:
    return href[7:].split("?")[0].strip().lower() if href.lower().startswith("mailto:") else ""


def _holdings(nodes: list[_Node]) -> list[tuple[set[str], set[str]]]:
    """Up to two addresses and three targets of each node, from the innermost outwards.

    What a list item, term or row holds doesn't count for those that it lies in.
    """
    whole: dict[int, tuple[set[str], set[str]]] = {}
    own = []
    for node in reversed(nodes):
        mails, targets, less_mails, less_targets = set(), set(), set(), set()
        text = "".join(p[0] for p in node.inside if not isinstance(p, _Node) and p[1] >= 0)
        mails.update(m.lower() for m in _EMAIL.findall(text))
        for piece in node.inside:
            if not isinstance(piece, _Node) and piece[1] < 0:
                mail = _mail_of(piece[0])
                (mails if mail else targets).add(mail or piece[0])
        less_mails |= mails
        less_targets |= targets
        for piece in node.inside:
            if isinstance(piece, _Node):
                all_mails, all_targets, un_mails, un_targets = whole[id(piece)]
                mails |= all_mails
                targets |= all_targets
                if piece.tag not in LISTED:
                    less_mails |= un_mails
                    less_targets |= un_targets
        whole[id(node)] = tuple(
            set(sorted(s)[:n]) for s, n in ((mails, 2), (targets, 3), (less_mails, 2), (less_targets, 3))
        )
        own.append(whole[id(node)][2:] if node.tag in LISTED else whole[id(node)][:2])
    return own[::-1]


def entries_of(page: str, min_repeats: int) -> list[tuple[str, str, str, str]]:
    """(name, href, mail, text) of the entries of a page, in page order; the name is the
    text of the first link to a page, or else the first piece of text.

    Entries are containers that stand at least ``min_repeats`` times at the same path of tags
    and classes, outside of menus, headers and footers, if at least half of them hold a
    link or an address and half of those no more than one address and two links. Those of
    the outermost such path are taken, and what is inside belongs to them; but list items,
    terms and rows within a list item, term or row are entries for themselves.
    """
    nodes = _parse(page)
    repeats, holding, single = Counter(), Counter(), Counter()
    for node, (mails, targets) in zip(nodes, _holdings(nodes), strict=True):
        if not node.content:
            continue
        number = node.path[2]
        repeats[number] += 1
        holding[number] += bool(mails or targets)
        single[number] += bool(mails or targets) and len(mails) <= 1 and len(targets) <= 2
    accepted = {
        p for p, n in repeats.items() if n >= min_repeats and 2 * holding[p] >= n and 2 * single[p] >= holding[p] > 0
    }
    found = []
    for node in nodes[1:]:
        above = node.parent
        node.covered, node.listed_entry = above.covered or above.entry, above.listed_entry
        listed = node.tag in LISTED
        if node.content and ((node.path[2] in accepted and not node.covered) or (listed and node.listed_entry)):
            node.entry, node.listed_entry = True, listed
    for node in nodes:
        if node.entry:
            text, first, links = _own(node)
            mails = [m for link in links.values() if (m := _mail_of(link[0]))]
            to_pages = [link for link in links.values() if not _mail_of(link[0])]
            if to_pages or mails or _EMAIL.search(text):
                names = [name for link in to_pages if (name := " ".join("".join(link[1:]).split()))]
                found.append((names[0] if names else first, to_pages[0][0] if to_pages else "", mails[0] if mails else "", text))
    return found
