"""The tree of an HTML page, built as the HTML standard's tree construction has it.

One pattern splits a page into tags, comments and text. The tree has scopes and implied ends, the list of active formatting elements with the adoption procedure,
the parts of tables with foster parenting, lists of options, forms, and foreign
content. Scripts count as switched on, so noscript is raw text. A page without a
document type is in quirks mode, where a table does not end a paragraph.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from html import escape, unescape
from html.entities import html5

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW_TEXT = frozenset("script style noscript title textarea iframe xmp noembed noframes".split())
HEAD_ONLY = frozenset("title meta link base style script noscript template".split())
#: Names that the standard's tree construction treats alike: fixed values.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p plaintext pre search section summary ul xmp".split()
)
CLOSED_AS_BLOCK = frozenset(
    "address article aside blockquote button center details dialog dir div dl fieldset figcaption figure footer header hgroup listing main menu nav ol pre search section summary ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
MARKED = frozenset("applet marquee object".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
GROUPS = frozenset("tbody tfoot thead".split())
CELLS = frozenset("td th".split())
FOSTERS = frozenset("table tbody tfoot thead tr".split())
IMPLIED_ENDS = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
SCOPE = frozenset("applet caption html marquee object table td template th".split())
BUTTON_SCOPE = SCOPE | {"button"}
LIST_SCOPE = SCOPE | {"ol", "ul"}
TABLE_SCOPE = frozenset("html table template".split())
#: Start tags that end foreign content, and foreign elements whose content is HTML: fixed values.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split()
)
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: An attribute: name, then a value in double quotes, single quotes or none. A quote that is not closed takes the rest of the page.
ATTRIBUTE = r"""([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\f\r>"'][^ \t\n\f\r>]*+)|(?=>)))?+"""
UNNAMED = re.sub(r"(?<!\\)\((?!\?)", "(?:", ATTRIBUTE)
MARKUP = re.compile(
    rf"<(?:(?P<end>/?)(?P<tag>[a-zA-Z][^ \t\n\f\r/>]*+)(?P<attrs>(?>[ \t\n\f\r/]++|{UNNAMED})*+)>|!--(?:-?>|.*?(?:--!?>|\Z))|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|!(?P<decl>[^>]*+)(?:>|\Z)|\?[^>]*+(?:>|\Z)|/(?![a-zA-Z])[^>]*+(?:>|\Z))",
    re.DOTALL,
)
ATTRIBUTES, REFERENCE = re.compile(ATTRIBUTE), re.compile(r"&(?:#[xX]?[0-9a-fA-F]+;?|[a-zA-Z0-9]+;?)=?")
RCDATA = frozenset(("title", "textarea"))
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[ \t\n\f\r/>])", re.IGNORECASE) for tag in RAW_TEXT}
SPACE = " \t\n\r\f\v"


class Node:
    __slots__ = ("attrs", "children", "foreign", "open", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None, foreign: bool = False):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []
        self.foreign, self.open = foreign, False

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self, skip: Callable[[Node], bool] = lambda n: False) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            elif not skip(item) or item is self:
                stack.extend(reversed(item.children))
        return "".join(out)

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def detach(self) -> None:
        if self.parent is not None:
            own = self.parent.children
            del own[next(k for k in range(len(own) - 1, -1, -1) if own[k] is self)]
            self.parent = None


def add_text(children: list[Node | str], at: int, data: str) -> None:
    """Text goes into the text before it, if there is one."""
    if at and isinstance(children[at - 1], str):
        children[at - 1] += data
    else:
        children.insert(at, data)


def attribute_text(value: str) -> str:
    """Character references in an attribute: a name without a semicolon counts only if neither = nor a letter or digit follows."""

    def decoded(m: re.Match) -> str:
        found = m[0]
        return unescape(found) if found[1] == "#" or found.endswith((";", ";=")) or found[1:] in html5 else found

    return REFERENCE.sub(decoded, value) if "&" in value else value


class _Builder:
    def __init__(self) -> None:
        self.root = Node("#document")
        self.html: Node | None = None
        self.body: Node | None = None
        self.head: Node | None = None
        self.form: Node | None = None
        self.raw: Node | None = None
        self.stack = [self.root]  # the open elements
        self.active: list[Node | None] = []  # active formatting elements; None is a marker
        self.within: dict[str, int] = defaultdict(int)  # open elements by tag, foreign ones under one name
        self.fostering = self.skip_newline = False
        self.doctype = ""

    def feed(self, html: str) -> Node:
        """Builds the tree of a whole page."""
        html = html.replace("\r\n", "\n").replace("\r", "\n") if "\r" in html else html
        at = begun = 0  # where to look on, and where text begins that was not passed on
        match, find = MARKUP.match, html.find
        while (at := find("<", at)) >= 0:
            m = match(html, at)
            if m is None:
                if html[at + 1 : at + 2].isalpha() and html[at + 1].isascii() or html[at + 1 : at + 2] == "/" and html[at + 2 : at + 3].isalpha():
                    self.words(html[begun:at])  # a tag that does not end: the rest of the page goes
                    begun = len(html)
                    break
                at += 1
                continue
            if at > begun:
                self.words(html[begun:at])
            at = begun = m.end()
            tag = m["tag"]
            if tag is None:
                if m["cdata"] is not None and self.stack[-1].foreign:
                    self.text(m["cdata"])
                elif (decl := m["decl"]) and decl[:7].lower() == "doctype" and self.html is None:
                    self.doctype = self.doctype or decl
                continue
            tag = tag.lower()
            if m["end"]:
                self.end(tag)
                continue
            attrs, values = m["attrs"], {}
            if attrs and not attrs.isspace():
                for name, *value in ATTRIBUTES.findall(attrs):
                    values.setdefault(name.lower(), attribute_text(value[0] or value[1] or value[2]))
            self.start(tag, values, attrs.endswith("/"))
            if (raw := self.raw) is not None:
                end = RAW_ENDS[raw.tag].search(html, at) if raw.tag in RAW_ENDS else None
                at = end.start() if end else len(html)
                data = html[begun:at]
                if self.skip_newline:
                    data, self.skip_newline = data.removeprefix("\n"), False
                if data:
                    raw.children.append(unescape(data) if raw.tag in RCDATA else data)
                begun, self.raw = at, None
                self.stack.pop()
                self.closed(raw)
                if end:
                    at = begun = html.find(">", at) + 1 or len(html)
        if begun < len(html):
            self.words(html[begun:])
        self.ensure("body")
        return self.root

    def words(self, data: str) -> None:
        self.text(unescape(data) if "&" in data else data)

    # --- the head, the body and the stack of open elements

    def ensure(self, part: str) -> None:
        if self.html is None:
            self.html = Node("html", parent=self.root)
            self.root.children.append(self.html)
            self.stack = [self.root, self.html]
        if part != "html" and self.head is None:
            self.head = Node("head", parent=self.html)
            self.html.children.append(self.head)
            if part == "head":
                self.stack = [self.root, self.html, self.head]
        if part == "body" and self.body is None:
            self.body = Node("body", parent=self.html)
            self.html.children.append(self.body)
            self.stack = [self.root, self.html, self.body]

    def place(self, tag: str) -> None:
        """Head elements stay in the head until the body has begun."""
        if tag in HEAD_ONLY:
            self.ensure("head")
            if self.head not in self.stack:
                self.stack = [self.root, self.html, self.head]
        else:
            self.ensure("body")

    def push(self, node: Node) -> None:
        self.stack.append(node)
        node.open = True
        self.within["#foreign" if node.foreign else node.tag] += 1

    def closed(self, node: Node) -> None:
        node.open = False
        self.within["#foreign" if node.foreign else node.tag] -= 1

    def pop_to(self, at: int) -> None:
        """Pops the elements from ``at`` on; html and body stay."""
        for node in self.stack[max(at, 3) :]:
            self.closed(node)
        del self.stack[max(at, 3) :]

    def pop_until(self, tags: frozenset[str] | tuple[str, ...]) -> None:
        for k in range(len(self.stack) - 1, 2, -1):
            if self.stack[k].tag in tags and not self.stack[k].foreign:
                return self.pop_to(k)

    def back_to(self, tags: frozenset[str] | tuple[str, ...]) -> None:
        """Pops until the current node is one of ``tags`` (or body)."""
        k = len(self.stack)
        while k > 3 and (self.stack[k - 1].foreign or self.stack[k - 1].tag not in tags):
            k -= 1
        self.pop_to(k)

    def in_scope(self, tags: frozenset[str] | tuple[str, ...], fences: frozenset[str] = SCOPE) -> bool:
        if not any(self.within[t] for t in tags):
            return False
        for k in range(len(self.stack) - 1, 1, -1):
            node = self.stack[k]
            if node.foreign:
                if node.tag in HOLDS_HTML:
                    return False
            elif node.tag in tags:
                return True
            elif node.tag in fences:
                return False
        return False

    def imply_ends(self, but: str = "") -> None:
        k = len(self.stack)
        while k > 3 and self.stack[k - 1].tag in IMPLIED_ENDS and self.stack[k - 1].tag != but:
            k -= 1
        self.pop_to(k)

    def close_p(self) -> None:
        if self.stack[-1].tag == "p":
            self.pop_to(len(self.stack) - 1)
        elif self.in_scope(("p",), BUTTON_SCOPE):
            self.imply_ends("p")
            self.pop_until(("p",))

    # --- insertion

    def spot(self, parent: Node) -> tuple[Node, int]:
        """Where a child of ``parent`` goes: before the table, for what must not stand between the parts of one."""
        if self.fostering and parent.tag in FOSTERS and not parent.foreign:
            for k in range(len(self.stack) - 1, 1, -1):
                table = self.stack[k]
                if table.tag == "table" and not table.foreign:
                    if table.parent is None:
                        return self.stack[k - 1], len(self.stack[k - 1].children)
                    own = table.parent.children
                    return table.parent, next(i for i in range(len(own) - 1, -1, -1) if own[i] is table)
        return parent, len(parent.children)

    def insert(self, tag: str, attrs: dict[str, str] | None = None, foreign: bool = False) -> Node:
        parent = self.stack[-1]
        node = Node(tag, attrs, parent, foreign)
        if self.fostering:
            node.parent, at = self.spot(parent)
            node.parent.children.insert(at, node)
        else:
            parent.children.append(node)
        if tag not in VOID or foreign:
            self.push(node)
        return node

    # --- active formatting elements

    def remember(self, node: Node) -> None:
        """At most three alike since the last marker."""
        same = []
        for k in range(len(self.active) - 1, -1, -1):
            other = self.active[k]
            if other is None:
                break
            if other.tag == node.tag and other.attrs == node.attrs:
                same.append(k)
        if len(same) >= 3:
            del self.active[same[-1]]
        self.active.append(node)

    def reconstruct(self) -> None:
        """Opens anew the formatting elements that were closed by the end of a block around them."""
        active = self.active
        if not active or active[-1] is None or active[-1].open:
            return
        k = len(active) - 1
        while k and active[k - 1] is not None and not active[k - 1].open:
            k -= 1
        for k in range(k, len(active)):
            active[k] = self.insert(active[k].tag, dict(active[k].attrs))

    def clear_to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def place_of(self, node: Node, among: list) -> int:
        return next((k for k in range(len(among) - 1, -1, -1) if among[k] is node), -1)

    def adopt(self, tag: str) -> None:
        """The adoption procedure: ends a formatting element that blocks may be open in."""
        current = self.stack[-1]
        if current.tag == tag and self.place_of(current, self.active) < 0:
            return self.pop_to(len(self.stack) - 1)
        for _ in range(8):
            at = len(self.active) - 1
            while at >= 0 and self.active[at] is not None and self.active[at].tag != tag:
                at -= 1
            if at < 0 or self.active[at] is None:
                return self.end_other(tag)
            mark = self.active[at]
            if not mark.open:
                del self.active[at]
                return
            if not self.in_scope((tag,)):
                return
            low = self.place_of(mark, self.stack)
            block_at = next((k for k in range(low + 1, len(self.stack)) if self.stack[k].tag in SPECIAL and not self.stack[k].foreign), -1)
            if block_at < 0:
                self.pop_to(low)
                del self.active[at]
                return
            ancestor, block = self.stack[low - 1], self.stack[block_at]
            last, k, steps = block, block_at, 0
            while (k := k - 1) > low:
                steps, node = steps + 1, self.stack[k]
                own = self.place_of(node, self.active)
                if steps > 3 and own >= 0:
                    del self.active[own]
                    at, own = at - (own < at), -1
                if own < 0:
                    del self.stack[k]
                    self.closed(node)
                    continue
                clone = Node(node.tag, dict(node.attrs))
                self.closed(node)
                clone.open, self.within[clone.tag] = True, self.within[clone.tag] + 1
                self.active[own] = self.stack[k] = clone
                if last is block:
                    at = own + 1
                last.detach()
                clone.children.append(last)
                last.parent, last = clone, clone
            last.detach()
            fostering, self.fostering = self.fostering, True
            last.parent, place = self.spot(ancestor)
            last.parent.children.insert(place, last)
            self.fostering = fostering
            clone = Node(mark.tag, dict(mark.attrs), block)
            clone.children, block.children = block.children, [clone]
            for child in clone.children:
                if isinstance(child, Node):
                    child.parent = clone
            own = self.place_of(mark, self.active)
            del self.active[own]
            self.active.insert(at - (own < at), clone)
            del self.stack[self.place_of(mark, self.stack)]
            self.closed(mark)
            clone.open, self.within[clone.tag] = True, self.within[clone.tag] + 1
            self.stack.insert(self.place_of(block, self.stack) + 1, clone)

    # --- start tags

    def start(self, tag: str, values: dict[str, str], closed: bool) -> None:
        self.skip_newline = False
        if tag in ("html", "head", "body"):
            self.ensure(tag)
            node = {"html": self.html, "head": self.head, "body": self.body}[tag]
            for name, value in values.items():
                node.attrs.setdefault(name, value)
            return
        if self.body is None:
            self.place(tag)
            if self.body is None:  # in the head
                node = self.insert(tag, values)
                self.raw = node if tag in RAW_TEXT else None
                return
        if self.within["#foreign"] and self.foreign_start(tag, values, closed):
            return
        if self.within["select"] and self.select_start(tag, values):
            return
        if self.within["table"] and self.table_start(tag, values):
            return
        self.body_start(tag, values, closed)

    def foreign_start(self, tag: str, values: dict[str, str], closed: bool) -> bool:
        current = self.stack[-1]
        if not current.foreign or current.tag in HOLDS_HTML:
            return False
        if tag in BREAKS_OUT or tag == "font" and values.keys() & {"color", "face", "size"}:
            k = len(self.stack)
            while k > 3 and self.stack[k - 1].foreign and self.stack[k - 1].tag not in HOLDS_HTML:
                k -= 1
            self.pop_to(k)
            return False
        node = self.insert(tag, values, foreign=True)
        if closed:
            self.pop_to(len(self.stack) - 1)
        elif tag in ("script", "style"):
            self.raw = node
        return True

    def select_start(self, tag: str, values: dict[str, str]) -> bool:
        """Inside a select there are options and scripts; other start tags are left out, or end it."""
        if not self.in_scope(("select",), frozenset()) or tag in ("script", "template"):
            return False
        if tag in ("option", "optgroup", "hr"):
            if self.stack[-1].tag == "option":
                self.pop_to(len(self.stack) - 1)
            if tag != "option" and self.stack[-1].tag == "optgroup":
                self.pop_to(len(self.stack) - 1)
            self.insert(tag, values)
            return True
        if tag == "select":
            self.pop_until(("select",))
            return True
        if tag in ("input", "keygen", "textarea") or self.within["table"] and (tag in TABLE_PARTS or tag == "table"):
            self.pop_until(("select",))
            return False
        return True

    def part(self) -> str:
        """The innermost open part of a table, unless something else encloses the current node: '' if none."""
        for k in range(len(self.stack) - 1, 2, -1):
            tag = self.stack[k].tag
            if self.stack[k].foreign:
                continue
            if tag in CELLS:
                return "cell"
            if tag in GROUPS:
                return "group"
            if tag in ("tr", "table", "caption", "colgroup"):
                return tag
            if tag == "template":
                return ""
        return ""

    def close_cell(self) -> None:
        self.imply_ends()
        self.pop_until(CELLS)
        self.clear_to_marker()

    def table_start(self, tag: str, values: dict[str, str]) -> bool:
        part = self.part()
        if part in ("cell", "caption"):
            if tag not in TABLE_PARTS:
                return False
            if part == "cell":
                self.close_cell()
            else:
                self.imply_ends()
                self.pop_until(("caption",))
                self.clear_to_marker()
            return self.table_start(tag, values)
        if part == "colgroup":
            if tag == "col":
                self.insert(tag, values)
                return True
            if tag == "template":
                return False
            self.back_to(("table",))
            part = "table"
        if not part:
            return False
        if tag in ("caption", "colgroup", "col") or tag in GROUPS:
            self.back_to(("table",))
            if tag == "col":
                self.insert("colgroup")
            self.insert(tag, values)
            if tag == "caption":
                self.active.append(None)
            return True
        if tag == "tr" or tag in CELLS:
            if part == "table":
                self.back_to(("table",))
                self.insert("tbody")
            elif part == "group" or tag == "tr":
                self.back_to(GROUPS if part == "group" or self.in_scope(GROUPS, TABLE_SCOPE) else ("table",))
            if tag != "tr":
                if part == "tr":
                    self.back_to(("tr",))
                else:
                    self.insert("tr")
                self.active.append(None)
                self.insert(tag, values)
            else:
                self.insert(tag, values)
            return True
        if tag == "table":
            self.pop_until(("table",))
            return self.table_start(tag, values) if self.within["table"] else False
        if tag in ("style", "script", "template"):
            return False
        if tag == "input" and values.get("type", "").lower() == "hidden":
            self.insert(tag, values)
            return True
        if tag == "form":
            if self.form is None:
                self.form = self.insert(tag, values)
                self.pop_to(len(self.stack) - 1)
            return True
        self.fostering = True
        self.body_start(tag, values, False)
        self.fostering = False
        return True

    def body_start(self, tag: str, values: dict[str, str], closed: bool) -> None:
        if tag in ENDS_P:
            if tag == "form":
                if self.form is not None:
                    return
                self.close_p()
                self.form = self.insert(tag, values)
                return
            self.close_p()
            if tag in HEADING and self.stack[-1].tag in HEADING:
                self.pop_to(len(self.stack) - 1)
            if tag == "xmp":
                self.reconstruct()
            node = self.insert(tag, values)
            self.skip_newline = tag in ("pre", "listing")
            self.raw = node if tag == "xmp" else None
            return
        if tag in ("li", "dd", "dt"):
            ends = ("li",) if tag == "li" else ("dd", "dt")
            for k in range(len(self.stack) - 1, 2, -1):
                name = self.stack[k].tag
                if name in ends:
                    self.imply_ends(name)
                    self.pop_to(k)
                    break
                if name in SPECIAL and name not in ("address", "div", "p"):
                    break
            self.close_p()
            self.insert(tag, values)
            return
        if tag in FORMATTING:
            if tag == "a":
                old = next((n for n in reversed(self.active[self.place_of(None, self.active) + 1 :]) if n.tag == "a"), None)
                if old is not None:
                    self.adopt("a")
                    if (k := self.place_of(old, self.active)) >= 0:
                        del self.active[k]
                    if old.open:
                        del self.stack[self.place_of(old, self.stack)]
                        self.closed(old)
            self.reconstruct()
            if tag == "nobr" and self.in_scope(("nobr",)):
                self.adopt("nobr")
                self.reconstruct()
            self.remember(self.insert(tag, values))
            return
        if tag in TABLE_PARTS or tag in ("frame", "frameset"):
            return
        if tag == "table":
            if self.doctype.lower().startswith("doctype html"):
                self.close_p()
            self.insert(tag, values)
            return
        if tag in ("param", "source", "track", "script", "style", "title", "link", "meta", "base", "template", "noframes", "textarea"):
            node = self.insert(tag, values)
            self.raw = node if tag in RAW_TEXT else None
            self.skip_newline = tag == "textarea"
            if tag == "template":
                self.active.append(None)
            return
        if tag == "button" and self.in_scope(("button",)):
            self.imply_ends()
            self.pop_until(("button",))
        elif tag in ("option", "optgroup") and self.stack[-1].tag == "option":
            self.pop_to(len(self.stack) - 1)
        elif tag in ("rb", "rtc", "rp", "rt") and self.in_scope(("ruby",)):
            self.imply_ends("rtc" if tag in ("rp", "rt") else "")
        elif tag == "image":
            tag = "img"
        self.reconstruct()
        node = self.insert(tag, values, foreign=tag in ("svg", "math"))
        if tag in MARKED:
            self.active.append(None)
        elif node.foreign and closed:
            self.pop_to(len(self.stack) - 1)
        elif tag in RAW_TEXT:
            self.raw = node

    # --- end tags

    def end(self, tag: str) -> None:
        self.skip_newline = False
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self.head in self.stack:
                self.stack = [self.root, self.html]
            return
        if self.body is None:
            if tag not in ("br", "p"):
                for k in range(len(self.stack) - 1, 2, -1):
                    if self.stack[k].tag == tag:
                        return self.pop_to(k)
                return
            self.ensure("body")
        if self.within["#foreign"] and self.stack[-1].foreign:
            for k in range(len(self.stack) - 1, 2, -1):
                if not self.stack[k].foreign:
                    break
                if self.stack[k].tag == tag:
                    return self.pop_to(k)
        if self.within["select"] and self.in_scope(("select",), TABLE_SCOPE):
            return self.select_end(tag)
        if self.within["table"] and self.table_end(tag):
            return
        self.body_end(tag)

    def select_end(self, tag: str) -> None:
        if tag == "optgroup" and self.stack[-1].tag == "option" and self.stack[-2].tag == "optgroup":
            self.pop_to(len(self.stack) - 2)
        elif tag in ("option", "optgroup"):
            if self.stack[-1].tag == tag:
                self.pop_to(len(self.stack) - 1)
        elif tag in ("select", "template"):
            self.pop_until((tag,))
        elif (tag in TABLE_PARTS or tag == "table") and self.in_scope((tag,), TABLE_SCOPE):
            self.pop_until(("select",))
            self.end(tag)

    def table_end(self, tag: str) -> bool:
        part = self.part()
        if not part or tag == "template":
            return False
        if part in ("cell", "caption"):
            if tag in (CELLS if part == "cell" else ("caption",)):
                if self.in_scope((tag,), TABLE_SCOPE):
                    self.imply_ends()
                    self.pop_until((tag,))
                    self.clear_to_marker()
                return True
            if tag == "table" or part == "cell" and (tag in GROUPS or tag == "tr"):
                if not self.in_scope((tag,), TABLE_SCOPE):
                    return True
                if part == "cell":
                    self.close_cell()
                else:
                    self.imply_ends()
                    self.pop_until(("caption",))
                    self.clear_to_marker()
                return self.table_end(tag)
            return tag in TABLE_PARTS
        if part == "colgroup":
            if tag == "col":
                return True
            self.back_to(("table",))
            return True if tag == "colgroup" else self.table_end(tag)
        if tag == "table":
            self.pop_until(("table",))
            return True
        if tag in TABLE_PARTS:
            if (tag == "tr" and part == "tr" or tag in GROUPS and part in ("tr", "group")) and self.in_scope((tag,), TABLE_SCOPE):
                self.pop_until((tag,))
            return True
        self.fostering = True
        self.body_end(tag)
        self.fostering = False
        return True

    def body_end(self, tag: str) -> None:
        if tag == "p":
            if not self.in_scope(("p",), BUTTON_SCOPE):
                self.insert("p")
            self.close_p()
        elif tag in CLOSED_AS_BLOCK:
            if self.in_scope((tag,)):
                self.imply_ends()
                self.pop_until((tag,))
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in ("li", "dd", "dt"):
            if self.in_scope((tag,), LIST_SCOPE if tag == "li" else SCOPE):
                self.imply_ends(tag)
                self.pop_until((tag,))
        elif tag in HEADING:
            if self.in_scope(HEADING):
                self.imply_ends()
                self.pop_until(HEADING)
        elif tag == "form":
            node, self.form = self.form, None
            if node is not None and node.open and self.in_scope(("form",)):
                self.imply_ends()
                del self.stack[self.place_of(node, self.stack)]
                self.closed(node)
        elif tag in MARKED or tag == "template":
            if self.in_scope((tag,), SCOPE - {tag}):
                self.imply_ends()
                self.pop_until((tag,))
                self.clear_to_marker()
        elif tag == "br":
            self.reconstruct()
            self.insert("br")
        else:
            self.end_other(tag)

    def end_other(self, tag: str) -> None:
        if not self.within[tag] and not self.within["#foreign"]:
            return
        for k in range(len(self.stack) - 1, 2, -1):
            node = self.stack[k]
            if node.tag == tag:
                self.imply_ends(tag)
                return self.pop_to(k)
            if node.tag in SPECIAL and not node.foreign:
                return

    # --- text

    def text(self, data: str) -> None:
        if self.skip_newline:
            data, self.skip_newline = data.removeprefix("\n"), False
            if not data:
                return
        if self.body is None:
            if not data.strip(SPACE):
                return
            self.ensure("body")
        parent = self.stack[-1]
        if parent.tag in FOSTERS and data.strip(SPACE) and not parent.foreign:
            self.fostering = True
            self.reconstruct()
            into, at = self.spot(self.stack[-1])
            add_text(into.children, at, data)
            self.fostering = False
            return
        if parent.tag == "colgroup" and data.strip(SPACE):
            self.back_to(("table",))
            return self.text(data)
        if self.active and parent.tag not in FOSTERS:
            self.reconstruct()
            parent = self.stack[-1]
        children = parent.children
        if children and isinstance(children[-1], str):
            children[-1] += data
        else:
            children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    root = builder.feed(html)
    if builder.doctype:
        root.attrs["doctype"] = builder.doctype
    return root


def serialize(node: Node) -> str:
    out: list[str] = []
    stack: list[Node | str | tuple[str]] = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, tuple):
            out.append(n[0])
            continue
        if isinstance(n, str):
            out.append(escape(n, quote=False))
            continue
        if n.tag != "#document":
            out.append("<" + n.tag + "".join(f' {k}="{escape(v)}"' for k, v in n.attrs.items()) + ">")
            if n.tag not in VOID or n.foreign:
                stack.append((f"</{n.tag}>",))
        elif "doctype" in n.attrs:
            out.append(f"<!{n.attrs['doctype']}>")
        raw = n.tag in ("script", "style", "noscript", "iframe", "xmp", "noembed", "noframes")
        stack.extend((c,) if raw and isinstance(c, str) else c for c in reversed(n.children))
    return "".join(out)
