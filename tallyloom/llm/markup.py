"""Documents in Markdown, HTML, wiki markup or LaTeX, also mixed, parsed into one kind of tree.

Every parser gives the same nodes: what a block is made of, its text as a reader of the
rendered page sees it, the nodes below it, and where it came from. Markup inside code is
never parsed; comments, styles, labels, tables and leading front matter become nodes
whose content isn't shown.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

#: Signs of the private use area around what is kept aside while the text around it is parsed.
CODE_KEPT, KEPT_END, PLACED = "\ue000", "\ue001", "\ue002"


@dataclass
class Node:
    """``kind`` is what the syntax says; ``origin`` the syntax itself; ``attrs`` tokens of attributes; ``rows`` the lines of a table."""

    kind: str
    origin: str
    text: str = ""
    raw: int = 0
    attrs: tuple[str, ...] = ()
    children: list[Node] = field(default_factory=list)
    rows: list[str] = field(default_factory=list)

    def add(self, node: Node) -> Node:
        self.children.append(node)
        return node


def squeeze(text: str) -> str:
    """Runs of white space as one blank, ends trimmed."""
    return " ".join(text.split())


def _masked(source: str) -> str:
    """A document without what can't be markup of its own."""
    return _MASKED.sub("\n", source) if "`" in source or "~~~" in source or "<" in source or "\\begin" in source else source


#: Where a row and a cell of a table begin; both are white space.
ROW, CELL = "\x1d", "\x1f"


def table_rows(said: str, inline: Callable[[str], str]) -> list[str]:
    """The rows of a table as lines, with the text a reader sees of each cell; empty cells and rows are left out."""
    rows = ([inline(cell) for cell in row.split(CELL)] for row in said.split(ROW))
    return [" | ".join(filter(None, cells)) for cells in rows if any(cells)]


_KEPT = re.compile(f"{CODE_KEPT}(\\d+){KEPT_END}")


class Kept:
    """Pieces of a text that are kept aside, each behind a sign of the private use area."""

    def __init__(self):
        self.pieces: list[str] = []

    def put(self, piece: str) -> str:
        self.pieces.append(piece)
        return f"{CODE_KEPT}{len(self.pieces) - 1}{KEPT_END}"

    def restore(self, text: str) -> str:
        if CODE_KEPT not in text:
            return text
        before = None
        while before != text:
            before, text = text, _KEPT.sub(lambda m: self.pieces[int(m[1])], text)
        return text


# --- HTML -----------------------------------------------------------------------------------------

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<![A-Za-z][^>]*>|<\?.*?\?>|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:\s+(?:[^\s\"'<>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?|/))*)\s*(?P<self>/?)>", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_HIDDEN = frozenset(("style", "script", "head", "template", "noscript", "title"))
_VOID = frozenset(("br", "hr", "img", "input", "meta", "link", "col", "wbr", "area", "base"))
_BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section style script summary table tbody td tfoot th thead tr ul head title".split())
_HTML_MATH = re.compile(r"\\\((?P<a>.+?)\\\)|\\\[(?P<b>.+?)\\\]|\$\$(?P<c>.+?)\$\$|(?<![\\$\w])\$(?=[^\s$])(?P<d>[^$\n]*?[^\s$\\])\$(?![\d$\w])", re.S)


def _attrs(said: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(said or "")}


def take_math(text: str, kept: Kept, into: Node, origin: str, pattern: re.Pattern = _HTML_MATH) -> str:
    """``text`` with its formulas kept aside, each a node below ``into``."""
    if "$" not in text and "\\" not in text and "<" not in text:
        return text

    def found(m: re.Match) -> str:
        source = squeeze(kept.restore(next(g for g in m.groups() if g is not None)))
        into.add(Node("formula", f"{origin}:math:inline" if m.lastgroup in ("a", "d") else f"{origin}:math:display", source, len(m[0])))
        return kept.put(source)

    return pattern.sub(found, text)


_ENTITY = re.compile(r"&#?\w+;")
_H = frozenset(f"h{k}" for k in range(1, 7))


def parse_html(source: str, root: Node, origin: str = "html") -> None:
    """The blocks of an HTML fragment, below ``root``."""
    stack: list[tuple[str, Node, list]] = [("", root, [])]
    hidden: list[str] = []
    pre: list | None = None
    inline_code = 0
    kept = Kept()

    def cell(said: str) -> str:
        return squeeze(kept.restore(take_math(said, kept, Node("", ""), origin)))

    def close_text(entry) -> None:
        name, node, parts = entry
        if node.kind == "table":
            node.rows += table_rows("".join(parts), cell)
        said = take_math("".join(parts), kept, node, origin)
        said = squeeze(kept.restore(said))
        if node.kind in ("heading", "list_item"):
            node.text = said
        elif said and node is not root:
            node.text = squeeze(f"{node.text} {said}")
        elif said:
            root.children.append(Node("paragraph", f"{origin}:text:bare", said, len(said)))
        parts.clear()

    def pop_to(names) -> None:
        while len(stack) > 1 and stack[-1][0] not in names:
            close_text(stack.pop())

    def open_names() -> list[str]:
        return [entry[0] for entry in stack]

    def text(said: str) -> None:
        if pre is not None:
            pre.append(html.unescape(said))
        elif inline_code:
            stack[-1][2].append(kept.put(html.unescape(said)))
        else:
            # an escaped sign is no delimiter of a formula
            stack[-1][2].append(_ENTITY.sub(lambda m: kept.put(html.unescape(m[0])), said) if "&" in said else said)

    at = 0
    for m in _TAG.finditer(source):
        if not hidden:
            text(source[at : m.start()])
        at = m.end()
        if m["cdata"] is not None and not hidden:
            text(m["cdata"])
        name = (m["name"] or "").lower()
        if not name:
            if m[0].startswith("<!--") and not hidden:
                stack[-1][1].add(Node("hidden", f"{origin}:hidden:comment", "", len(m[0])))
            continue
        closing = bool(m["close"])
        if hidden:
            if closing and name == hidden[-1]:
                hidden.pop()
            continue
        if pre is not None:
            if closing and name == "pre":
                node = stack[-1][1].add(Node("code_block", f"{origin}:code:pre", squeeze("".join(pre)), sum(map(len, pre)), pre_attrs))
                node.raw = max(node.raw, 1)
                pre = None
            elif name == "br":
                pre.append("\n")
            continue
        if name in _HIDDEN and not m["self"]:
            if not closing:
                hidden.append(name)
                stack[-1][1].add(Node("hidden", f"{origin}:hidden:{name}", "", len(m[0])))
            continue
        attrs = _attrs(m["attrs"]) if m["attrs"] else {}
        tokens = tuple(sorted(f"{k}={v}" if k == "class" else k for k, v in attrs.items())) if attrs else ()
        if name in ("code", "kbd", "samp", "tt", "var"):
            inline_code = max(0, inline_code + (-1 if closing else 1))
        elif name == "img":
            text(attrs.get("alt", ""))
        elif name in ("br", "wbr", "hr"):
            stack[-1][2].append(" " if name != "wbr" else "")
        elif name == "pre":
            if not closing:
                pre, pre_attrs = [], tokens
        elif name in _H:
            if closing:
                if any(n in _H for n in open_names()):
                    pop_to([n for n in open_names() if n in _H][-1:])
                    close_text(stack.pop())
            else:
                pop_to([n for n in open_names() if n in ("", "li", "td", "th", "div", "section", "article", "main", "body", "blockquote")])
                stack.append((name, stack[-1][1].add(Node("heading", f"{origin}:h:{name[1]}", "", len(m[0]), tokens)), []))
        elif name in ("ul", "ol", "menu"):
            if closing:
                if {"ul", "ol", "menu"} & set(open_names()):
                    pop_to(("ul", "ol", "menu"))
                    close_text(stack.pop())
            else:
                if stack[-1][0] == "p":
                    close_text(stack.pop())
                stack.append((name, stack[-1][1].add(Node("list", f"{origin}:list:{name}", "", len(m[0]), tokens)), []))
        elif name == "li":
            names = open_names()
            lists = [i for i, n in enumerate(names) if n in ("ul", "ol", "menu")]
            items = [i for i, n in enumerate(names) if n == "li"]
            if items and (not lists or items[-1] > lists[-1]):
                pop_to(("li",))
                close_text(stack.pop())
            if not closing:
                open_list = next((n for n in reversed(open_names()) if n in ("ul", "ol", "menu")), "bare")
                stack.append((name, stack[-1][1].add(Node("list_item", f"{origin}:li:{open_list}", "", len(m[0]), tokens)), []))
        elif name in ("table", "td", "th", "tr", "caption", "thead", "tbody", "tfoot"):
            if name == "table":
                if closing:
                    if "table" in open_names():
                        pop_to(("table",))
                        _, node, parts = stack.pop()
                        node.rows += table_rows("".join(parts), cell)
                else:
                    stack.append((name, stack[-1][1].add(Node("table", f"{origin}:table:table", "", len(m[0]), tokens)), []))
            else:
                stack[-1][2].append(CELL if name in ("td", "th") else ROW)
        elif name == "p":
            if closing:
                if stack[-1][0] == "p":
                    close_text(stack.pop())
                else:
                    stack[-1][2].append(" ")
            elif stack[-1][0] in ("li", "p"):
                stack[-1][2].append(" ")
            elif stack[-1][0] not in _H:
                stack.append((name, stack[-1][1].add(Node("paragraph", f"{origin}:text:p", "", len(m[0]), tokens)), []))
        elif name in _BLOCK_TAGS:
            stack[-1][2].append(" ")
    if not hidden and pre is None:
        text(source[at:])
    elif pre is not None:
        stack[-1][1].add(Node("code_block", f"{origin}:code:pre", squeeze("".join(pre) + html.unescape(source[at:])), 1, pre_attrs))
    while stack:
        close_text(stack.pop())


# --- Markdown ---------------------------------------------------------------------------------------

_MD_TOKEN = re.compile(
    r"(?P<code>(?P<ticks>(?<!`)`+(?!`))(?P<said>.+?)(?<!`)(?P=ticks)(?!`))"
    r"|(?P<comment><!--.*?(?:-->|\Z))"
    r"|\\\((?P<m1>.+?)\\\)|\\\[(?P<m2>.+?)\\\]|\$\$(?P<m3>.+?)\$\$|(?<![$\w])\$(?=[^\s$])(?P<m4>[^$\n]*?[^\s$\\])\$(?![\d$\w])"
    r"|\\(?P<escape>[!-/:-@\[-`{-~])"
    r"|<(?P<auto>[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+\.[\w.-]+)>"
    r"|(?P<entity>&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)",
    re.S,
)
_MD_SIGNS = re.compile(r"[\\`*_\[\]<&!$~]")
_MD_IMAGE = re.compile(r"!\[([^\[\]]*)\](?:\([^()]*(?:\([^()]*\)[^()]*)*\)|\[[^\[\]]*\])?")
_MD_WIKI = re.compile(r"\[\[([^\[\]|]*)(?:\|([^\[\]]*))?\]\]")
_MD_LINK = re.compile(r"\[([^\[\]]*)\]\(\s*(?:<[^<>]*>|[^()\s]*(?:\([^()]*\)[^()\s]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
_MD_FOOTNOTE = re.compile(r"\[\^[^\[\]\s]+\]")
_MD_REF = re.compile(r"\[([^\[\]]+)\]\[([^\[\]]*)\]")
_MD_SHORT = re.compile(r"\[([^\[\]]+)\]")
_MD_STAR = re.compile(r"(?<!\*)(\*{1,3})(?=[^\s*])(.*?[^\s*]|[^\s*])\1(?!\*)", re.S)
_MD_UNDER = re.compile(r"(?<![\w_])(_{1,3})(?=[^\s_])(.*?[^\s_]|[^\s_])\1(?![\w_])", re.S)
_MD_STRIKE = re.compile(r"~~(?=\S)(.+?)(?<=\S)~~", re.S)


def md_inline(source: str, node: Node, refs: frozenset[str] | set[str] = frozenset(), origin: str = "md") -> str:
    """The text a reader sees; formulas become nodes below ``node``."""
    if not _MD_SIGNS.search(source):
        return squeeze(source)
    kept = Kept()

    def token(m: re.Match) -> str:
        if m["code"]:
            said = m["said"].replace("\n", " ")
            return kept.put(said[1:-1] if said[0] == said[-1] == " " and said.strip() else said)
        if m["comment"]:
            node.add(Node("hidden", f"{origin}:hidden:comment", "", len(m[0])))
            return ""
        if m["escape"]:
            return kept.put(m["escape"])
        if m["auto"]:
            return kept.put(m["auto"])
        if m["entity"]:
            return kept.put(html.unescape(m["entity"]))
        name = next(g for g in ("m1", "m2", "m3", "m4") if m[g] is not None)
        source = squeeze(m[name])
        node.add(Node("formula", f"{origin}:math:inline" if name in ("m1", "m4") else f"{origin}:math:display", source, len(m[0])))
        return kept.put(source)

    text = _MD_TOKEN.sub(token, source)

    def tag(m: re.Match) -> str:
        name = (m["name"] or "").lower()
        if name == "img":
            return kept.put(_attrs(m["attrs"]).get("alt", ""))
        return " " if name in ("br", "hr", "p", "div") else ""

    if "<" in text:
        text = _TAG.sub(tag, text)
    if "[" in text:
        text = _MD_IMAGE.sub(lambda m: m[1], text)
        text = _MD_FOOTNOTE.sub("", text)
        text = _MD_WIKI.sub(lambda m: m[2] if m[2] is not None else m[1], text)
        before = None
        while before != text and "[" in text:
            before = text
            text = _MD_LINK.sub(lambda m: m[1], text)
            text = _MD_REF.sub(lambda m: m[1] if (m[2] or m[1]).casefold() in refs else m[0], text)
        if refs:
            text = _MD_SHORT.sub(lambda m: m[1] if squeeze(m[1]).casefold() in refs else m[0], text)
    before = None
    while before != text and ("*" in text or "_" in text or "~~" in text):
        before = text
        text = _MD_STAR.sub(lambda m: m[2], text)
        text = _MD_UNDER.sub(lambda m: m[2], text)
        text = _MD_STRIKE.sub(lambda m: m[1], text)
    return squeeze(kept.restore(text))


_MD_FENCE = re.compile(r"^( *)(`{3,}(?=[^`]*$)|~{3,})(.*)$")
_MD_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_MD_ITEM_SIGNS = frozenset("-+*0123456789")
_MD_ITEM = re.compile(r"^([ \t]*)([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*))?$")
_MD_RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_MD_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_MD_MATH = re.compile(r"^\s*(\$\$|\\\[)")
_MD_QUOTE = re.compile(r"^ {0,3}(?:> ?)+")
_MD_OPEN_TAG = re.compile(r"<[A-Za-z][^<>]*$")
_MD_DEFINITION = re.compile(r"^ {0,3}\[([^\]]+)\]:[ \t]*\S+")
_MD_TABLE = re.compile(r"^ {0,3}\|.*\|[ \t]*$|^ {0,3}:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?$")
_MD_HTML = re.compile(r"^ {0,3}</?(?P<name>[A-Za-z][A-Za-z0-9-]*)(?=[\s/>])|^ {0,3}<!--|^ {0,3}<![A-Z]|^ {0,3}<\?")
_HTML_START = frozenset(_BLOCK_TAGS | {"iframe", "link", "meta", "base", "caption", "col", "colgroup", "legend", "optgroup", "option", "param", "source", "track", "math", "video"})

#: The line below a table's head.
_MD_TABLE_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def _columns(blank: str) -> int:
    return len(blank.expandtabs(4))


def _html_region(lines: list[str], at: int) -> int:
    """The line after an HTML block that begins at a line."""
    first = lines[at]
    opened = _MD_HTML.match(first)
    name = (opened["name"] or "").lower() if opened else ""
    end = None
    if first.lstrip().startswith("<!--"):
        end = "-->"
    elif name in ("pre", "style", "script") and not first.lstrip().startswith("</"):
        end = f"</{name}>"
    if end:
        for i in range(at, len(lines)):
            if end in lines[i].lower():
                return i + 1
        return len(lines)
    depth, i = 0, at
    while i < len(lines):
        line = lines[i]
        if not line.strip() and depth <= 0:
            return i
        for m in re.finditer(r"<(/?)(ul|ol|table|pre|div|body|html)(?=[\s>/])", line, re.I):
            depth += -1 if m[1] else 1
        i += 1
    # unbalanced: up to the first blank line
    for i in range(at, len(lines)):
        if not lines[i].strip():
            return i
    return len(lines)


@dataclass
class _Item:
    node: Node
    indent: int
    offset: int
    parts: list[str] = field(default_factory=list)


def parse_markdown(source: str, root: Node) -> None:
    """The blocks of Markdown with HTML in it, below ``root``."""
    lines = source.split("\n")
    refs = {squeeze(m[1]).casefold() for m in map(_MD_DEFINITION.match, lines) if m} if "]:" in source else set()
    items: list[_Item] = []
    paragraph: list[str] = []
    blank = True
    i = 0

    def flush() -> None:
        if paragraph:
            node = root.add(Node("paragraph", "md:text:bare", "", sum(map(len, paragraph))))
            node.text = md_inline("\n".join(paragraph), node, refs)
            paragraph.clear()

    def close(count: int) -> None:
        while len(items) > count:
            item = items.pop()
            said = re.sub(r"^\[[ xX]\](?=\s|$)", "", "\n".join(item.parts).lstrip())
            item.node.text = md_inline(said, item.node, refs)
            item.node.raw += sum(map(len, item.parts))

    def here() -> Node:
        return items[-1].node if items else root

    while i < len(lines):
        line = lines[i]
        if not line.strip():
            flush()
            blank = True
            i += 1
            continue
        bare = line.lstrip(" \t")
        # what a line can begin is told by its first sign
        lead = bare[:1]
        indent = _columns(line[: len(line) - len(bare)]) if len(bare) < len(line) else 0
        if blank and items:
            # after a blank line only deeper lines and further items go on
            keep = len(items)
            while keep and indent < items[keep - 1].offset:
                keep -= 1
            marker = _MD_ITEM.match(line) if lead in _MD_ITEM_SIGNS else None
            if not (marker and marker[3] is not None and not _MD_RULE.match(line)):
                close(keep)
        base = items[-1].offset if items and indent >= items[-1].offset else 0
        fence = _MD_FENCE.match(line) if lead in "`~" else None
        if fence and indent - base < 4:
            if not items or indent < items[-1].offset:
                close(sum(1 for x in items if indent >= x.offset))
            flush()
            mark, j, body = fence[2], i + 1, []
            while j < len(lines) and not re.match(rf"^ {{0,{3 + base}}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[j]):
                body.append(lines[j])
                j += 1
            info = tuple(fence[3].split()[:2])
            if info and info[0].lower() in ("math", "latex-math"):
                here().add(Node("formula", "md:math:fence", squeeze("\n".join(body)), 1, info))
            else:
                here().add(Node("code_block", "md:code:fence" if mark[0] == "`" else "md:code:tilde", squeeze("\n".join(body)), sum(map(len, body)), info))
            i, blank = j + 1, False
            continue
        marker = _MD_ITEM.match(line) if lead in _MD_ITEM_SIGNS else None
        rule = _MD_RULE.match(line) if lead in "-*_" else None
        if marker and marker[3] is None and not (items or blank):
            marker = None
        if marker and marker[2][:-1].isdigit() and paragraph and not items and marker[2][:-1] != "1":
            marker = None
        in_item = bool(items) and (bool(items[-1].parts) and not blank)
        if marker and not rule and (indent < 4 or items) and not (indent - base >= 4 and not in_item and not items):
            flush()
            while items and indent < items[-1].offset and indent <= items[-1].indent + 1:
                close(len(items) - 1)
            width = _columns(marker[3] or " ")
            parent = here()
            ordered = marker[2][0].isdigit()
            origin = "md:list:ol" if ordered else f"md:list:ul{marker[2]}"
            if not parent.children or parent.children[-1].kind != "list" or parent.children[-1].origin != origin:
                parent.add(Node("list", origin))
            node = parent.children[-1].add(Node("list_item", origin.replace(":list:", ":li:")))
            items.append(_Item(node, indent, indent + len(marker[2]) + (width if 1 <= width <= 4 else 1)))
            said = marker[4] or ""
            if re.match(r"^(`{3,}|~{3,})", said) or (said.startswith("<pre") and "</pre>" not in said):
                # a code block opens in the item's first line
                lines[i] = " " * items[-1].offset + said
                blank = False
                continue
            items[-1].parts.append(said)
            blank = False
            i += 1
            continue
        if lead in "=-" and not items and paragraph and _MD_SETEXT.match(line):
            node = root.add(Node("heading", "md:h:setext" + line.strip()[0], "", sum(map(len, paragraph))))
            node.text = md_inline("\n".join(paragraph), node, refs)
            paragraph.clear()
            i, blank = i + 1, True
            continue
        atx = _MD_ATX.match(line[base:] if base else line) if lead == "#" else None
        if atx and indent - base < 4:
            if not base:
                close(0)
            flush()
            node = here().add(Node("heading", f"md:h:{len(atx[1])}", "", len(line)))
            said = atx[2] or ""
            node.text = md_inline("" if re.fullmatch(r"#+", said) else said, node, refs)
            i, blank = i + 1, True
            continue
        if rule:
            flush()
            close(0)
            i, blank = i + 1, True
            continue
        opened = _MD_HTML.match(line) if lead == "<" else None
        if opened and (opened["name"] is None or opened["name"].lower() in _HTML_START):
            if not base:
                close(0)
            flush()
            j = _html_region(lines, i)
            parse_html("\n".join(lines[i:j]), here(), "html")
            i, blank = j, True
            continue
        math = _MD_MATH.match(line) if lead in "$\\" else None
        if math and (blank or not paragraph):
            end = "$$" if math[1] == "$$" else "\\]"
            joined, j = line.lstrip()[2:], i + 1
            while end not in joined and j < len(lines) and lines[j].strip():
                joined += "\n" + lines[j]
                j += 1
            if end in joined:
                said, rest = joined.split(end, 1)
                if not base:
                    close(0)
                flush()
                if said.strip():
                    here().add(Node("formula", "md:math:display", squeeze(said), len(joined)))
                if rest.strip():
                    lines[j - 1] = rest
                    i, blank = j - 1, False
                else:
                    i, blank = j, True
                continue
        if "|" in line and _MD_TABLE.match(line) and not in_item:
            flush()
            close(0)
            node = root.add(Node("table", "md:table:table", "", len(line)))
            while i < len(lines) and "|" in lines[i] and lines[i].strip():
                node.raw += len(lines[i])
                if not _MD_TABLE_RULE.match(lines[i]):
                    said = re.sub(r"(?<!\\)\|", CELL, lines[i]).replace("\\|", "|")
                    node.rows += table_rows(said, lambda cell: md_inline(cell, Node("", ""), refs))
                i += 1
            blank = True
            continue
        if lead == "[" and _MD_DEFINITION.match(line) and not paragraph and not in_item:
            root.add(Node("hidden", "md:hidden:definition", "", len(line)))
            i += 1
            continue
        if not items and not paragraph and indent >= 4:
            body, j = [], i
            while j < len(lines) and (not lines[j].strip() or _columns(lines[j][: len(lines[j]) - len(lines[j].lstrip(" \t"))]) >= 4):
                body.append(lines[j])
                j += 1
            root.add(Node("code_block", "md:code:indented", squeeze("\n".join(body)), sum(map(len, body))))
            i, blank = j, True
            continue
        in_tag = bool(paragraph) and "<" in paragraph[-1] and _MD_OPEN_TAG.search(paragraph[-1])
        said = (_MD_QUOTE.sub("", line) if lead == ">" else line) if not items and not in_tag else line.strip()
        if items:
            if blank and items[-1].parts:
                if indent - items[-1].offset >= 4:
                    body, j = [], i
                    while j < len(lines) and (not lines[j].strip() or _columns(lines[j][: len(lines[j]) - len(lines[j].lstrip(" \t"))]) >= items[-1].offset + 4):
                        body.append(lines[j])
                        j += 1
                    here().add(Node("code_block", "md:code:indented", squeeze("\n".join(body)), sum(map(len, body))))
                    i, blank = j, True
                    continue
            items[-1].parts.append(said)
        else:
            paragraph.append(said)
        blank = False
        i += 1
    flush()
    close(0)


# --- wiki markup ------------------------------------------------------------------------------------

_WIKI_CODE = re.compile(r"<(syntaxhighlight|source|pre)(?P<attrs>(?:\s[^>]*)?)>(?P<said>.*?)</\1\s*>", re.S | re.I)
_WIKI_SIGNS = re.compile(r"[<\[{&_]|''")
_WIKI_HEADING = re.compile(r"^(={1,6})(.+?)(={1,6})\s*((?:<!--.*?-->\s*)*)$")
_WIKI_MATH = re.compile(r"<(?:math|chem)(?:\s[^>]*)?>(?P<a>.*?)</(?:math|chem)\s*>", re.S | re.I)
_WIKI_FILE = re.compile(r"\[\[\s*(?:File|Image|Datei|Fichier|Archivo|Media)\s*:([^\[\]]*(?:\[\[[^\[\]]*\]\][^\[\]]*)*)\]\]", re.I)


def _wiki_picture(m: re.Match) -> str:
    parts = m[1].split("|")[1:]
    for part in parts:
        if part.strip().lower().startswith("alt="):
            return part.split("=", 1)[1]
    said = [p for p in parts if not re.fullmatch(r"\s*(?:thumb|thumbnail|frame|frameless|border|left|right|center|none|upright(?:=.*)?|\d*x?\d+px|link=.*|class=.*|lang=.*|page=.*)\s*", p)]
    return said[-1] if said else ""


def wiki_inline(source: str, node: Node) -> str:
    """The text a reader sees of a line of wiki markup."""
    if not _WIKI_SIGNS.search(source):
        return squeeze(source)
    kept = Kept()
    text = source
    text = re.sub(r"<nowiki>(.*?)</nowiki>", lambda m: kept.put(html.unescape(m[1])), text, flags=re.S | re.I)
    text = re.sub(r"<nowiki\s*/>", "", text, flags=re.I)
    text = re.sub(r"<(code|tt|kbd|samp)(?:\s[^>]*)?>(.*?)</\1\s*>", lambda m: m[2], text, flags=re.S | re.I)
    text = take_math(text, kept, node, "wiki", _WIKI_MATH)
    text = re.sub(r"<ref(?:\s[^>]*)?/>|<ref(?:\s[^>]*)?>.*?</ref>", "", text, flags=re.S | re.I)
    before = None
    while before != text:
        before = text
        text = re.sub(r"\{\{[^{}]*\}\}", "", text)
    text = _WIKI_FILE.sub(_wiki_picture, text)
    text = re.sub(r"\[\[\s*(?:Category|Kategorie|Catégorie|Categoría)\s*:[^\[\]]*\]\]", "", text, flags=re.I)
    text = re.sub(r"\[\[([^\[\]|]*)(?:\|([^\[\]]*))?\]\]", lambda m: m[2] if m[2] else m[1].lstrip(":"), text)
    text = re.sub(r"\[(?:https?:|ftp:|mailto:|//)[^\s\[\]]*(?:\s+([^\[\]]*))?\]", lambda m: m[1] or "", text)
    text = re.sub(r"'{2,5}", "", text)
    text = re.sub(r"__(?:NO)?(?:TOC|EDITSECTION|INDEX|GALLERY|FORCETOC)__", "", text)

    def tag(m: re.Match) -> str:
        return " " if (m["name"] or "").lower() in ("br", "hr", "p", "div") else ""

    text = _TAG.sub(tag, text)
    return squeeze(kept.restore(html.unescape(text)))


def _wiki_cells(lines: list[str]) -> str:
    """The lines of a wiki table below its first, with signs where rows and cells begin; attributes are left out."""
    out, captioned = [], False
    for line in lines:
        said = line.strip()
        if said.startswith(("{|", "|-")):
            out.append(ROW)
        elif said.startswith("|}"):
            out.append(ROW + said[2:])
        elif said.startswith(("|", "!")):
            caption = said.startswith("|+")
            cells = re.split(r"\|\||!!" if said[0] == "!" else r"\|\|", said[1 + caption :])
            out.append((ROW if caption or captioned else CELL) + CELL.join(re.sub(r"^[^\[\]{}|]*=[^\[\]{}|]*\|", "", cell) for cell in cells))
            captioned = caption
        else:
            out.append(" " + said)
    return "".join(out)


_WIKI_PLACED = re.compile(f"{PLACED}c(\\d+){KEPT_END}\\s*")


def parse_wiki(source: str, root: Node) -> None:
    """The blocks of wiki markup, below ``root``."""
    codes: list[Node] = []

    def code(m: re.Match) -> str:
        said = m["said"] if m[1].lower() != "pre" else html.unescape(re.sub(r"</?nowiki>", "", m["said"]))
        codes.append(Node("code_block", f"wiki:code:{m[1].lower()}", squeeze(said), len(m[0]), tuple(m["attrs"].split())))
        return f"\n{PLACED}c{len(codes) - 1}{KEPT_END}\n"

    source = re.sub(r"<!--.*?(?:-->|\Z)", "", _WIKI_CODE.sub(code, source), flags=re.S)
    source = re.sub(r"<(style|script)\b.*?</\1\s*>", "", source, flags=re.S | re.I)
    # formulas that are set off over several lines stay in one line
    source = _WIKI_MATH.sub(lambda m: m[0].replace("\n", " "), source)
    lines, i = source.split("\n"), 0
    paragraph: list[str] = []
    levels: list[Node] = []

    def flush() -> None:
        if paragraph:
            node = root.add(Node("paragraph", "wiki:text:bare", "", sum(map(len, paragraph))))
            node.text = wiki_inline("\n".join(paragraph), node)
            paragraph.clear()

    while i < len(lines):
        line = lines[i]
        i += 1
        placed = _WIKI_PLACED.fullmatch(line) if PLACED in line else None
        if placed:
            flush()
            root.add(codes[int(placed[1])])
            continue
        if not line.strip():
            flush()
            levels.clear()
            continue
        heading = _WIKI_HEADING.match(line.rstrip())
        if heading:
            flush()
            levels.clear()
            level = min(len(heading[1]), len(heading[3]))
            node = root.add(Node("heading", f"wiki:h:{level}", "", len(line)))
            said = "=" * (len(heading[1]) - level) + heading[2] + "=" * (len(heading[3]) - level)
            node.text = wiki_inline(said, node)
            continue
        if re.match(r"^\s*:*\{\|", line):
            flush()
            node = root.add(Node("table", "wiki:table:table", "", len(line)))
            depth, first = 1, i
            while i < len(lines) and depth:
                depth += bool(re.match(r"^\s*\{\|", lines[i])) - bool(re.match(r"^\s*\|\}", lines[i]))
                node.raw += len(lines[i])
                i += 1
            said = re.sub(f"{PLACED}c(\\d+){KEPT_END}", lambda c: codes[int(c[1])].text, _wiki_cells(lines[first:i]))
            node.rows = table_rows(said, lambda cell: wiki_inline(cell, Node("", "")))
            continue
        item = re.match(r"^([*#:;]*[*#])\s*(.*)$", line)
        if item:
            flush()
            depth = len(item[1])
            del levels[depth:]
            while len(levels) < depth:
                parent = root if not levels else (levels[-1].children[-1] if levels[-1].children else levels[-1])
                levels.append(parent.add(Node("list", f"wiki:list:{item[1][len(levels)]}")))
            node = levels[-1].add(Node("list_item", f"wiki:li:{item[1][-1]}", "", len(line)))
            node.text = wiki_inline(item[2], node)
            continue
        levels.clear()
        if line.startswith(" ") and not paragraph and line.strip() and not line.lstrip().startswith("<"):
            body = [line[1:]]
            while i < len(lines) and lines[i].startswith(" ") and lines[i].strip():
                body.append(lines[i][1:])
                i += 1
            root.add(Node("code_block", "wiki:code:space", squeeze("\n".join(body)), sum(map(len, body))))
            continue
        if re.match(r"^-{4,}\s*$", line):
            flush()
            continue
        paragraph.append(re.sub(r"^[:;]+\s*", "", line))
    flush()


# --- LaTeX ------------------------------------------------------------------------------------------

_TEX_VERBATIM = re.compile(r"(?m)^(?P<lead>(?:[^%\n]|\\%)*?)\\begin\{(?P<env>verbatim\*?|Verbatim\*?|lstlisting|minted|alltt)\}(?P<opts>(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?(?:\[[^\]\n]*\])?)(?P<said>(?s:.*?))\\end\{(?P=env)\}")
_TEX_MATH_ENVS = r"equation|align|gather|multline|displaymath|math|eqnarray|flalign|alignat"
_TEX_MATH = re.compile(
    rf"\\begin\{{(?:{_TEX_MATH_ENVS})(?P<s>\*?)\}}(?P<e>.*?)\\end\{{(?:{_TEX_MATH_ENVS})(?P=s)\}}|(?<!\\)\\\[(?P<b>.+?)\\\]|(?<!\\)\\\((?P<a>.+?)\\\)|(?<!\\)\$\$(?P<c>.+?)(?<!\\)\$\$|(?<!\\)\$(?P<d>[^$]+?)(?<!\\)\$",
    re.S,
)
_TEX_TOKEN = re.compile(
    r"\\begin\{(?P<begin>[A-Za-z*]+)\}(?P<opts>(?:\[[^\]]*\])?)|\\end\{(?P<end>[A-Za-z*]+)\}"
    r"|\\(?P<section>part|chapter|section|subsection|subsubsection|paragraph|subparagraph)(?P<star>\*?)\s*(?:\[[^\]]*\])?\s*\{"
    r"|\\item(?![A-Za-z])[ \t]*(?P<item>(?:\[[^\]]*\])?)|\ue002c(?P<code>\d+)\ue001|\ue002f(?P<formula>\d+)\ue001|(?P<gap>\n[ \t]*\n)"
)
_TEX_DROP = frozenset("label ref eqref pageref autoref cref Cref cite citep citet index vspace hspace includegraphics footnote footnotetext thanks pagestyle thispagestyle setlength bibliography bibliographystyle input include usepackage documentclass title author date newcommand renewcommand".split())
_TEX_SIGNS = {"textbackslash": "\\", "ldots": "…", "dots": "…", "textasciitilde": "~", "textasciicircum": "^", "quad": " ", "qquad": " ", "newline": " ", "par": " ", "LaTeX": "LaTeX", "TeX": "TeX", "textendash": "–", "textemdash": "—", "S": "§", "copyright": "©", "ss": "ß", "textless": "<", "textgreater": ">", "textbar": "|", "textunderscore": "_", "space": " "}
_TEX_SIGNS_IN = re.compile(f"[\\\\{{}}~`{PLACED}{CODE_KEPT}]|--|''")
_TEX_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307"}


def _braced(text: str, at: int) -> int:
    """The end of the group whose content begins at a place, the closing brace."""
    depth = 1
    while at < len(text):
        if text[at] == "\\":
            at += 2
            continue
        depth += (text[at] == "{") - (text[at] == "}")
        if not depth:
            return at
        at += 1
    return len(text)


def tex_inline(source: str, formulas: list[Node]) -> str:
    """The text a reader sees of LaTeX, without blocks."""
    if not _TEX_SIGNS_IN.search(source):
        return squeeze(source)
    kept = Kept()
    text = re.sub(r"\\verb\*?([^\sA-Za-z*])(.*?)\1", lambda m: kept.put(m[2]), source)
    text = re.sub(f"{PLACED}f(\\d+){KEPT_END}", lambda m: kept.put(formulas[int(m[1])].text), text)
    text = re.sub(r"\\([%&#$_{}])", lambda m: kept.put(m[1]), text)
    text = re.sub(r"\\(?:\\\*?(?:\[[^\]]*\])?|[,;:! ])", " ", text)
    text = re.sub(r"\\(['`^\"~=.])\{?([A-Za-z])\}?", lambda m: unicodedata.normalize("NFC", m[2] + _TEX_ACCENTS[m[1]]), text)

    def command(text: str) -> str:
        out, at = [], 0
        for m in iter(lambda: re.compile(r"\\([A-Za-z]+)\*?").search(text, at), None):
            out.append(text[at : m.start()])
            at, name = m.end(), m[1]
            opts = re.compile(r"\s*\[[^\]]*\]").match(text, at)
            if opts and (name in _TEX_DROP or text[opts.end() : opts.end() + 1] == "{"):
                at = opts.end()
            groups = []
            while text[at : at + 1] == "{":
                end = _braced(text, at + 1)
                groups.append(text[at + 1 : end])
                at = end + 1
                if name not in ("href", "textcolor", "colorbox", "newcommand", "renewcommand", "setlength", "hyperref") or len(groups) == 2:
                    break
            if name in _TEX_SIGNS:
                out.append(_TEX_SIGNS[name])
                if not groups:
                    at += len(re.compile(r"[ \t]*").match(text, at)[0])
                elif groups[0]:
                    out.append(command(groups[0]))
            elif name in _TEX_DROP:
                pass
            elif groups:
                out.append(command(groups[-1]))
            else:
                at += len(re.compile(r"[ \t]*\n?[ \t]*").match(text, at)[0])
        return "".join([*out, text[at:]])

    text = command(text)
    text = text.replace("~", " ").replace("---", "—").replace("--", "–").replace("``", "“").replace("''", "”")
    text = re.sub(r"[{}]", "", text)
    return squeeze(kept.restore(text))


def _tex_rows(said: str, formulas: list[Node]) -> list[str]:
    """The rows of a part of a LaTeX table; what its columns and lines look like is left out."""
    said = re.sub(r"\\(?:cline|cmidrule|addlinespace|multicolumn|multirow)\*?(?:\([^)]*\))?(?:\[[^\]]*\])?(?:\{[^{}]*\})?", lambda m: "\\multi" if m[0].startswith("\\multi") else " ", said)
    said = re.sub(r"\\multi(?:\[[^\]]*\])?\{[^{}]*\}(?:\[[^\]]*\])?", "", said)
    said = re.sub(r"(?<!\\)((?:\\\\)*)&", lambda m: m[1] + CELL, said)
    return table_rows(re.sub(r"\\\\\*?(?:\[[^\]]*\])?|\\tabularnewline(?![A-Za-z])", ROW, said), lambda cell: tex_inline(cell, formulas))


def parse_latex(source: str, root: Node) -> None:
    """The blocks of LaTeX, below ``root``."""
    codes: list[Node] = []
    formulas: list[Node] = []

    def code(m: re.Match) -> str:
        said, opts = m["said"], m["opts"]
        if m["env"] not in ("minted", "lstlisting", "Verbatim", "Verbatim*") and opts:
            said = opts + said
        codes.append(Node("code_block", f"tex:code:{m['env']}", squeeze(said), len(m[0]), (opts,) if opts else ()))
        return f"{m['lead']}{PLACED}c{len(codes) - 1}{KEPT_END}"

    while True:
        text = _TEX_VERBATIM.sub(code, source)
        if text == source:
            break
        source = text
    source = re.sub(r"(?m)^[ \t]*%.*(?:\n|\Z)", "", source)
    source = re.sub(r"(?m)(?<!\\)%.*(?:\n[ \t]*|\Z)", "", source)
    source = re.sub(r"\\begin\{comment\}.*?\\end\{comment\}", "", source, flags=re.S)
    if r"\begin{document}" in source:
        head, source = source.split(r"\begin{document}", 1)
        root.add(Node("hidden", "tex:hidden:preamble", "", len(head)))
        source = source.split(r"\end{document}", 1)[0]
    verbs: list[str] = []

    def verb(m: re.Match) -> str:
        verbs.append(m[0])
        return f"{PLACED}v{len(verbs) - 1}{KEPT_END}"

    source = re.sub(r"\\verb\*?([^\sA-Za-z*])(.*?)\1", verb, source)

    def formula(m: re.Match) -> str:
        said = next(m[g] for g in "eabcd" if m[g] is not None)
        said = re.sub(r"\\label\{[^}]*\}", "", re.sub(f"{PLACED}v(\\d+){KEPT_END}", lambda v: verbs[int(v[1])], said))
        origin = "env" if m["e"] is not None else "inline" if m["a"] is not None or m["d"] is not None else "display"
        formulas.append(Node("formula", f"tex:math:{origin}", squeeze(said), len(m[0])))
        return f"{PLACED}f{len(formulas) - 1}{KEPT_END}"

    source = _TEX_MATH.sub(formula, source)
    source = re.sub(f"{PLACED}v(\\d+){KEPT_END}", lambda m: verbs[int(m[1])], source)
    stack: list[tuple[str, Node, list[str]]] = [("", root, [])]

    def close_text(entry) -> None:
        name, node, parts = entry
        if node.kind == "table":
            node.rows += _tex_rows("".join(parts), formulas)
        said = tex_inline("".join(parts), formulas)
        if node.kind == "list_item":
            node.text = said
        elif said and node.kind != "table":
            node.add(Node("paragraph", "tex:text:bare", said, len(said)))
        parts.clear()

    at = 0
    while True:
        m = _TEX_TOKEN.search(source, at)
        stack[-1][2].append(source[at : m.start() if m else len(source)])
        if not m:
            break
        at = m.end()
        inside_table = any(x[1].kind == "table" for x in stack)
        if m["gap"] is not None:
            if stack[-1][1].kind == "list_item":
                stack[-1][2].append(" ")
            else:
                close_text(stack[-1])
        elif m["code"] is not None:
            stack[-1][1].add(codes[int(m["code"])])
            stack[-1][2].append(" ")
        elif m["formula"] is not None:
            if not inside_table:
                stack[-1][1].add(formulas[int(m["formula"])])
            stack[-1][2].append(m[0])
        elif m["section"]:
            end = _braced(source, at)
            title = source[at:end]
            at = min(end + 1, len(source))
            while stack[-1][1].kind == "list_item":
                close_text(stack.pop())
            close_text(stack[-1])
            node = stack[-1][1].add(Node("heading", f"tex:h:{m['section']}", tex_inline(title, formulas), len(m[0]), ("starred",) if m["star"] else ()))
            for k in re.findall(f"{PLACED}f(\\d+){KEPT_END}", title):
                node.add(formulas[int(k)])
        elif m["begin"]:
            name = m["begin"]
            if name in ("itemize", "enumerate", "description", "compactitem", "compactenum"):
                if stack[-1][1].kind != "list_item":
                    close_text(stack[-1])
                stack.append((name, stack[-1][1].add(Node("list", f"tex:list:{name}", "", 0, (m["opts"],) if m["opts"] else ())), []))
            elif name.rstrip("*") in ("tabular", "tabularx", "longtable", "array"):
                stack.append((name, stack[-1][1].add(Node("table", f"tex:table:{name}", "", 0)), []))
                for _ in range(1 + name.startswith("tabularx") + name.startswith("tabular*")):
                    opened = re.compile(r"\s*(?:\[[^\]]*\])?\s*\{").match(source, at)  # the width, and how the columns are set
                    if opened and (end := _braced(source, opened.end())) < len(source):
                        at = end + 1
            else:
                close_text(stack[-1]) if stack[-1][1].kind != "list_item" else None
                stack.append((name, stack[-1][1], []))
        elif m["end"]:
            names = [x[0] for x in stack]
            if m["end"] in names:
                while stack[-1][0] != m["end"]:
                    close_text(stack.pop())
                entry = stack.pop()
                if entry[1].kind == "list":
                    entry[2].clear()
                elif entry[1].kind == "list_item":
                    stack[-1][2].append("".join(entry[2]))
                else:
                    close_text(entry)
        else:
            lists = [k for k, x in enumerate(stack) if x[1].kind == "list"]
            if not lists:
                continue
            while len(stack) - 1 > lists[-1]:
                close_text(stack.pop())
            stack[-1][2].clear()
            label = m["item"]
            node = stack[-1][1].add(Node("list_item", stack[-1][1].origin.replace(":list:", ":li:"), "", len(m[0]), ("label",) if label else ()))
            stack.append(("item", node, [label[1:-1] + " "] if label and stack[-1][0] == "description" else []))
    while stack:
        close_text(stack.pop())


# --- which markup -----------------------------------------------------------------------------------

_MASKED = re.compile(r"(?ms)^ {0,3}(`{3,}|~{3,}).*?(?:^ {0,3}\1[`~]*[ \t]*$|\Z)|<(pre|syntaxhighlight|source|style|script)\b.*?(?:</\2\s*>|\Z)|\\begin\{(verbatim|lstlisting|minted|Verbatim)\}.*?\\end\{\3\}|<!--.*?(?:-->|\Z)")
_TEX_SIGNALS = re.compile(r"(?m)\\(?:documentclass|usepackage|(?:sub)*section\*?\s*[\[{]|begin\{|end\{|item\b|chapter\*?\{|textbf\{|emph\{|texttt\{|href\{|verb\b|label\{)")
# Signs of wiki markup and Markdown: at the start of a line, by its first sign, and inside lines, by what they can't be without.
_WIKI_STARTS = {
    "=": re.compile(r"={1,6}[^=\n].*?=+[ \t]*$"), "{": re.compile(r"\{\|"), "|": re.compile(r"\|\}"), ":": re.compile(r":+<math"), "*": re.compile(r"\*\*+[^*\n]+$|[*#]+[^\s*#`!-]"), "#": re.compile(r"[*#]+[^\s*#`!-]"),
}
_WIKI_INSIDE = (("''", re.compile(r"'''?[^'\n]+'''?")), ("[http", re.compile(r"\[https?://\S+ [^\]\n]*\]")), ("<math>", re.compile("<math>")), ("<nowiki>", re.compile("<nowiki>")), ("{{", re.compile(r"\{\{[^}\n]+\}\}")))
_MD_STARTS = {
    "#": re.compile(r"#{1,6} "), "=": re.compile(r"=+[ \t]*$"), "-": re.compile(r"- +\S|-{3,}[ \t]*$"), "+": re.compile(r"\+ +\S"), "|": re.compile(r"\|[-:| ]+\|$"), **dict.fromkeys("0123456789", re.compile(r"\d+[.)] +\S")),
}
_MD_INSIDE = (("](", re.compile(r"\]\([^)\n]*\)")), ("**", re.compile(r"\*\*[^*\n]+\*\*")), ("__", re.compile(r"__[^_\n]+__")), ("~~", re.compile(r"~~[^~\n]+~~")), ("`", re.compile(r"(?<!`)`[^`\n]+`")))


def _signs(bare: str) -> tuple[int, int]:
    """How many signs of wiki markup and of Markdown a text has."""
    wiki = sum(len(pattern.findall(bare)) for sign, pattern in _WIKI_INSIDE if sign in bare)
    md = sum(len(pattern.findall(bare)) for sign, pattern in _MD_INSIDE if sign in bare)
    for line in bare.split("\n"):
        if line and (pattern := _WIKI_STARTS.get(line[0])) and pattern.match(line):
            wiki += 1
        said = line.lstrip(" ") if line[:1] == " " else line
        if said and len(line) - len(said) < 4 and (pattern := _MD_STARTS.get(said[0])) and pattern.match(said):
            md += 1
    return wiki, md


_WIKI_CODES = re.compile(r"<(?:syntaxhighlight|source)\b", re.I)


def host_markup(source: str) -> str:
    """tex, wiki or md: the markup that most of a document's blocks are written in; HTML is read as part of md."""
    bare = _masked(source)
    tex = 0
    if "\\" in source:
        tex = len(_TEX_SIGNALS.findall(bare)) + 2 * len(_TEX_CODE_BEGINS.findall(source)) * (r"\section" in bare or r"\begin{document}" in source)
    wiki_heads = len(_WIKI_HEADS.findall(bare)) if "=" in bare else 0
    wiki_codes = len(_WIKI_CODES.findall(source)) if "<" in source else 0
    wiki, md = _signs(bare)
    wiki += 2 * wiki_codes + 2 * wiki_heads
    # number signs start list items in wiki markup and headings in Markdown
    md += 2 * (len(_FENCE_LINES.findall(source)) if "```" in source or "~~~" in source else 0) // 2
    if wiki_heads or wiki_codes:
        md -= len(_NUMBER_LINES.findall(bare))
    markup = len(_HTML_LINES.findall(source)) if "<" in source else 0
    if tex > max(wiki, md, markup):
        return "tex"
    if wiki > max(md, 0) and wiki > markup:
        return "wiki"
    return "md"


_TEX_CODE_BEGINS = re.compile(r"\\begin\{(?:verbatim|lstlisting|minted)\}")
_WIKI_HEADS = re.compile(r"(?m)^={1,6}[^=\n].*?[^=\n]?={1,6}[ \t]*(?:<!--.*)?$")
_FENCE_LINES = re.compile(r"(?m)^ {0,3}(?:`{3,}|~{3,})")
_NUMBER_LINES = re.compile(r"(?m)^# [^\n]*$")
_HTML_LINES = re.compile(r"(?mi)^\s*<(?:h[1-6]|p|ul|ol|li|pre|div|table)\b")

# What can only be a block of another markup than that of the document around it.
_WIKI_BLOCK = r"^={2,6}[ \t]*[^=\s][^=\n]*[^=\n]={2,6}[ \t]*$"
_TEX_BLOCK = r"^[ \t]*\\(?:chapter|(?:sub){0,2}section)\*?\{[^\n]*\}[ \t]*$|^[ \t]*\\begin\{(?P<env>itemize|enumerate|description|verbatim|lstlisting|minted)\}(?s:.*?)\\end\{(?P=env)\}[ \t]*$"
_FENCE_BLOCK = r"^ {0,3}(?P<fence>`{3,}|~{3,})[^`\n]*\n(?s:.*?)^ {0,3}(?P=fence)[`~]*[ \t]*$"
_FOREIGN = {
    "md": (("wiki", re.compile(rf"(?m){_WIKI_BLOCK}"), "=="), ("tex", re.compile(rf"(?m){_TEX_BLOCK}"), "\\")),
    "wiki": (("tex", re.compile(rf"(?m){_TEX_BLOCK}"), "\\"), ("md", re.compile(rf"(?m)(?:^#{{1,6}} [^\n]*\n\n?)*(?:^- \S[^\n]*(?:\n|\Z))+|{_FENCE_BLOCK}"), "")),
    "tex": (("md", re.compile(rf"(?m)^#{{1,6}}[ \t]+\S[^\n]*$|{_FENCE_BLOCK}"), ""), ("wiki", re.compile(rf"(?m){_WIKI_BLOCK}"), "==")),
}


_WITHOUT_TEX = re.compile(r"(?:\n(?![#=`~])[^\\$%\n]*(?=\n|\Z))*")


def segments(source: str, host: str) -> list[tuple[str, str]]:
    """``(markup, text)`` of a document block by block: blocks that can only be of another markup, and those of its host between them.

    Nothing inside code, comments and the like is cut out.
    """
    found = [(m.start(), m.end(), markup) for markup, pattern, sign in _FOREIGN[host] if sign in source for m in pattern.finditer(source)]
    if not found:
        return [(host, source)]
    masked = [m.span() for m in _MASKED.finditer(source)]
    out, at = [], 0
    for start, end, markup in sorted(found):
        whole = [(a, b) for a, b in masked if a < end and start < b]
        if start < at or any(not (start <= a and b <= end + 1) for a, b in whole):
            continue
        if host == "tex" and not whole:
            # what follows a heading of another markup is of that markup too, as long as no line has a sign of LaTeX
            end = _WITHOUT_TEX.match(source, end).end()
        out += [(host, source[at:start]), (markup, source[start:end])]
        at = end
    out.append((host, source[at:]))
    return [(markup, text) for markup, text in out if text.strip()]


def parse(body: str | None) -> Node:
    """The tree of a document; a root without children for null and blank ones."""
    root = Node("root", "root")
    if not body or not body.strip():
        return root
    source = body.replace("\r\n", "\n").replace("\r", "\n").lstrip("\ufeff")
    # signs the parsers use themselves are others while they work
    taken = [sign for sign in (CODE_KEPT, KEPT_END, PLACED) if sign in source]
    others = [c for c in map(chr, range(0xF0000, 0xF0000 + len(source) + 3)) if c not in source][: len(taken)] if taken else []
    if taken:
        source = source.translate({ord(a): b for a, b in zip(taken, others)})
    front = re.match(r"\s*---[ \t]*\n(.*?\n)?(?:---|\.\.\.)[ \t]*(?:\n|\Z)", source, re.S)
    if front and (front[1] is None or re.search(r"(?m)^[\w-]+[ \t]*:", front[1])):
        root.add(Node("hidden", "front:hidden:matter", "", len(front[0])))
        source = source[front.end() :]
    host = host_markup(source)
    for markup, text in segments(source, host):
        {"tex": parse_latex, "wiki": parse_wiki, "md": parse_markdown}[markup](text, root)
    root.origin = f"root:{host}"
    root.raw = len(source)
    if taken:
        back = {ord(b): a for a, b in zip(taken, others)}
        for node, _ in walk(root):
            node.text, node.rows = node.text.translate(back), [r.translate(back) for r in node.rows]
    return root


#: The kinds of nodes that are listed.
LISTED = ("heading", "list_item", "code_block", "formula")


def walk(node: Node):
    """``(node, depth)`` in the order of the document."""
    todo = [(node, 0)]
    while todo:
        at, depth = todo.pop()
        yield at, depth
        todo += [(child, depth + 1) for child in reversed(at.children)]
