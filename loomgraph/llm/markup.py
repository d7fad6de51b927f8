"""Markup left in texts: what there is of HTML, Markdown, wiki and LaTeX, and clean text that keeps structure.

Blocks are marked from the outside in: code, formulas, tables, lists and headings, so that signs within one are
not read again. The whole text is then one tree, in which HTML elements are nodes with all they hold, and so are
the blocks of the other markups. Its body is the subtree of the largest sum of child densities, density being
characters for each tag corrected for links; on the way to it nodes thinner than any on the path are left out, but none
that holds a block. Elements are read from the nodes of the body, and the clean text is made of them.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from loomgraph.session import distinct_records

MARKUPS = ("html", "markdown", "wiki", "latex")
ELEMENTS = ("heading", "list", "code", "formula", "table")

# Tags of HTML and MathML, commands of LaTeX.
_TAGS = (
    "a abbr address article aside b blockquote body br caption center code col colgroup dd del details div dl dt em fieldset figcaption figure font "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main map mark math meta mfrac mi mn mo mrow msqrt msub "
    "msup mtable mtd mtr nav noscript ol option p pre q s samp script section select small source span strike strong style sub summary sup svg table "
    "tbody td textarea tfoot th thead title tr tt u ul var video wbr"
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSED_BY = {"li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_TAG = re.compile(rf"</?(?:{'|'.join(sorted(_TAGS.split(), key=len, reverse=True))})(?:\s[^<>]*)?/?>", re.I)
_ENTITY = re.compile(r"&(?:#\d{2,6}|#x[0-9a-f]{2,5}|[a-z]{2,8}\d?);", re.I)
_COMMENT = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>|<!\[CDATA\[.*?\]\]>", re.S | re.I)
_COMMANDS = (
    "textbf textit texttt textsc textrm textsf textsl emph underline href url cite citep citet citealp ref eqref pageref autoref cref label footnote "
    "footnotetext caption includegraphics input include usepackage documentclass bibliography bibliographystyle mathbb mathrm mathcal mathbf frac sqrt "
    "section subsection subsubsection paragraph subparagraph chapter part title author date thanks vspace hspace textcolor color mbox text item begin end"
)
_BARE = (
    "noindent ldots dots cdots newline newpage clearpage pagebreak linebreak medskip bigskip smallskip centering hfill vfill maketitle tableofcontents "
    "item quad qquad par em bf it tt sc rm sf small large Large footnotesize normalsize textbackslash LaTeX TeX leq geq times alpha beta gamma in to"
)
_LATEX_INLINE = re.compile(
    rf"\\(?:{'|'.join(_COMMANDS.split())})\*?\s*(?:\[[^\]]*\])?\{{|\\(?:{'|'.join(_BARE.split())})(?![A-Za-z_\\])|\\\\\[[^\]\n]{{1,8}}\]|\\\\(?=\s*$)"
    r"|\\[,;!](?=[\\\s\w])|\{\\(?:em|bf|it|tt|sc|rm|sf|small|large)\b|``[^`\n]+''|~\\",
    re.M,
)
_LATEX_MATH = re.compile(
    r"\\\[.+?\\\]|\\\(.+?\\\)|\$\$.+?\$\$|\\begin\{(equation|align|gather|multline|displaymath|math|eqnarray)\*?\}.*?\\end\{\1\*?\}", re.S
)
_DOLLAR = re.compile(r"(?<![\\$`\w])\$(?![\s$`\d])([^$\n`]+?)(?<!\s)\$(?![\w$`])|(?<![\\$`\w])\$(\d*\s*[A-Za-z\\^_{=][^$\n`]*?)(?<!\s)\$(?![\w$`])")
_CODE_LINE = re.compile(
    r"^\s*(?:(?:def|class|import|from|return|for|while|if|elif|else|try|except|with|async|await|lambda|print|raise|yield)\b.*[:()\]]|(?:SELECT|FROM|WHERE|INSERT|UPDATE|"
    r"DELETE|CREATE|JOIN|GROUP BY|ORDER BY|AND|LIMIT|HAVING|VALUES|SET)\b.*|(?:public|private|static|void|int|const|let|var|func|function|package|use|#include|fn)\b.*"
    r"|[\w.\[\]]+\s*(?:[-+*/]?=|:=)\s*\S.*|[\w.]+\(.*\);?|[{}\])];?.*|.*[;{]|#.*|//.*|--\s.*|/\*.*|\*/|\s{2,}\S.*|@\w+.*|\$\s\S.*)$"
)
_SURE_CODE = re.compile(r"^\s*(?:def \w+\(|class \w+|return\b|import \w|for \(|SELECT .*\w|\w.*\{$|.*;$|\}|from \w+ import|\w+ = |#include|func \w+\()")


# Without one of these there is no markup.
_SIGN = re.compile(r"[<{|\\$#*`=~_\[&]|^[ \t]*(?:[-+;:>]|\d{1,3}[.)])[ \t]|^-{3,}|''", re.M)
# A list of one item stands apart from the text around it.
_MD_ITEM = r"[ \t]*(?:[-*+]|\d{1,3}[.)])[ \t]+(?!\d+[ \t]*[-*+]?[ \t]*$)\S[^\n]*"
_MD_LIST = rf"(?:^{_MD_ITEM}(?:\n|\Z)){{2,}}|(?:(?<=\n\n)|\A)^{_MD_ITEM}(?=\n[ \t]*\n|\n?\Z)"


def is_source_code(text: str) -> bool:
    """Whether the text as a whole is source code: nearly all lines read as code, and some surely do."""
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return False
    code = sum(1 for x in lines if _CODE_LINE.match(x))
    return code >= 0.9 * len(lines) and any(_SURE_CODE.match(x) for x in lines) and not re.search(r"^(?:```|~~~|\\begin|<pre|\{\{code)", text, re.M)


_HELD = re.compile("\ue000(\\d+)\ue001")


class Block:
    """What a place of the text was taken out for: its markup and element, its source and its clean form."""

    __slots__ = ("clean", "element", "markup", "source")

    def __init__(self, markup: str, element: str, source: str, clean: str) -> None:
        self.markup, self.element, self.source, self.clean = markup, element, source, clean


class Node:
    __slots__ = ("block", "chars", "children", "density", "holds", "link_chars", "link_tags", "tag", "tags")

    def __init__(self, tag: str, block: int = -1) -> None:
        self.tag, self.block, self.children = tag, block, []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density, self.holds = 0.0, block >= 0


class _Builder(HTMLParser):
    """Nodes of a text; places of blocks become nodes, which hold the tree of their source if that is HTML."""

    def __init__(self, blocks: list[Block]) -> None:
        super().__init__(convert_charrefs=True)
        self.root, self.blocks = Node("body"), blocks
        self.stack = [self.root]
        self.waiting: list[Node] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while len(self.stack) > 1 and self.stack[-1].tag in _CLOSED_BY.get(tag, ()):
            self.stack.pop()
        node = Node(tag)
        if tag == "span" and any(k == "class" and v and "math" in v for k, v in attrs):
            node.tag = "math"
        self.stack[-1].children.append(node)
        if tag not in _VOID:
            self.stack.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag or (tag == "span" and self.stack[i].tag == "math"):
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        self.put(self.stack[-1], data)

    def put(self, parent: Node, text: str) -> None:
        end = 0
        for m in _HELD.finditer(text):
            if int(m[1]) < len(self.blocks):
                if m.start() > end:
                    parent.children.append(text[end : m.start()])
                parent.children.append(Node("#block", int(m[1])))
                self.waiting.append(parent.children[-1])
                end = m.end()
        if end < len(text):
            parent.children.append(text[end:])

    def read(self, parent: Node, text: str, is_html: bool) -> None:
        if not is_html:
            self.put(parent, text)
            return
        self.reset()
        self.stack = [parent]
        self.feed(text)
        self.close()


def parse_html(text: str, blocks: list[Block] | None = None, is_html: bool = True) -> Node:
    """The tree of a text, unclosed and stray tags included; texts without tags are one node.

    blocks are those that places of the text, and of other blocks, stand for. A block of HTML has the tree of
    its source below it, any other its clean form.
    """
    builder = _Builder(blocks or [])
    builder.read(builder.root, text, is_html)
    while builder.waiting:
        node = builder.waiting.pop()
        own = builder.blocks[node.block]
        builder.read(node, *((own.source, True) if own.markup == "html" else (own.clean, False)))
    _measure(builder.root)
    return builder.root


def _below(root: Node) -> list[Node]:
    """The node and all below it, parents first."""
    order = [root]
    for node in order:
        order += [c for c in node.children if isinstance(c, Node)]
    return order


def _measure(root: Node) -> None:
    order = _below(root)
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c.strip())
            else:
                node.holds = node.holds or c.holds
                node.chars += c.chars
                node.link_chars += c.chars if c.tag == "a" else c.link_chars
                node.tags += (c.block < 0) + c.tags
                node.link_tags += (c.tag == "a") + c.link_tags
    for node in order:
        node.density = text_density(node, root)


def text_density(node: Node, body: Node) -> float:
    """Composite text density: characters for each tag, less where links prevail over the text."""
    c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
    if not c:
        return 0.0
    plain = max(1, c - node.link_chars)
    base = math.log(c / plain * node.link_chars + body.link_chars / max(1, body.chars) * c + math.e)
    ratio = c / lc * t / lt
    return c / t * (math.log(ratio) / math.log(base) if ratio > 0 and base > 1.0 else max(0.0, math.log(max(ratio, 1e-9))))


def body_nodes(root: Node) -> list[Node | str]:
    """The content: the subtree of maximal density sum, and beside the way to it what holds a block or is not thinner than any node on it."""
    best, path, most = root, [root], -math.inf
    stack = [(root, None)]
    while stack:
        node, way = stack.pop()
        way = (node, way)
        total = sum(c.density if isinstance(c, Node) else len(c.strip()) for c in node.children)
        if total > most:
            best, path, most = node, way, total
        stack += [(c, way) for c in node.children if isinstance(c, Node) and c.block < 0]
    if best is root:
        return [root]
    nodes = []
    while path is not None:
        nodes.append(path[0])
        path = path[1]
    nodes.reverse()
    least = min(n.density for n in nodes)
    out: list[Node | str] = []
    for node, below in zip(nodes, nodes[1:], strict=False):
        for c in node.children:
            if c is below:
                if below is best:
                    out.append(best)
            elif isinstance(c, str) or c.holds or c.density >= least:
                out.append(c)
    return out


_OWN_TEXT = re.compile(r"h[1-6]|pre|math|li|td|th|tr")


def render(top: Node | str) -> str:
    """Text of a node with headings, lists, code, formulas and tables kept in plain signs, blocks as their places.

    Depth is bounded by nothing but the text, so the way down is kept in a list.
    """
    if isinstance(top, str):
        return top
    buffers: list[list[str]] = [[]]
    stack: list[tuple[Node | str, bool]] = [(top, False)]
    while stack:
        node, left = stack.pop()
        if isinstance(node, str):
            buffers[-1].append(node)
            continue
        tag = node.tag
        if left:
            if not _OWN_TEXT.fullmatch(tag):
                buffers[-1].append("\n\n")
                continue
            inner = "".join(buffers.pop())
            flat = " ".join(inner.split())
            if tag[0] == "h":
                buffers[-1].append(f"\n\n{'#' * int(tag[1])} {flat}\n\n")
            elif tag == "pre":
                buffers[-1].append(f"\n\n```\n{inner.strip()}\n```\n\n")
            elif tag == "math":
                buffers[-1].append(f" ${flat}$ ")
            elif tag == "li":
                buffers[-1].append(f"\n- {flat}")
            elif tag == "tr":
                buffers[-1].append(f"\n| {inner} |")
            else:
                buffers[-1].append(flat if not buffers[-1] else f" | {flat}")
        elif node.block >= 0:
            buffers[-1].append(f"\ue000{node.block}\ue001")
        elif tag == "br":
            buffers[-1].append("\n")
        elif tag not in ("script", "style", "head"):
            own = _OWN_TEXT.fullmatch(tag) is not None
            spaced = tag in ("p", "div", "ul", "ol", "table", "section", "article", "blockquote", "dl")
            if own:
                buffers.append([])
            elif spaced:
                buffers[-1].append("\n\n")
            if own or spaced:
                stack.append((node, True))
            cells = tag == "tr"
            stack += [(c, False) for c in reversed(node.children) if not (cells and isinstance(c, str))]
    return "".join(buffers[0])


class _Scan:
    """Takes blocks out of a text and keeps what they were and their clean form."""

    def __init__(self, text: str) -> None:
        self.text, self.blocks = _HELD.sub("", text), []
        self.seen: set[str] = set()

    def block(self, pattern: str | re.Pattern, markup: str, element: str, clean, flags: int = re.M | re.S) -> None:
        def swap(m: re.Match) -> str:
            self.blocks.append(Block(markup, element, m[0], clean(m)))
            return f"\ue000{len(self.blocks) - 1}\ue001"

        self.text = re.sub(pattern, swap, self.text, flags=flags) if isinstance(pattern, str) else pattern.sub(swap, self.text)

    def inline(self, pattern: str | re.Pattern, markup: str, clean=None, flags: int = re.M) -> None:
        own = re.compile(pattern, flags) if isinstance(pattern, str) else pattern
        if own.search(self.text):
            self.seen.add(markup)
            if clean is not None:
                self.text = own.sub(clean, self.text)

    def read_body(self) -> set[tuple[str, str]]:
        """The text is reduced to its body; the elements of the nodes that this has."""
        is_html = _TAG.search(self.text) is not None
        body = body_nodes(parse_html(self.text, self.blocks, is_html))
        if is_html:
            self.seen.add("html")
            self.text = "".join(map(render, body))
        kept = [n for top in body if isinstance(top, Node) for n in _below(top) if n.block >= 0]
        return {(self.blocks[n.block].markup, self.blocks[n.block].element) for n in kept}

    def restored(self) -> str:
        # A block only holds places of earlier ones, so this ends.
        text, n = self.text, 1
        while n:
            text, n = _HELD.subn(lambda m: self.blocks[int(m[1])].clean, text)
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n)|(?<=\S)[ \t]{2,}(?=\S)", lambda m: " " if m.end() < len(text) and text[m.end()] != "\n" else "", text)).strip()


def _items(text: str, mark: str) -> str:
    rows = [re.sub(mark, "", x).strip() for x in text.strip("\n").split("\n")]
    return "\n".join(f"- {_stripped(x)}" for x in rows if x)


def _stripped(text: str) -> str:
    """Wiki, Markdown and LaTeX inline signs taken off."""
    text = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]|\{\{[^{}|]*\|([^{}]*)\}\}", lambda m: m[1] or m[2] or "", text)
    return re.sub(r"'{2,5}|(?<!\w)\*{1,3}(?=\S)|(?<=\S)\*{1,3}(?!\w)", "", text)


def _fence(body: str) -> str:
    body = body.strip("\n")
    return f"\n\n```\n{body}\n```\n\n"


def _rows(lines: list[list[str]]) -> str:
    return "\n\n" + "\n".join("| " + " | ".join(c.strip() for c in row) + " |" for row in lines if any(c.strip() for c in row)) + "\n\n"


def scan_markup(text: str | None) -> tuple[set[tuple[str, str]], str]:
    """((markup, element) pairs with 'none' for a markup without elements, the clean text).

    Null and blank texts and source code as a whole have no markup and stay as they are.
    """
    if not text or not text.strip() or is_source_code(text):
        return set(), text or ""
    if not _SIGN.search(text):
        return set(), text
    s = _Scan(text.replace("\r\n", "\n"))
    # Code, whatever it holds.
    s.block(r"^[ \t]*(`{3,}|~{3,})[ \t]*math[ \t]*\n(.*?)\n?^[ \t]*\1[ \t]*$", "markdown", "formula", lambda m: f"\n\n${m[2].strip()}$\n\n")
    s.block(r"^[ \t]*(`{3,}|~{3,})[^\n`]*\n(.*?)(?:\n?^[ \t]*\1[ \t]*$|\Z)", "markdown", "code", lambda m: _fence(m[2]))
    s.block(r"\\begin\{(lstlisting|verbatim\*?|minted|Verbatim|alltt)\}(?:\[[^\]]*\])?(?:\{[^}]*\})?(.*?)\\end\{\1\}", "latex", "code", lambda m: _fence(m[2]))
    s.block(r"\{\{\s*(?:code|syntaxhighlight|pre|source)\s*\|(?:[^={}|]*=[^|{}\n]*\|)*(?:1=)?(.*?)\n?\}\}(?=\s|$)", "wiki", "code", lambda m: _fence(m[1]))
    s.block(r"<(syntaxhighlight|source)\b[^>]*>(.*?)</\1>", "wiki", "code", lambda m: _fence(m[2]))
    s.block(r"<pre\b[^>]*>(?:\s*<code\b[^>]*>)?(.*?)(?:</code>\s*)?</pre>", "html", "code", lambda m: _fence(html.unescape(_TAG.sub("", m[1]))), re.S | re.I)
    s.block(r"<code\b[^>]*>([^<]*\n.*?)</code>", "html", "code", lambda m: _fence(html.unescape(m[1])), re.S | re.I)
    # Formulas.
    s.block(r"<math\b[^>]*>(?=\s*<)(.*?)</math>", "html", "formula", lambda m: f"${_TAG.sub('', m[1])}$", re.S | re.I)
    s.block(r"<math\b[^>]*>([^<]*)</math>", "wiki", "formula", lambda m: f"${m[1].strip()}$", re.S | re.I)
    s.block(r"""<(span|div)\b[^>]*class\s*=\s*["']?[^"'>]*math[^>]*>(.*?)</\1>""", "html", "formula", lambda m: f"${_TAG.sub('', m[2])}$", re.S | re.I)
    s.block(r"\$`([^`\n]+)`\$", "markdown", "formula", lambda m: f"${m[1]}$")
    s.block(r"\{\{\s*(?:math|mvar|formula)\s*\|(?:1=)?(.*?)\}\}", "wiki", "formula", lambda m: f"${m[1].strip()}$")
    s.block(_LATEX_MATH, "latex", "formula", lambda m: "$" + re.sub(r"^(?:\\\[|\\\(|\$\$|\\begin\{\w+\*?\})|(?:\\\]|\\\)|\$\$|\\end\{\w+\*?\})$", "", m[0]).strip() + "$")
    s.block(_DOLLAR, "latex", "formula", lambda m: m[0])
    # Tables.
    s.block(r"\\begin\{(tabular|longtable|array|tabularx)\*?\}(?:\{[^}]*\})*(.*?)\\end\{\1\*?\}", "latex", "table", lambda m: _rows([r.replace(r"\hline", "").split("&") for r in re.split(r"\\\\", m[2])]))
    s.block(r"^[ \t]*\{\|.*?^[ \t]*\|\}", "wiki", "table", lambda m: _rows([re.split(r"\|\||!!|\n[|!]", r.strip().lstrip("|!")) for r in re.split(r"^\|-.*$", re.sub(r"^\s*\{\|.*\n?|\|\}$", "", m[0]), flags=re.M)]))
    s.block(r"(?:^[ \t]*\|.*\n)?^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$(?:\n[ \t]*\|.*$)*", "markdown", "table", lambda m: _rows([r.strip().strip("|").split("|") for r in m[0].split("\n") if not re.fullmatch(r"[\s|:-]+", r)]), re.M)
    s.block(r"(?:^[ \t]*\|[^\n]*\|[ \t]*$\n?){2,}", "markdown", "table", lambda m: _rows([r.strip().strip("|").split("|") for r in m[0].split("\n")]), re.M)
    # A list counts once, whatever stands in its items, so it goes before headings and inline signs.
    s.block(r"<table\b.*?</table>", "html", "table", lambda m: render(parse_html(m[0])), re.S | re.I)
    s.block(r"<(ul|ol|dl)\b.*?(?:</\1>|\n[ \t]*\n|\Z)", "html", "list", lambda m: render(parse_html(m[0])) + "\n\n", re.S | re.I)
    s.block(r"(?:<li\b[^>]*>[^\n]*\n?)+", "html", "list", lambda m: render(parse_html(m[0])) + "\n\n", re.S | re.I)
    s.block(r"\\begin\{(itemize|enumerate|description)\}(?:\[[^\]]*\])?(.*?)(?:\\end\{\1\}|\Z)", "latex", "list", lambda m: "\n\n" + "\n".join(f"- {x.strip()}" for x in re.split(r"\\item(?:\[[^\]]*\])?", m[2]) if x.strip()) + "\n\n")
    wiki_mark = r"^[*#:;]+[ \t]*"
    wiki_item = r"(?:\*{2,}[ \t]+\S|[*#]+[ \t]*(?:\[\[|\{\{|'{2,5})|;[ \t]*[^\n]*:|:+[ \t]+\S)[^\n]*$"
    s.block(rf"(?:^{wiki_item}\n?)+", "wiki", "list", lambda m: "\n\n" + _items(m[0], wiki_mark) + "\n\n", re.M)
    # The heading of one # after blank lines is Markdown's; lists of one # are known by wiki signs above.
    s.block(r"^[ \t]{0,3}(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", "markdown", "heading", lambda m: f"\n\n{m[1]} {m[2]}\n\n", re.M)
    s.block(r"^(?=[^\n]*[^\s\ue001])([^\n]+)\n(={3,}|-{3,})[ \t]*$", "markdown", "heading", lambda m: f"\n\n{'#' if m[2][0] == '=' else '##'} {m[1].strip()}\n\n", re.M)
    s.block(_MD_LIST, "markdown", "list", lambda m: "\n\n" + _items(re.sub(r"\[[ xX]\][ \t]+", "", m[0]), r"^[ \t]*(?:[-*+]|\d{1,3}[.)])[ \t]+") + "\n\n", re.M)
    s.block(r"^[ \t]*(={1,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*$", "wiki", "heading", lambda m: f"\n\n{'#' * len(m[1])} {_stripped(m[2])}\n\n", re.M)
    s.block(r"<(h[1-6])\b[^>]*>(.*?)(?:</\1>|$)", "html", "heading", lambda m: f"\n\n{'#' * int(m[1][1])} {' '.join(_TAG.sub('', m[2]).split())}\n\n", re.S | re.I | re.M)
    s.block(r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?(?:\[[^\]]*\])?\{([^{}]*)\}(?:[ \t]*\\label\{[^}]*\})?", "latex", "heading", lambda m: f"\n\n# {m[2]}\n\n")
    # Inline residue.
    s.inline(_COMMENT, "html", "")
    s.inline(r"<(ref)\b[^>]*>.*?</\1>|<ref\b[^>]*/>|</?nowiki>", "wiki", "", re.S | re.I)
    s.inline(_LATEX_INLINE, "latex")
    if "latex" in s.seen:
        s.text = _latex_text(s.text)
    s.inline(r"!\[([^\]\n]*)\]\([^()\n]*\)|(?<!\[)\[([^\[\]\n]+)\]\((?!\()[^()\n]*\)|(?<!\[)\[([^\[\]\n]+)\]\[[^\[\]\n]*\]", "markdown", lambda m: m[1] or m[2] or m[3] or "")
    s.inline(r"\[\^[^\]\n]{1,12}\]:?", "markdown", "")
    s.inline(r"^[ \t]*\[[^\]\n]+\]:[ \t]*\S+[^\n]*$", "markdown", "")
    s.inline(r"\[\[(?:File|Image|Category|Datei|Archivo):[^\]\n]*\]\]", "wiki", "", re.M | re.I)
    s.inline(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]", "wiki", r"\1")
    s.inline(r"\{\{[^{}|\n]+(?:\|([^{}\n]*))?\}\}", "wiki", r"\1")
    s.inline(r"\[\[(?=\S)|(?<=\S)\]\]", "wiki", "")
    s.inline(r"\{\{(?=\w+\|)|(?<=\S)\}\}", "wiki", "")
    s.inline(r"(?<!')('{2,3}|'{5})(?!')(?=\S)([^'\n](?:[^\n]*?[^'\n])?)\1(?!')", "wiki", r"\2")
    s.inline(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])([^*\n]*?[^\s*])\1(?![\w*])|(?<![\w_\\])(_{2,3})(?=[^\s_])([^\n]*?[^\s_])\3(?![\w_])|(?<![\w_/\\])_(?=[^\s_])([^_\n]*?[^\s_])_(?![\w_])", "markdown", lambda m: m[2] or m[4] or m[5] or "")
    s.inline(r"~~(?=\S)([^~\n]+?)~~", "markdown", r"\1")
    s.inline(r"(?<!`)`(?!`)([^`\n]+)`(?!`)", "markdown", r"\1")
    s.inline(r"^[ \t]*(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,})$", "markdown", "")
    s.inline(r"^[ \t]*>+[ \t](?=\S)", "markdown", "")
    found = s.read_body()
    s.inline(_ENTITY, "html", lambda m: html.unescape(m[0]))
    return found | {(k, "none") for k in s.seen - {k for k, _ in found}}, s.restored()


def _latex_text(text: str) -> str:
    text = re.sub(r"~?\\(?:cite[a-z]*|ref|eqref|pageref|autoref|cref|label|footnote|vspace|hspace|includegraphics)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", text)
    text = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", text)
    n = 1
    while n:
        text, n = re.subn(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\{\\(?:em|bf|it|tt|sc|rm|sf|small|large)\s+([^{}]*)\}", r"\1", text)
    text = re.sub(rf"\\(?:{'|'.join(_COMMANDS.split())})\*?\{{", "", text)
    text = re.sub(r"\\ldots|\\dots", "...", text)
    text = re.sub(rf"\\(?:{'|'.join(_BARE.split())})(?![A-Za-z_\\])\s?", "", text)
    text = re.sub(r"\\\\(?:\[[^\]]*\])?|\\[,;!]", " ", text)
    return re.sub(r"``([^`\n]+)''", r'"\1"', text).replace("~", " ")


def markup_elements(episodes: DataFrame) -> DataFrame:
    """(uuid, markup, element) of every record's content; a redelivered record counts once, null and blank contents have no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(uuid, *pair) for uuid, content in zip(pdf.uuid, pdf.content, strict=True) for pair in sorted(scan_markup(content)[0])]
            yield pd.DataFrame(rows, columns=["uuid", "markup", "element"])

    return episodes.where("uuid IS NOT NULL AND content IS NOT NULL").select("uuid", "content").mapInPandas(run, "uuid string, markup string, element string").distinct()


def clean_markup(episodes: DataFrame) -> DataFrame:
    """(uuid, text): contents as clean text with headings, lists, code, formulas and tables kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"uuid": pdf.uuid, "text": [scan_markup(c)[1] for c in pdf.content]})

    return distinct_records(episodes, "content").where("content IS NOT NULL").mapInPandas(run, "uuid string, text string")
