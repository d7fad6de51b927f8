"""LaTeX sources to plain text, read token by token."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

# Commands whose argument is kept, environments that are left out, commands whose argument goes too.
KEPT = frozenset({"texttt", "textbf", "textit", "textsc", "emph", "text"})
LEFT_OUT = frozenset({"table", "table*", "figure", "figure*", "tabular", "equation", "equation*", "align", "align*", "gather", "multline"})
POINTERS = frozenset({"ref", "eqref", "label", "autoref", "pageref"})
DEFINERS = frozenset({"newcommand", "renewcommand", "def"})
FRONT = frozenset({"title", "author"})
# Fixed value: a citation key that a stripper has left behind.
_CITE_KEY = re.compile(r"\b[a-z]{3,20}\d{4}[a-z]{4,40}\b")
_TOKEN = re.compile(r"\\(?P<name>[A-Za-z]+)(?P<star>\*?)|\\(?P<sign>.)|(?P<math>\$\$?)|(?P<brace>[{}])|(?P<tie>~)|(?P<text>[^\\{}$~]+|\\)", re.S)
_OPTIONAL = re.compile(r"\s*\[[^\]]*\]")
MOST_EXPANSIONS = 100_000  # so that macros that call each other end


@dataclass
class Source:
    """A text that is read from the front; expansions are put back before the rest."""

    text: str
    at: int = 0
    front: list[str] = field(default_factory=list)

    def token(self) -> re.Match | None:
        m = _TOKEN.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def options(self) -> None:
        while m := _OPTIONAL.match(self.text, self.at):
            self.at = m.end()

    def group(self) -> str:
        """The balanced braces that come next, and past them; nothing if none do."""
        body, end = braced(self.text, self.at)
        self.at = end
        return body

    def past(self, mark: str) -> None:
        end = self.text.find(mark, self.at)
        self.at = len(self.text) if end < 0 else end + len(mark)

    def put_back(self, text: str) -> None:
        self.text, self.at = text + self.text[self.at :], 0


def braced(text: str, at: int = 0) -> tuple[str, int]:
    """(what stands in the balanced braces that open next, the place after them); ('', at) if none do."""
    opening = re.compile(r"\s*\{").match(text, at)
    depth = 0
    for m in re.compile(r"\\.|[{}]", re.S).finditer(text, at) if opening else ():
        depth += {"{": 1, "}": -1}.get(m.group(), 0)
        if depth == 0 and m.group() == "}":
            return text[opening.end() : m.start()], m.end()
    return "", at


def with_inputs(text: str, files: Mapping[str, str], depth: int = 3) -> str:
    """Included files put in, by name or name.tex, nested up to depth; unknown ones are removed."""

    def put(m: re.Match) -> str:
        name = next((n for n in (m[1], f"{m[1]}.tex") if n in files), None)
        return with_inputs(files[name], files, depth - 1) if name else ""

    return re.sub(r"\\(?:input|include)\{([^}]*)\}", put, text) if depth > 0 else text


def macros_of(sources: Iterable[str]) -> dict[str, str]:
    """Macros defined in the sources, as plain text; the later definition holds."""
    found: dict[str, str] = {}
    for text in sources:
        source = Source(text)
        while source.at < len(text):
            m = source.token()
            if m is None:
                break
            if m["name"] in DEFINERS and (defined := _definition(source)):
                found[defined[0]] = unwrapped(defined[1])
    return found


def _definition(source: Source) -> tuple[str, str] | None:
    """The name and body after a command that defines one."""
    m = re.compile(r"\s*\{?\s*\\([A-Za-z]+)\s*\}?").match(source.text, source.at)
    if not m:
        return None
    source.at = m.end()
    source.options()
    return m[1], source.group()


def unwrapped(text: str) -> str:
    """Text of which formatting commands leave their argument, all else as it stands."""
    out, source = [], Source(text)
    while m := source.token():
        if m["name"] in KEPT:
            source.put_back(source.group())
        else:
            out.append(m.group())
    return "".join(out)


def plain(source: Source, macros: Mapping[str, str], in_front: bool = False) -> str:
    """The text of a source: what a document's body says, without floats, formulas, references and commands.

    Titles and authors on the way are kept in source.front. The body begins anew at the document's beginning.
    """
    out: list[str] = []
    expansions = 0
    while m := source.token():
        name = m["name"]
        if m["math"]:
            source.past(m["math"])
        elif m["sign"]:
            if m["sign"] == "[":
                source.past(r"\]")
            elif in_front:
                out.append({"\\": "\n", "&": " & "}.get(m["sign"], m["sign"]))
            else:
                out.append(m["sign"] if m["sign"] in "%&#_$" else " ")
        elif m["tie"]:
            out.append(m.group())
        elif name is None:
            out.append(m["text"] or "")
        elif name in macros and expansions < MOST_EXPANSIONS:
            expansions += 1
            if source.text.startswith("{}", source.at):
                source.at += 2
            body = macros[name]
            if re.search(rf"\\{name}(?![A-Za-z])", body):
                out.append(plain(Source(body), {}, in_front))
            else:
                source.put_back(body)
        elif name == "begin":
            environment = source.group()
            if environment == "document":
                out.clear()
            elif environment in LEFT_OUT:
                source.past(f"\\end{{{environment}}}")
        elif name == "end":
            if source.group() == "document":
                break
        elif name in DEFINERS:
            _definition(source)
        elif name in POINTERS or name.lower().startswith("cite"):
            source.options()
            source.group()
            if out and out[-1] == "~":
                out.pop()
        elif name in FRONT and not in_front:
            source.options()
            if said := plain(Source(source.group()), macros, True).strip():
                source.front.append(said)
        elif name in KEPT:
            source.put_back(source.group())
        else:
            source.options()
    return "".join(out)


def tidy(text: str) -> str:
    """Leaked citation keys, lonely commas and colons off, at most one blank line, trimmed."""
    for mark in (" , ", " : "):
        text = _CITE_KEY.sub("", text).replace(mark, " ")
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def latex_text(text: str, files: Mapping[str, str] | None = None, stripper: Callable[[str], str] | None = None) -> str:
    """One source as text, with the other sources and styles of its folder, whose macros it may use.

    An external stripper, if one is given, goes first; its failure or silence leaves the work to this module.
    """
    files = files or {}
    whole = with_inputs(text, files)
    macros = macros_of([files[k] for k in sorted(files, key=lambda k: (k.endswith(".tex"), k)) if k.endswith((".sty", ".tex"))] + [whole])
    if stripper is not None:
        try:
            if said := stripper(whole).strip():
                return tidy(said)
        except Exception:  # noqa: BLE001, S110
            pass
    source = Source(whole)
    body = plain(source, macros)
    return tidy("\n\n".join(["\n".join(source.front), body] if source.front else [body]))
