"""A scanner of wiki markup and the functions on one text that need it.

One pass over the marks of a text keeps a stack of open elements; a closer
takes the nearest opener of its kind and forgets what stayed open inside.
What comes out is a flat table of elements with half-open spans, sorted by
start, each knowing the element around it.  Rewrites are lists of edits
(start, end, new) on spans, applied at once, so untouched text is never
printed anew.  Work is linear in the text, but for stray closers of a kind that
is open somewhere, and no function recurses, so depth and length are free.

Edge cases: unmatched marks are plain text; comments and verbatim tags hide
all inside; an empty text has no elements.  All functions take str; callers
turn null into the empty text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

# Fixed values.
VERBATIM = ("math", "chem", "nowiki", "code", "pre", "syntaxhighlight", "source", "tt")
_MARKS = re.compile(r"<!--|\{\{\{(?!\{)|\{\{|\}\}|\[\[|\]\]|^\{\||^\|\}(?!\})|\||<(/?)([A-Za-z][A-Za-z0-9]*)\b([^<>]*)>", re.MULTILINE)


@dataclass
class Element:
    """kind is template, argument, link, table, tag or comment; pipes are places of its own | marks."""

    kind: str
    name: str
    start: int
    end: int
    inner: tuple[int, int]
    pipes: list[int] = field(default_factory=list)
    parent: int = -1
    attrs: str = ""
    place: int = -1


@dataclass
class Param:
    """A template's parameter; keyed tells name=value from a place."""

    name: str
    value: str
    name_span: tuple[int, int]
    value_span: tuple[int, int]
    keyed: bool


class Markup:
    """The elements of a text."""

    def __init__(self, text: str):
        self.text = text
        self.elements = sorted(self._scan(), key=lambda e: (e.start, -e.end))
        around: list[int] = []
        self.children: dict[int, list[int]] = {}
        for i, e in enumerate(self.elements):
            while around and self.elements[around[-1]].end <= e.start:
                around.pop()
            e.parent, e.place = around[-1] if around else -1, i
            self.children.setdefault(e.parent, []).append(i)
            around.append(i)

    def _scan(self) -> Iterable[Element]:
        text, at = self.text, 0
        stack: list[Element] = []
        held: dict[tuple[str, str], int] = {}

        def push(kind: str, name: str, start: int, inner: int, attrs: str = "") -> None:
            stack.append(Element(kind, name, start, -1, (inner, -1), attrs=attrs))
            held[kind, name] = held.get((kind, name), 0) + 1

        def pop(kind: str, name: str, inner_end: int, end: int) -> Element | None:
            if not held.get((kind, name)):
                return None
            while True:
                e = stack.pop()
                held[e.kind, e.name] -= 1
                if (e.kind, e.name) == (kind, name):
                    e.end, e.inner = end, (e.inner[0], inner_end)
                    return e

        while m := _MARKS.search(text, at):
            mark, at = m[0], m.end()
            if mark == "<!--":
                end = text.find("-->", at)
                if end >= 0:
                    yield Element("comment", "", m.start(), end + 3, (at, end))
                    at = end + 3
            elif mark == "{{{":
                push("argument", "", m.start(), at)
            elif mark == "{{":
                push("template", "", m.start(), at)
            elif mark == "[[":
                push("link", "", m.start(), at)
            elif mark == "{|":
                push("table", "", m.start(), at)
            elif mark == "|":
                if stack and stack[-1].kind in ("template", "argument", "link"):
                    stack[-1].pipes.append(m.start())
            elif mark == "}}":
                inner = next((e for e in reversed(stack) if e.kind in ("template", "argument")), None)
                if inner is not None and inner.kind == "argument":
                    if text[at : at + 1] == "}":
                        at += 1
                        yield pop("argument", "", m.start(), at)
                    else:  # two braces close a template that begins one brace later
                        e = pop("argument", "", m.start(), at)
                        yield Element("template", "", e.start + 1, at, e.inner, e.pipes)
                elif e := pop("template", "", m.start(), at):
                    yield e
            elif mark == "]]":
                if e := pop("link", "", m.start(), at):
                    yield e
            elif mark == "|}":
                if e := pop("table", "", m.start(), at):
                    yield e
            else:
                tag = m[2].lower()
                if m[1]:
                    if e := pop("tag", tag, m.start(), at):
                        yield e
                elif m[3].rstrip().endswith("/"):
                    yield Element("tag", tag, m.start(), at, (at, at), attrs=m[3].rstrip()[:-1])
                elif tag in VERBATIM:
                    close = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(text, at)
                    if close:
                        yield Element("tag", tag, m.start(), close.end(), (at, close.start()), attrs=m[3])
                        at = close.end()
                else:
                    push("tag", tag, m.start(), at, m[3])

    def of(self, kind: str, name: str | None = None) -> list[Element]:
        return [e for e in self.elements if e.kind == kind and (name is None or e.name == name)]

    def top(self) -> list[Element]:
        return [self.elements[i] for i in self.children.get(-1, ())]

    def source(self, e: Element) -> str:
        return self.text[e.start : e.end]

    def name_of(self, e: Element) -> str:
        """A template's name as written, blanks around it dropped."""
        return self.text[e.inner[0] : e.pipes[0] if e.pipes else e.inner[1]].strip()

    def key_of(self, e: Element) -> str:
        """A template's name for look-ups: lower case, blanks as one."""
        return " ".join(self.name_of(e).lower().split())

    def params(self, e: Element) -> list[Param]:
        if not e.pipes:
            return []
        own = [self.elements[i] for i in self.children.get(e.place, ())]
        out, place, k = [], 0, 0
        for a, b in zip(e.pipes, [*e.pipes[1:], e.inner[1]], strict=True):
            cut, at = -1, a + 1
            while k < len(own) and own[k].start < b:
                if own[k].start > a:
                    cut = self.text.find("=", at, own[k].start) if cut < 0 else cut
                    at = own[k].end
                k += 1
            cut = self.text.find("=", at, b) if cut < 0 else cut
            if cut >= 0:
                out.append(Param(self.text[a + 1 : cut].strip(), self.text[cut + 1 : b].strip(), (a + 1, cut), (cut + 1, b), True))
            else:
                place += 1
                out.append(Param(str(place), self.text[a + 1 : b].strip(), (a + 1, a + 1), (a + 1, b), False))
        return out

    def within(self, e: Element, kind: str, name: str) -> bool:
        """Whether some element of that kind and name is around e."""
        while e.parent >= 0:
            e = self.elements[e.parent]
            if (e.kind, e.name) == (kind, name):
                return True
        return False


def edited(text: str, edits: Iterable[tuple[int, int, str]]) -> str:
    """text with disjoint spans replaced; of overlapping edits the outer, earlier one holds."""
    out, done = [], 0
    for a, b, new in sorted(edits, key=lambda x: (x[0], -x[1])):
        if a >= done:
            out += [text[done:a], new]
            done = b
    return "".join(out) + text[done:]


def value_of(params: list[Param], name: str) -> str | None:
    """The last parameter of that name, None without one."""
    return next((p.value for p in reversed(params) if p.name.lower() == name), None)


def swapped(text: str, span: tuple[int, int], new: str) -> tuple[int, int, str]:
    """An edit of what stands between the blanks of a span."""
    a, b = span
    own = text[a:b]
    lead, tail = len(own) - len(own.lstrip()), len(own) - len(own.rstrip())
    return (a + lead, b - tail, new) if own.strip() else (a, b, new)


# --- names and values -------------------------------------------------------

# Fixed values.
MAGIC_PREFIXES = ("safesubst", "subst", "int", "msg", "msgnw", "raw")
BOX_PREFIXES = ("infobox", "kuti")
IMPLICIT_NOTE_TEMPLATES = ("efn", "notelist", "listë shënimesh", "nlist", "noteslist", "notes list", "note list", "nls", "notes", "efnlist")
NOTE_COUNTED = {"notelist": "listë shënimesh", "listë shënimesh": "listë shënimesh", "efn": "efn"}


def template_names(text: str) -> list[str]:
    """P13. Names of all templates, first seen first, without parser functions and magic prefixes."""
    m = Markup(text)
    names = [m.name_of(e) for e in m.of("template")]
    return list(dict.fromkeys(n for n in names if n and n[0] != "#" and n.split(":")[0].strip().lower() not in MAGIC_PREFIXES))


def ill_renderings(text: str) -> list[tuple[str, str]]:
    """P15. (title, display) of interlanguage links from English, the first display of each title."""
    m, out = Markup(text), {}
    for e in m.of("template"):
        if m.key_of(e) == "ill":
            own = {p.name: p.value for p in m.params(e)}
            if own.get("1") and own.get("2", "").lower() == "en":
                out.setdefault(own.get("3") or own["1"], own["1"])
    return list(out.items())


def boxes(text: str) -> list[str]:
    """P24. Infoboxes at the top level."""
    m = Markup(text)
    return [m.source(e) for e in m.top() if e.kind == "template" and m.name_of(e).lower().startswith(BOX_PREFIXES)]


def lost_boxes(source: str, made: str) -> list[str]:
    """P24. The source's infoboxes beyond as many as the translation has."""
    return boxes(source)[len(boxes(made)) :]


def with_boxes(made: str, lost: list[str]) -> str:
    """P25. Boxes put behind the templates and comments that the text begins with."""
    m, at = Markup(made), 0
    for e in m.top():
        if e.kind not in ("template", "comment") or made[at : e.start].strip():
            break
        at = e.end
    return made[:at] + "\n" + "\n".join(lost) + made[at:] if lost else made


def implicit_note_group(text: str) -> bool:
    """V15. Whether some note template names no group."""
    m = Markup(text)
    return any(m.key_of(e) in IMPLICIT_NOTE_TEMPLATES and not value_of(m.params(e), "group") for e in m.of("template"))


def note_counts(text: str) -> dict[str, int]:
    """A13. How often each note template is called, aliases as one."""
    m, out = Markup(text), {}
    for e in m.of("template"):
        if name := NOTE_COUNTED.get(m.key_of(e)):
            out[name] = out.get(name, 0) + 1
    return out


# --- references -------------------------------------------------------------


def definitions(m: Markup) -> list[Element]:
    """Outermost references that hold a text of their own."""
    refs = [e for e in m.of("tag", "ref") if e.inner[1] > e.inner[0] or not m.text[e.start : e.end].endswith("/>")]
    return [e for e in refs if not m.within(e, "tag", "ref")]


def is_reference_only(text: str) -> bool:
    """P22. Whether only reference definitions, comments and list tags are there, and at least one definition is."""
    m = Markup(text)
    found = definitions(m)
    bare = edited(text, [(e.start, e.end, "") for e in [*found, *m.of("comment")]])
    return bool(found) and not re.sub(r"(?i)</?references\b[^<>]*>", "", bare).strip()


def is_heading(line: str) -> bool:
    line = line.strip()
    return len(line) > 2 and line[0] == line[-1] == "=" and line.strip("=").strip() != ""


def source_reference_block(source: str, made: str) -> str:
    """P26. Where the source is a heading over definitions only: the translated heading, if it is one, over the source's definitions."""
    head, cut, rest = source.lstrip("\n").partition("\n")
    if not cut or not is_heading(head) or not is_reference_only(rest):
        return made
    first = made.lstrip("\n").split("\n", 1)[0]
    return (first if is_heading(first) else head) + "\n" + rest


def extended_references(text: str) -> str:
    """R19. The closing tag of a reference list moves behind the definitions right after it, comments between them included."""
    m, edits = Markup(text), []
    follow = {e.start: e for e in [*definitions(m), *m.of("comment")]}
    for close in re.finditer(r"(?i)</references\s*>", text):
        at = end = close.end()
        first = None
        while True:
            while at < len(text) and text[at].isspace():
                at += 1
            e = follow.get(at)
            if e is None:
                break
            first = at if first is None else first
            at = e.end
            if e.kind == "tag":
                end = at
        if end > close.end():
            edits.append((close.start(), end, text[first:end] + "\n</references>"))
    return edited(text, edits)
