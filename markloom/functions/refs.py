"""References and reference lists of one text as rows, for the relational operators that decide over them.

Edge cases: a reference without a name has a null one; names and groups are
given without quotes; an empty text has no rows.
"""

from __future__ import annotations

import re

from .wiki import IMPLICIT_NOTE_TEMPLATES, Markup, is_heading, value_of

REFS = "s long, e long, name string, name_s long, name_e long, grp string, body string, body_s long, body_e long, in_list boolean, print string"
LISTS = "s long, e long, kind string, grp string, under_notes boolean"

# Fixed values.
NOTE_HEADINGS = ("shënime", "notes", "footnotes")
IMPLICIT_GROUP = "lower-alpha"


def _attr(attrs: str, name: str) -> tuple[str | None, int, int]:
    m = re.search(rf"(?i)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'/>]+))", attrs)
    if not m:
        return None, -1, -1
    i = next(i for i in (1, 2, 3) if m[i] is not None)
    return m[i].strip(), *m.span(i)


def print_of(body: str) -> str:
    """P17. Addresses and the digits outside them, as one key."""
    urls = re.findall(r"https?://[^\s|\]}<]+", body)
    return "|".join(urls) + "#" + "|".join(re.findall("[0-9]+", re.sub(r"https?://[^\s|\]}<]+", " ", body)))


def references(text: str) -> list[tuple]:
    """REFS of every reference, definitions with a body, reuses without; spans count from the text's start."""
    m, out = Markup(text), []
    for e in m.of("tag", "ref"):
        offset = e.start + len("<ref")
        name, a, b = _attr(e.attrs, "name")
        closed = text[e.start : e.end].endswith("/>") and e.inner[0] == e.inner[1]
        body = None if closed else text[slice(*e.inner)]
        listed = m.within(e, "tag", "references")
        out.append((e.start, e.end, name, offset + a if name is not None else None, offset + b if name is not None else None, _attr(e.attrs, "group")[0], body, e.inner[0], e.inner[1], listed, print_of(body) if body is not None else None))
    return out


def lists(text: str) -> list[tuple]:
    """LISTS of every reference or note list; one that holds references itself is content and left out."""
    m, out = Markup(text), []
    heads = [(x.start(), x[0]) for x in re.finditer(r"(?m)^=.*$", text) if is_heading(x[0])]
    for e in m.elements:
        if e.kind == "template" and (key := m.key_of(e)) in ("reflist", *IMPLICIT_NOTE_TEMPLATES) and key != "efn":
            params = m.params(e)
            if value_of(params, "refs") or value_of(params, "notes"):
                continue
            kind = "reflist" if key == "reflist" else "notelist"
            group = value_of(params, "group") or (IMPLICIT_GROUP if kind == "notelist" else None)
        elif e.kind == "tag" and e.name == "references" and not m.children.get(e.place):
            kind, group = "reflist", _attr(e.attrs, "group")[0]
        else:
            continue
        title = next((h for at, h in reversed(heads) if at < e.start), "")
        out.append((e.start, e.end, kind, group, title.strip("= \t").lower() in NOTE_HEADINGS))
    return out


def whole_line(text: str, a: int, b: int) -> tuple[int, int]:
    """A span, with its line where it stands alone on it."""
    first, last = text.rfind("\n", 0, a) + 1, text.find("\n", b)
    last = len(text) if last < 0 else last
    return (first, min(last + 1, len(text))) if not (text[first:a] + text[b:last]).strip() else (a, b)
