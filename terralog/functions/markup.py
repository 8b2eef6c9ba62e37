"""A tokenizer of web pages: what a browser would show as text, and the title."""

from __future__ import annotations

import re
from html import unescape

# Elements whose content is no markup, of those the ones with text, and elements that are not shown.
RAW, TEXT = ("script", "style", "title", "textarea"), ("title", "textarea")
HIDDEN = ("script", "style", "noscript", "svg")
_NAME_END = re.compile(r"[\s/>]")
_IN_TAG = re.compile(r"[>=]|\Z")
_VALUE = re.compile(r"\s*(?:\"[^\"]*(\"|\Z)|'[^']*('|\Z)|[^\s>]*)")
_SPACES = re.compile("[ \t\r\f ]+")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in (*RAW, *HIDDEN)}


def _tag_end(html: str, at: int) -> int:
    """Behind the ``>`` of a tag whose name ends at ``at``; -1 where it is not closed. A ``>`` in a quoted value is none."""
    while True:
        m = _IN_TAG.search(html, at)
        if m[0] == ">":
            return m.end()
        if not m[0]:
            return -1
        at = _VALUE.match(html, m.end()).end()  # after = comes a value, quoted or not


def tokens(html: str):
    """``("text", characters)``, ``("open", name)`` and ``("close", name)`` in order; comments and declarations are left out.

    States are those of a browser: data, tag (with quoted and bare values), raw text up to its own end tag, comment (also
    one that is never closed) and bogus comment. An unclosed tag at the end is dropped; a ``<`` before anything else is text.
    """
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", unescape(html[at:])
            return
        nxt = html[lt + 1 : lt + 2]
        closing = nxt == "/"
        first = html[lt + 2 : lt + 3] if closing else nxt
        if first.isascii() and first.isalpha():
            if lt > at:
                yield "text", unescape(html[at:lt])
            begin = lt + 1 + closing
            m = _NAME_END.search(html, begin)
            end = _tag_end(html, m.start()) if m else -1
            if end < 0:
                return
            name = html[begin : m.start()].lower()
            yield ("close" if closing else "open"), name
            at = end
            if not closing and name in RAW:
                stop = _CLOSE[name].search(html, at)
                body = html[at : stop.start() if stop else n]
                if body:
                    yield "text", unescape(body) if name in TEXT else body
                at = stop.start() if stop else n
        elif nxt in ("!", "?") or closing and first:
            if lt > at:
                yield "text", unescape(html[at:lt])
            if html.startswith("<!--", lt):
                if html.startswith(("<!-->", "<!--->"), lt):
                    at = html.index(">", lt) + 1
                else:
                    stop = html.find("-->", lt + 4)
                    other = html.find("--!>", lt + 4, stop if stop >= 0 else n)
                    at = other + 4 if other >= 0 else stop + 3 if stop >= 0 else n
            else:
                stop = html.find(">", lt)
                at = stop + 1 if stop >= 0 else n
        else:
            yield "text", unescape(html[at : lt + 1])
            at = lt + 1


def page(html: str | None) -> tuple[str, str]:
    """Title and visible text: tags end lines, spaces collapse, blank lines go, hidden elements go with what they hold."""
    title, out, hidden, depth, in_title = None, [], None, 0, False
    for kind, value in tokens(html or ""):
        if hidden:
            if value == hidden and kind != "text":
                depth += 1 if kind == "open" else -1
                hidden = hidden if depth else None
        elif kind == "open" and value in HIDDEN:
            hidden, depth = value, 1
            out.append("\n")
        elif kind == "text":
            out.append(value)
            if in_title:
                title = (title or "") + value
        else:
            in_title = kind == "open" and value == "title" and title is None
            title = "" if in_title else title
            out.append("\n")
    lines = (_SPACES.sub(" ", line).strip(" ") for line in "".join(out).split("\n"))
    return _SPACES.sub(" ", (title or "").replace("\n", " ")).strip(" "), "\n".join(filter(None, lines))
