"""A post's own text: what its author wrote, without quoted passages and signature."""

from __future__ import annotations

import html
import re

_BREAK = re.compile(r"<br\s*/?>|</p>|</div>|</li>|</h\d>|</td>|</tr>", re.I)
_OPEN_OR_CLOSE = re.compile(r"\[(/?)quote\b[^\[\]\n]*\]|<(/?)blockquote\b[^<>\n]*>", re.I)
_QUOTED_LINE = re.compile(r"^\s*(?:<(?:p|div|span)[^<>]*>\s*)*[>|](?!\|)")
_SAID = re.compile(r"^\s*(?:<p>)?\S.*\b(?:wrote|escreveu|escribió|said|disse)\s*:\s*$", re.I)
_SIGNATURE = re.compile(r"^\s*(?:--|—|_{5,}|~{3,}[^~]*~{3,}|-{3}\s*$)\s*$")
_SMALL = re.compile(r"\[size=1\].*?(?:\[/size\]|\Z)", re.I | re.S)
# Markup may be of any length; as none of these spans another mark's beginning, one pass is enough.
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>|\[/?(?:b|i|u|s|size|color|code|img|url|attachment|list|center|\*)\b[^\[\]\n]*\]")
_LINK_MD = re.compile(r"\[([^\[\]\n]*)\]\(\s*([^()\[\]\s]+)\s*\)")
_LINK_BB = re.compile(r"\[url=([^\[\]\n]+)\]", re.I)
_LINK_HTML = re.compile(r"<a\s[^<>]*>", re.I)
URL = re.compile(r"(?:https?://|www\.)[^\s<>\[\]()\"']+", re.I)
#: "--" begins a signature of any length; any other mark with more lines after it divides a text.
SIGNATURE_LINES = 8
LINK = ""


def own_text(text: str | None) -> str:
    """The author's own words. Links become the mark LINK, markup and entities go.

    Quotes may nest, lack their end (then only the mark goes) or be lines that begin
    with ">" or "|"; a signature runs from its mark to the end. One pass over the
    text, of any length; null gives an empty text."""
    if not text:
        return ""
    t = text
    if "&" in t:
        t = html.unescape(t)
    t = t.replace("\r\n", "\n").replace("\xa0", " ")
    t = _without_nested(t)
    t = _BREAK.sub("\n", t)
    kept: list[str] = []
    said = False
    lines = t.split("\n")
    for i, line in enumerate(lines):
        if _QUOTED_LINE.match(line) or _SAID.match(line):
            continue
        if _SIGNATURE.match(line) and (line.strip() == "--" or i >= len(lines) - 1 - SIGNATURE_LINES) and said:
            break
        kept.append(line)
        said = said or bool(line.strip())
    t = _SMALL.sub(" ", "\n".join(kept))
    t = _LINK_MD.sub(rf"\1 {LINK} ", t)
    t = _LINK_BB.sub(f" {LINK} ", t)
    t = _LINK_HTML.sub(f" {LINK} ", t)
    t = URL.sub(f" {LINK} ", t)
    return _TAG.sub("\n", t).strip()


def _without_nested(t: str) -> str:
    """Cut matched quote blocks of either kind, outermost first."""
    marks = list(_OPEN_OR_CLOSE.finditer(t))
    if not marks:
        return t
    spans, stack = [], []
    for m in marks:
        kind = "b" if m.group(0)[0] == "[" else "h"
        if not (m.group(1) or m.group(2)):
            stack.append((kind, m))
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == kind:
                spans.append((stack[k][1].start(), m.end()))
                del stack[k:]
                break
        else:
            spans.append((m.start(), m.end()))
    spans += [(m.start(), m.end()) for _, m in stack]
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out.append(t[at:a])
            out.append("\n")
        at = max(at, b)
    out.append(t[at:])
    return "".join(out)
