"""Markdown on the worker: front matter, links, regions, inline cleanup.  Offsets are code points of the raw text."""

from __future__ import annotations

import re
from dataclasses import dataclass

_LINK = re.compile(r"(?P<image>!?)(?:\[\[(?P<wiki>[^\[\]\n]+)\]\]|\[(?P<label>[^\[\]\n]*)\]\(\s*<?(?P<href>[^()\s<>]+)>?(?:\s+[\"'][^)\n]*[\"'])?\s*\))")
_CODE_SPAN = re.compile(r"`+[^`\n]+`+")
_MATH_SPAN = re.compile(r"\$[^$\n]+\$")
_UNDERSCORED = re.compile(r"_[^_\n]+_")
_MARKER = re.compile(r"([-*+]|\d{1,9}[.)])\s+")


@dataclass
class Region:
    kind: str
    start: int
    end: int
    text: str
    level: int | None = None
    language: str | None = None


def front_matter(text: str) -> tuple[dict, str, int]:
    """(mapping, body, end offset) of leading YAML; ({}, "", 0) without; a malformed body keeps its span with an empty mapping."""
    head, *rest = text.splitlines(keepends=True) or [""]
    closing = next((i for i, line in enumerate(rest) if line.rstrip() in ("---", "...") and line[:1] in "-."), None)
    if closing is None or head.rstrip() != "---" or not head.startswith("---"):
        return {}, "", 0
    body, end = "".join(rest[:closing]), len(head) + sum(map(len, rest[: closing + 1]))
    try:
        import yaml

        mapping = yaml.safe_load(body)
    except ImportError:
        mapping = simple_mapping(body)
    except Exception:
        mapping = {}
    return mapping if isinstance(mapping, dict) else {}, body.strip(), end


def simple_mapping(body: str) -> dict:
    """The subset of YAML that front matter uses: `key: scalar`, `key: [a, b]` and indented `- item` lists."""
    out: dict = {}
    key = None
    for line in body.splitlines():
        item = re.match(r"\s+-\s+(.*)", line) or re.match(r"-\s+(.*)", line)
        pair = re.match(r"([A-Za-z_][\w-]*):\s*(.*)", line)
        if item and key is not None:
            if not isinstance(out.get(key), list):
                out[key] = []
            out[key].append(item.group(1).strip().strip("\"'"))
        elif pair:
            key, value = pair.group(1), pair.group(2).strip()
            if value.startswith("[") and value.endswith("]"):
                out[key] = [v.strip().strip("\"'") for v in value[1:-1].split(",") if v.strip()]
            else:
                out[key] = value.strip("\"'") or None
    return out


def _indented(line: str) -> tuple[int, str]:
    """(blanks before, the rest) of a line; block marks stand after at most three."""
    bare = line.lstrip(" ")
    return len(line) - len(bare), bare


def _fence(line: str) -> tuple[str, str] | None:
    """(run of fence characters, what follows) of a line that opens or closes fenced code."""
    blanks, bare = _indented(line)
    mark = bare[: len(bare) - len(bare.lstrip(bare[:1]))] if bare[:1] in ("`", "~") else ""
    info = bare[len(mark) :].strip()
    return (mark, info) if blanks < 4 and len(mark) >= 3 and "`" not in info else None


def _closes(line: str, mark: str) -> bool:
    found = _fence(line)
    return bool(found) and found[0].startswith(mark) and not found[1]


def fences(text: str) -> list[tuple[int, int]]:
    """Spans of fenced code, fences included; one left open runs to the end."""
    out, at, begun, mark = [], 0, None, ""
    for line in text.splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        if begun is None:
            if found := _fence(bare):
                begun, mark = at, found[0]
        elif _closes(bare, mark):
            out.append((begun, at + len(bare)))
            begun = None
        at += len(line)
    if begun is not None:
        out.append((begun, len(text)))
    return out


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` with spans blanked out, at the same length."""
    for a, b in spans:
        text = text[:a] + re.sub(r"[^\r\n]", " ", text[a:b]) + text[b:]
    return text


def links(text: str) -> list[tuple[int, int, str, str, str, str]]:
    """(start, end, style, target, anchor after #, display) of wiki and Markdown links outside fenced code, in order; images and outside addresses are left out."""
    body, out = masked(text, fences(text)), []
    for m in _LINK.finditer(body):
        if m.group("image"):
            continue
        if m.group("wiki") is not None:
            raw, _, shown = m.group("wiki").partition("|")
            style = "wiki"
        else:
            raw, shown, style = m.group("href"), m.group("label"), "markdown"
        raw = raw.strip()
        if style == "markdown" and (raw.startswith(("#", "//", "mailto:", "tel:")) or "://" in raw):
            continue
        path, _, anchor = raw.partition("#")
        if style == "wiki" and not shown:
            last = path.rstrip("/").rpartition("/")[2]
            shown = (last.removesuffix(".md") or anchor).replace("-", " ")
        out.append((m.start(), m.end(), style, path.strip(), anchor.strip(), shown.strip()))
    return out


def clean_inline(text: str) -> str:
    """Links reduced to their text and emphasis marks dropped, code and formulas kept as they are."""
    kept: list[str] = []

    def put_by(m: re.Match) -> str:
        kept.append(m.group())
        return f"\x00{len(kept) - 1}\x00"

    def shown(m: re.Match) -> str:
        if m.group("image"):
            return m.group("label") or ""
        if m.group("wiki") is not None:
            raw, _, display = m.group("wiki").partition("|")
            return display or raw.partition("#")[0].rpartition("/")[2].replace("-", " ")
        return m.group("label")

    text = _MATH_SPAN.sub(put_by, _CODE_SPAN.sub(put_by, text))
    text = _LINK.sub(shown, text)
    text = _without_underscores(text.replace("**", "").replace("__", "")).replace("*", "")
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m.group(1))], text)


def _without_underscores(text: str) -> str:
    """Text without pairs of underscores around a phrase that no letter, digit or underscore adjoins."""
    at, edge = 0, lambda c: not (c.isalnum() or c == "_")
    while m := _UNDERSCORED.search(text, at):
        if (m.start() == 0 or edge(text[m.start() - 1])) and (m.end() == len(text) or edge(text[m.end()])):
            text, at = text[: m.start()] + m.group()[1:-1] + text[m.end() :], m.end() - 2
        else:
            at = m.start() + 1
    return text


def _heading(line: str) -> tuple[int, str] | None:
    blanks, bare = _indented(line)
    level = len(bare) - len(bare.lstrip("#"))
    if blanks > 3 or not 1 <= level <= 6 or bare[level : level + 1].strip():
        return None
    words = bare[level:].split()
    if words and set(words[-1]) == {"#"}:
        words = bare[level:].rstrip().rstrip("#").split()
        return level, bare[level:].rstrip().rstrip("#").strip() if words else ""
    return level, bare[level:].strip()


def _item(line: str) -> str | None:
    """What follows the marker of a list item."""
    blanks, bare = _indented(line)
    m = _MARKER.match(bare) if blanks < 4 else None
    return bare[m.end() :] if m else None


def _quoted(line: str) -> str | None:
    blanks, bare = _indented(line)
    return bare[1:].removeprefix(" ") if blanks < 4 and bare.startswith(">") else None


def _rule(line: str) -> bool:
    blanks, bare = _indented(line)
    marks = "".join(bare.split())
    return blanks < 4 and len(marks) >= 3 and marks[0] in "-*_" and len(set(marks)) == 1


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def _separates(line: str) -> bool:
    """Whether the line parts a table's head from its body: two or more dashes a cell, with colons at their ends."""
    dashes = [c.removeprefix(":").removesuffix(":") for c in _cells(line)]
    return _indented(line)[0] < 4 and all(len(d) >= 2 and set(d) == {"-"} for d in dashes)


def _begins(line: str, after: str | None) -> str:
    """Kind of the block that a line begins where none is open; `after` is the next line."""
    if not line.strip() or _rule(line):
        return "gap"
    if _fence(line):
        return "code"
    if line.strip().startswith("$$"):
        return "equation"
    if _heading(line):
        return "heading"
    if _quoted(line) is not None:
        return "quote"
    if "|" in line and after is not None and "|" in after and _separates(after):
        return "table"
    return "list" if _item(line) is not None else "prose"


class _Block:
    """Lines of one block while it is open, first line first."""

    def __init__(self, kind: str, at: int, line: str):
        self.kind, self.start, self.lines, self.breaks, self.blank = kind, at, [line], [], 0
        self.mark = _fence(line)[0] if kind == "code" else ""
        alone = line.strip()
        self.done = kind == "heading" or (kind == "equation" and len(alone) >= 5 and alone.endswith("$$"))

    def takes(self, line: str, after: str | None) -> bool:
        """Whether the next line belongs to the block; blank lines in a list wait for the line behind them."""
        if self.done:
            return False
        match self.kind:
            case "code":
                self.done = _closes(line, self.mark)
                return True
            case "equation":
                self.done = line.rstrip().endswith("$$")
                return True
            case "quote":
                return _quoted(line) is not None
            case "table":
                return "|" in line
            case "list" if not line.strip():
                self.blank += 1
                return True
            case "list":
                more = _item(line) is not None or (not self.blank and line[0] in " \t")
                self.blank = 0 if more else self.blank
                return more
        return _begins(line, after) == "prose"

    def region(self) -> Region:
        lines = self.lines[: len(self.lines) - self.blank]
        if self.kind == "code":
            closed = len(lines) > 1 and self.done
            text = "\n".join(lines[1 : len(lines) - closed])
        elif self.kind == "equation":
            inner = "\n".join(lines).strip().removeprefix("$$").removesuffix("$$")
            text = "\n".join(x for x in inner.split("\n") if x.strip()).strip()
        elif self.kind == "table":
            text = "\n".join(clean_inline(" | ".join(filter(None, _cells(x)))) for x in lines if not _separates(x))
        elif self.kind == "list":
            items = ((x if _item(x) is None else _item(x)) or x.strip() for x in lines if x.strip())
            text = "\n".join(filter(None, map(clean_inline, items)))
        elif self.kind == "quote":
            text = clean_inline("\n".join(_quoted(x) for x in lines))
        elif self.kind == "heading":
            text = clean_inline(_heading(lines[0])[1]).strip()
        else:
            text = clean_inline("\n".join(lines))
        end = self.start + sum(map(len, lines)) + sum(self.breaks[: len(lines) - 1])
        level = _heading(lines[0])[0] if self.kind == "heading" else None
        return Region(self.kind, self.start, end, text, level, (_fence(lines[0])[1] or None) if self.kind == "code" else None)


def regions(text: str) -> list[Region]:
    """Typed regions in order: metadata, heading, code, equation, list, table, quote, prose, and boilerplate for a first heading that repeats the title."""
    mapping, body, at = front_matter(text)
    out = [Region("metadata", 0, at, body)] if at else []
    title = str(mapping.get("title") or "").strip()
    raw = text[at:].splitlines(keepends=True)
    lines = [x.rstrip("\r\n") for x in raw]
    blocks: list[_Block] = []
    block = None
    for i, line in enumerate(lines):
        after = lines[i + 1] if i + 1 < len(lines) else None
        if block is not None and block.takes(line, after):
            block.lines.append(line)
        else:
            kind = _begins(line, after)
            block = None if kind == "gap" else _Block(kind, at, line)
            if block is not None:
                blocks.append(block)
        if block is not None:
            block.breaks.append(len(raw[i]) - len(line))
        at += len(raw[i])
    found = [b.region() for b in blocks]
    same = lambda x: " ".join(x.split()).casefold()
    if found and found[0].kind == "heading" and found[0].level == 1 and title and same(found[0].text) == same(title):
        found[0].kind = "boilerplate"
    return out + found


def plain_regions(text: str, title: str | None) -> list[Region]:
    """The title, at (0, 0), and the paragraphs between blank lines with exact spans."""
    out = [Region("title", 0, 0, title.strip())] if title and title.strip() else []
    for m in re.finditer(r"\S(?:.*?\S)?(?=\s*?(?:\n[ \t\r]*\n|\Z))", text, re.S):
        out.append(Region("prose", m.start(), m.end(), m.group()))
    return out


def first_heading(text: str) -> str | None:
    """Text of the first level-1 heading outside fenced code."""
    m = re.search(r"^# +(.+?)\s*#*\s*$", masked(text, fences(text)), re.M)
    return clean_inline(m.group(1)).strip() if m else None


def without_repeated_title(text: str) -> str:
    """Text without its first level-1 heading where the front matter has a title; other text stays."""
    mapping, _, at = front_matter(text)
    if not mapping.get("title"):
        return text
    m = re.search(r"^# +[^\n]*\n?", masked(text, fences(text))[at:], re.M)
    return text if not m else text[: at + m.start()] + text[at + m.end() :]
