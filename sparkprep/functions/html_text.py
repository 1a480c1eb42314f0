"""Text and Markdown from one HTML page: small helpers on the standard HTML parser, run inside pandas UDFs."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Walker(HTMLParser):
    """Keeps the stack of open elements; a closing tag closes everything opened inside it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict]] = []

    # Tags that end an open one of their kind, and the containers that keep an outer one open.
    ends_itself: dict[str, frozenset[str]] = {}

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag in self.ends_itself:
            for name, _ in reversed(self.open):
                if name in self.ends_itself[tag]:
                    break
                if name == tag:
                    self.handle_endtag(tag)
                    break
        self.enter(tag, attrs)
        if tag not in VOID:
            self.open.append((tag, attrs))

    def handle_startendtag(self, tag, attrs):
        self.enter(tag, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self.leave(tag, dict(attrs))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open:
                name, attrs = self.open.pop()
                self.leave(name, attrs)
                if name == tag:
                    break

    def finish(self, html: str):
        self.feed(html)
        self.close()
        while self.open:
            self.leave(*self.open.pop())
        return self

    def enter(self, tag, attrs):
        pass

    def leave(self, tag, attrs):
        pass


class _TextOf(_Walker):
    def __init__(self, tags, unwanted, classes, comments):
        super().__init__()
        self.tags, self.unwanted, self.classes, self.comments = tags, unwanted, classes, comments
        self.parts: list[str] = []

    def _wanted(self) -> bool:
        inside = False
        for tag, attrs in self.open:
            if tag in self.unwanted or self.classes & set(attrs.get("class", "").split()):
                return False
            inside = inside or tag in self.tags
        return inside

    def handle_data(self, data):
        if self._wanted():
            tag, attrs = self.open[-1]
            text = data.strip()
            self.parts.append(f"{text} ({attrs['href']})" if tag == "a" and attrs.get("href") else text)

    def handle_comment(self, data):
        if self.comments and self._wanted():
            self.parts.append(data.strip())


def html_text(html: str, tags, unwanted, classes, join_lines: bool, comments: bool) -> str:
    """The texts inside ``tags``, joined by blanks; links show their address."""
    text = " ".join(_TextOf(set(tags), set(unwanted), set(classes), comments).finish(html).parts)
    if join_lines:
        text = " ".join(line.strip() for line in text.split("\n") if line.strip())
    return text


# Inline marks.
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "code": "`", "kbd": "`", "samp": "`"}
_BLOCKS = frozenset("p div section article header footer nav main ul ol table tr blockquote pre".split())
_HIDDEN = frozenset("script style head template noscript".split())


class _Markdown(_Walker):
    ends_itself = {
        "li": frozenset(("ul", "ol")), "p": frozenset(("div", "li", "td", "blockquote", "article", "section")),
        "tr": frozenset(("table",)), "td": frozenset(("tr",)), "th": frozenset(("tr",)),
    }

    def __init__(self, strip, convert, autolinks):
        super().__init__()
        self.strip, self.convert, self.autolinks = strip, convert, autolinks
        self.buffers: list[list[str]] = [[]]
        self.lists: list[int | None] = []  # per open list: next number, or None for bullets

    def _on(self, tag) -> bool:
        return tag in self.convert if self.convert is not None else tag not in self.strip

    def handle_data(self, data):
        names = {tag for tag, _ in self.open}
        if not names & _HIDDEN:
            self.buffers[-1].append(data if "pre" in names else re.sub(r"\s+", " ", data))

    def enter(self, tag, attrs):
        if not self._on(tag):
            pass
        elif tag == "br":
            self.buffers[-1].append("  \n")
        elif tag == "hr":
            self.buffers[-1].append("\n\n---\n\n")
        elif tag == "img":
            self.buffers[-1].append(f"![{attrs.get('alt', '')}]({attrs.get('src', '')})")
        if tag in ("ul", "ol"):
            self.lists.append(1 if tag == "ol" else None)
        if tag not in VOID:
            self.buffers.append([])

    def leave(self, tag, attrs):
        inner = "".join(self.buffers.pop()) if len(self.buffers) > 1 else ""
        in_list = len(self.lists)
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        self.buffers[-1].append(self._written(tag, attrs, inner, in_list) if self._on(tag) else inner)

    def _written(self, tag, attrs, inner: str, depth: int) -> str:
        text = inner.strip()
        if re.fullmatch("h[1-6]", tag):
            return f"\n\n{'#' * int(tag[1])} {text}\n\n" if text else ""
        if tag in _MARKS:
            # The blanks stay outside of the marks.
            lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
            return f"{lead}{_MARKS[tag]}{text}{_MARKS[tag]}{tail}" if text else inner
        if tag == "a" and attrs.get("href") and text:
            href = attrs["href"]
            return f"<{href}>" if self.autolinks and text == href else f"[{text}]({href})"
        if tag == "li":
            mark = "*"
            if self.lists and self.lists[-1] is not None:
                mark, self.lists[-1] = f"{self.lists[-1]}.", self.lists[-1] + 1
            body = re.sub(r"\n+", "\n", text).replace("\n", "\n" + " " * (len(mark) + 1))
            return f"{mark} {body}\n"
        if tag == "pre":
            return f"\n\n```\n{inner.strip(chr(10))}\n```\n\n"
        if tag == "blockquote":
            return "\n\n" + "\n".join(f"> {line}" for line in text.split("\n")) + "\n\n" if text else ""
        if tag in ("td", "th"):
            return f" {text} |"
        if tag == "tr":
            return f"|{inner.strip()}\n" if text.endswith("|") else inner
        if tag in ("ul", "ol"):
            return ("\n" if depth > 1 else "\n\n") + inner.strip("\n ") + ("\n" if depth > 1 else "\n\n")
        return f"\n\n{text}\n\n" if tag in _BLOCKS else inner


def html_markdown(html: str, strip=(), convert=None, autolinks: bool = True) -> str:
    """The page as Markdown. ``strip``: tags whose marks are left out; ``convert``: the only tags that get marks."""
    walker = _Markdown(frozenset(strip), None if convert is None else frozenset(convert), autolinks).finish(html)
    return re.sub(r"\n\s*\n", "\n\n", "".join(walker.buffers[0])).strip()
