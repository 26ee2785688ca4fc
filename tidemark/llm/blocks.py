"""Leaf blocks of HTML pages, however broken, with their tag paths."""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

#: Elements that run on in a line of text; all others begin and end blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big blink cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag, and of these the ones that readers see.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: Elements that a start tag of the given name ends, if they are open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that such a start tag does not reach beyond.
HOLDS = frozenset("ul ol dl table tbody thead tfoot select".split())
#: Elements that a head may hold; any other ends it.
HEADED = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: Number of hash buckets of path words.
PATHS = 2048

SPACE = re.compile(r"[\x20\x09-\x0D]+")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
QUOTED = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block(NamedTuple):
    text: str
    path: tuple[int, ...]  # hash buckets of names and attribute words of all open elements, then those of the innermost one marked as such
    linked: int  # code points inside links
    depth: int


def tags(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): text, start and end tags in page order; comments, declarations and unfinished tags go."""
    at, n = 0, len(page)
    quotes = {'"': True, "'": True}
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        closing = page.startswith("</", lt)
        name = NAME.match(page, lt + 1 + closing)
        if not name and not closing and page[lt + 1 : lt + 2] not in ("!", "?"):
            yield "text", "", "<"
            at = lt + 1
            continue
        at = name.end() if name else lt + 1
        end = -1
        while mark := QUOTED.search(page, at):
            if mark[0] == ">":
                end = mark.start()
                break
            shut = page.find(mark[0], mark.end()) if quotes[mark[0]] else -1
            quotes[mark[0]] = shut >= 0
            at = mark.end() if shut < 0 else shut + 1
        if end < 0:
            return
        at = end + 1
        if not name:
            continue
        tag = name[0].lower()
        yield "end" if closing else "start", tag, page[name.end() : end]
        if tag in RAW and not closing:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if tag == "textarea":
                yield "text", "", page[at : stop.start() if stop else n]
            at = stop.start() if stop else n


@functools.lru_cache(1 << 16)
def path_bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % PATHS


def words_of(tag: str, rest: str) -> list[str]:
    """What is said of an element: its name, and the words of its class, id, role and itemprop."""
    found = [f"t:{tag}"]
    for m in ATTRIBUTE.finditer(rest):
        found += dict.fromkeys(f"c:{p.lower()}" for p in PART.findall(m[2] or m[3] or m[4] or ""))
    return found


def blocks(page: str) -> list[Block]:
    """Every leaf block with text: character references decoded, white space inside turned into one space, trimmed.

    A block is the text between two tags that aren't inline; a line break is white space. Heads are no text.
    """
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    opened: Counter[str] = Counter()
    said: Counter[int] = Counter()
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip(" ")
        parts.clear()
        if text and not opened["head"]:
            inner = stack[-1][1] if stack else []
            out.append(Block(text, (*said, *(path_bucket(f"in {w}") for w in inner)), min(linked, len(text)), len(stack)))
        linked = 0

    def pop() -> str:
        tag, words = stack.pop()
        opened[tag] -= 1
        for w in map(path_bucket, words):
            said[w] -= 1
            if not said[w]:
                del said[w]
        return tag

    for kind, tag, rest in tags(page):
        if kind == "text":
            parts.append(rest)
            if links:
                linked += len(rest)
        elif tag in INLINE:
            if tag == "a":
                links = max(0, links + (1 if kind == "start" else -1))
        elif tag == "br":
            parts.append(" ")
        elif kind == "start":
            flush()
            if opened["p"] and stack[-1][0] == "p":
                pop()
            if tag not in HEADED and tag not in ("html", "head"):
                while opened["head"]:
                    pop()
            closes = CLOSES.get(tag, ())
            if any(opened[c] for c in closes):
                i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in closes or stack[i][0] in HOLDS), -1)
                if i >= 0 and stack[i][0] in closes:
                    while len(stack) > i:
                        pop()
                    if stack and stack[-1][0] in closes and tag == "tr":
                        pop()
            if tag not in VOID and not rest.rstrip().endswith("/"):
                words = words_of(tag, rest)
                stack.append((tag, words))
                opened[tag] += 1
                said.update(map(path_bucket, words))
        elif opened[tag]:
            flush()
            links = 0
            while pop() != tag:
                pass
        else:
            flush()
    flush()
    return out
