"""Inline elements of exchange files, walked node by node, to tags in the text.

Elements that wrap a text give a pair of tags, those that mark a beginning or an end give one
of a pair, empty ones a single tag. Their own content, which shows codes of other formats, is
left out. Annotations are transparent, and an element of any other name stays as it was written.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

# Element names of the two versions.
WRAPS = {"g", "pc"}
BEGINS = {"bpt", "bx", "sc"}
ENDS = {"ept", "ex", "ec"}
SINGLE = {"x", "ph", "it"}
TRANSPARENT = {"mrk", "sm", "em"}
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"  # characters that XML 1.0 cannot hold


def local_name(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


class Numbers:
    """Tag numbers of the ids of a unit: an id that is a number is kept, others follow 1000."""

    def __init__(self):
        self.others: dict[str, int] = {}

    def of(self, node: ET.Element) -> str:
        own = next((node.get(a) for a in ("startRef", "rid", "id") if node.get(a)), "")
        if own.isascii() and own.isdigit():
            return own
        return str(self.others.setdefault(own, 1001 + len(self.others)))


def _character(node: ET.Element) -> str | None:
    """What stands for a character that XML cannot hold, in either version."""
    name, kind = local_name(node), node.get("ctype", "")
    code = node.get("hex") if name == "cp" else kind.removeprefix("x-cp-") if kind.startswith("x-cp-") else None
    try:
        return None if code is None else chr(int(code, 16))
    except (ValueError, OverflowError):
        return ""


def _walk(node: ET.Element, numbers: Numbers) -> Iterator[str]:
    yield node.text or ""
    for child in node:
        name = local_name(child)
        character = _character(child)
        if character is not None:
            yield character
        elif name in WRAPS:
            number = numbers.of(child)
            yield f"<tag{number}>"
            yield from _walk(child, numbers)
            yield f"</tag{number}>"
        elif name in BEGINS:
            yield f"<tag{numbers.of(child)}>"
        elif name in ENDS:
            yield f"</tag{numbers.of(child)}>"
        elif name in SINGLE:
            yield f"<tag{numbers.of(child)}/>"
        elif name in TRANSPARENT:
            yield from _walk(child, numbers)
        elif name:
            own = "".join(f" {k}={quoteattr(v)}" for k, v in child.items())
            inner = "".join(_walk(child, numbers))
            yield f"<{name}{own}>{inner}</{name}>" if inner else f"<{name}{own}/>"
        yield child.tail or ""


def tagged_text(node: ET.Element, numbers: Numbers) -> str:
    """Text of an element with tags for its inline elements."""
    return "".join(_walk(node, numbers))


_STRAY = re.compile(r"&(?!#?\w+;)|<(?![/A-Za-z])")


def fragment_text(xml: str | None) -> str | None:
    """The same of element content that stands by itself; what is not well formed stays as it is."""
    if xml is None or ("<" not in xml and "&" not in xml):
        return xml
    whole = _STRAY.sub(lambda m: {"&": "&amp;", "<": "&lt;"}[m[0]], xml)
    try:
        return tagged_text(ET.fromstring(f"<r>{whole}</r>"), Numbers())
    except ET.ParseError:
        return xml
