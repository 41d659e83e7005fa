"""Queries as one line of text, and addresses that are refused."""

from __future__ import annotations

import re

from .parser import ParseError, parse, tokens

_KEYWORD = re.compile(r"[A-Za-z]+\Z")
# fixed values: names that keep their case in a query
_AS_THEY_ARE = {"a", "true", "false"}


def one_line(text: str, prefixes: dict[str, str], base: str = "") -> str:
    """The query's tokens with single spaces between, keywords in capitals, comments gone; it must read back as the same query."""
    out = []
    for kind, value in tokens(text):
        if value:
            out.append(value.upper() if _KEYWORD.match(value) and value not in _AS_THEY_ARE else value)
    line = re.sub(r" \.(?= |$)", " .", " ".join(out))
    if parse(line, prefixes, base) != parse(text, prefixes, base):
        raise ParseError("the query does not read back as itself")
    return line


def derived_property(document: str, prefixes: dict[str, str], base: str = "") -> str | None:
    """The value of a saved query's derived property: its first fenced block on one line; none where it does not parse. What an author wrote there does not count."""
    from ..functions.extract import first_fence, split_frontmatter

    block = first_fence(split_frontmatter(document)[1])
    if block is None:
        return None
    try:
        return one_line(block, prefixes, base)
    except ParseError:
        return None


def refuse_old_address(text: str, root: str, base: str) -> None:
    """A query over a store of its own may not name the platform's root; the error names the short form."""
    for found in re.findall(rf"<({re.escape(root)}[^>]*)>", text):
        if not found.startswith(base):
            raise ValueError(f"<{found}> is an old address; in this store write <{found.removeprefix(root)}>")
