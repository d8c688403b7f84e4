"""Name patterns: * within a segment, ** across segments, backslash takes the next character as it is."""

from __future__ import annotations

import re
from functools import lru_cache

from palisade.model import invalid


@lru_cache(maxsize=10_000)
def compiled(pattern: str) -> re.Pattern[str]:
    if not pattern:
        raise invalid("empty name pattern")
    out, chars = [], iter(range(len(pattern)))
    for i in chars:
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise invalid(f"pattern ends in a backslash: {pattern}")
            out.append(re.escape(pattern[next(chars)]))
        elif c == "*" and pattern[i + 1 : i + 2] == "*":
            next(chars)
            out.append(".*")
        else:
            out.append("[^.]*" if c == "*" else re.escape(c))
    return re.compile("".join(out), re.DOTALL)


def matches(pattern: str, name: str) -> bool:
    """Anchored, case-sensitive."""
    return compiled(pattern).fullmatch(name) is not None


def is_literal(pattern: str) -> bool:
    return "*" not in pattern.replace("\\*", "")


def specificity(pattern: str) -> int:
    """A literal name beats every wildcard pattern; among those, more literal characters win."""
    literal = len(pattern.replace("\\", "").replace("*", "")) if not is_literal(pattern) else len(pattern.replace("\\", ""))
    return 1000 + literal if is_literal(pattern) else literal
