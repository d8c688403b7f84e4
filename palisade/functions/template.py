"""Whole-value templates ``{{ subject.… }}`` and ``{{ request.… }}``; what is missing is an error, never empty."""

from __future__ import annotations

import re
from typing import Any

from palisade.model import Facts, GovernError, UserCtx, invalid

WHOLE = re.compile(r"\s*\{\{\s*([A-Za-z_][\w.\-]*)\s*\}\}\s*")


class Missing(GovernError):
    def __init__(self, name: str):
        super().__init__("ACL_DENIED", f"template variable {name} is missing")


def path_of(value: Any) -> list[str] | None:
    """The dotted path of a template value; None for plain values."""
    if not isinstance(value, str) or "{{" not in value:
        return None
    m = WHOLE.fullmatch(value)
    if not m:
        raise invalid(f"a template must be the whole value: {value!r}")
    path = m[1].split(".")
    if path[0] not in ("subject", "request") or "" in path:
        raise invalid(f"unknown template root in {value!r}")
    return path


def walk(claims: Any, path: list[str]) -> tuple[Any, bool]:
    for part in path:
        if not isinstance(claims, dict) or part not in claims:
            return None, False
        claims = claims[part]
    return claims, bool(path)


def resolve(path: list[str], user: UserCtx | None, facts: Facts | None) -> Any:
    name, (root, *rest) = ".".join(path), path
    if root == "subject" and user is not None and rest:
        plain = {"sub": user.subject, "subject": user.subject, "issuer": user.issuer, "email": user.email, "groups": list(user.groups), "auth_method": user.auth_method, "request_id": user.request_id}
        if rest[0] in plain:
            if len(rest) > 1:
                raise Missing(name)
            return plain[rest[0]]
        value, found = walk(user.claims, rest[1:] if rest[0] in ("jwt", "claims") else rest)
        if found:
            return value
    elif root == "request" and facts is not None and rest:
        if rest == ["remote_ip"] and facts.remote_ip is not None:
            return facts.remote_ip
        if rest == ["user_agent"] and facts.user_agent is not None:
            return facts.user_agent
        if rest[0] == "headers" and len(rest) == 2 and rest[1] in facts.headers:
            return facts.headers[rest[1]]
    raise Missing(name)
