"""What all parts share: error codes, identities, table keys, query shapes, decisions."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

#: Error codes and their HTTP status.
CODES = {
    "ERR_SYNTAX": 400, "ERR_MULTIPLE_STATEMENTS": 400, "ERR_UNSUPPORTED_SYNTAX": 400, "ERR_REWRITE_FAILED": 400,
    "ERR_MASK_UNSUPPORTED_CONTEXT": 400, "ERR_UNAUTHORIZED": 401, "ACL_DENIED": 403, "ACL_REJECTED": 403,
    "ERR_DATASOURCE_UNAVAILABLE": 503, "ERR_CONFIG_INVALID": 400, "ERR_POLICY_INVALID": 400, "ERR_TIMEOUT": 504,
    "ERR_CANCELED": 499, "ERR_RATE_LIMITED": 429, "ERR_BUDGET_EXCEEDED": 429, "ERR_PAYLOAD_TOO_LARGE": 413,
    "ERR_RESULT_TRUNCATED": 200, "ERR_AUDIT_UNAVAILABLE": 503, "ERR_APPROVAL_PENDING": 202,
    "ERR_APPROVAL_REJECTED": 403, "ERR_APPROVAL_EXPIRED": 410, "ERR_INTERNAL": 500,
}


class GovernError(Exception):
    """An error with a code of ``CODES``; ``details`` may go to the caller."""

    def __init__(self, code: str, message: str, **details: Any):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.details = code, message, details

    @property
    def status(self) -> int:
        return CODES.get(self.code, 500)


def invalid(message: str) -> GovernError:
    return GovernError("ERR_POLICY_INVALID", message)


@dataclass(frozen=True, order=True)
class TableKey:
    catalog: str
    schema: str
    table: str

    def __post_init__(self):
        if not (self.catalog and self.schema and self.table):
            raise ValueError("a table key has three parts")

    def __str__(self) -> str:
        return f"{self.catalog}.{self.schema}.{self.table}"

    @classmethod
    def parse(cls, text: str) -> TableKey:
        parts = text.split(".")
        if len(parts) != 3:
            raise ValueError(f"not catalog.schema.table: {text}")
        return cls(*parts)


@dataclass(frozen=True)
class UserCtx:
    subject: str
    issuer: str = ""
    email: str = ""
    groups: tuple[str, ...] = ()
    claims: dict[str, Any] = field(default_factory=dict, hash=False)
    auth_method: str = "jwt"
    remote_addr: str = ""
    request_id: str = ""
    api_key: str = ""
    binding: str = ""


@dataclass(frozen=True)
class Facts:
    """Facts of the request; what is None was not told and fails any template that names it."""

    remote_ip: str | None = None
    user_agent: str | None = None
    headers: dict[str, str] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Comparison:
    column: str
    op: str
    value: str


@dataclass(frozen=True)
class TableRef:
    """An occurrence of a table in the text; ``start`` and ``stop`` are the name's span (inclusive)."""

    parts: tuple[str, ...]
    start: int
    stop: int
    alias: str | None = None


@dataclass
class Shape:
    kind: str = "SELECT"
    has_select_star: bool = False
    is_aggregate: bool = False
    has_cte: bool = False
    is_recursive_cte: bool = False
    has_union: bool = False
    has_limit: bool = False
    limit: int = 0
    has_order_by: bool = False
    has_where: bool = False
    where_columns: list[str] = field(default_factory=list)
    group_by_columns: list[str] = field(default_factory=list)
    joins: int = 0
    columns: list[str] = field(default_factory=list)
    comparisons: list[Comparison] = field(default_factory=list)
    functions: list[str] = field(default_factory=list)
    tables: list[TableKey] = field(default_factory=list)

    @property
    def catalogs(self) -> list[str]:
        return list(dict.fromkeys(t.catalog for t in self.tables))

    def facts(self) -> dict[str, Any]:
        names = ("has_select_star", "is_aggregate", "has_cte", "has_union", "has_limit", "limit", "has_order_by", "has_where", "where_columns", "group_by_columns", "joins", "is_recursive_cte")
        return {n: getattr(self, n) for n in names} | {"catalogs": self.catalogs, "tables": [str(t) for t in self.tables]}


@dataclass
class MaskRule:
    policy: str
    priority: int
    pattern: str
    type: str
    args: dict[str, Any]


@dataclass
class Decision:
    outcome: str = "deny"  # allow, deny, reject, approval
    abstained: bool = False
    deny_policy: str = ""
    code: str = ""
    message: str = ""
    applied: list[str] = field(default_factory=list)
    shadow: list[str] = field(default_factory=list)
    rejections: list[dict[str, str]] = field(default_factory=list)
    filters: dict[TableKey, list[tuple[Any, str]]] = field(default_factory=dict)  # (predicate, combine), in order
    masks: dict[TableKey, list[MaskRule]] = field(default_factory=dict)
    limit: int | None = None
    timeout: float | None = None
    sample: tuple[float, str] | None = None
    approval: dict[str, str] | None = None
