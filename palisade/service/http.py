"""The query API over HTTP, by the standard library: for trials and tests; put a real server before it elsewhere.

POST /v1/query {sql, params, max_rows, timeout_ms, format, meta, approval_id}; POST /v1/explain {sql};
GET /v1/catalogs, /v1/tables?catalog=&cursor=&limit=, /v1/tables/NAME, /v1/whoami, /v1/approvals/ID, /healthz;
POST /v1/approvals/ID {approve} for members of ``approvers``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from palisade.model import Facts, GovernError, UserCtx
from palisade.operators.dsl import Policy
from palisade.service import identity
from palisade.service.core import Governed

MAX_BODY = 2 << 20
Authenticate = Callable[[dict[str, str]], UserCtx]


def authenticator(bindings: list[Policy], pepper: str = "", **kwargs) -> Authenticate:
    """By X-Api-Key or a bearer token; header names are lower case."""

    def check(headers: dict[str, str]) -> UserCtx:
        if "x-api-key" in headers:
            return identity.from_api_key(headers["x-api-key"], pepper, bindings)
        kind, _, token = headers.get("authorization", "").partition(" ")
        if kind.lower() != "bearer" or not token:
            raise GovernError("ERR_UNAUTHORIZED", "no credentials")
        return identity.from_jwt(token.strip(), bindings, **kwargs)

    return check


def serve(g: Governed, authenticate: Authenticate, host: str = "127.0.0.1", port: int = 0, approvers: str = "approvers") -> ThreadingHTTPServer:
    """A server bound to ``host`` and ``port``; call ``serve_forever`` on it."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *args) -> None:
            """Requests are in the audit log."""

        def _send(self, status: int, body: bytes, kind: str = "application/json") -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _answer(self, route: Callable[[UserCtx, Facts], object]) -> None:
            try:
                headers = {k.lower(): v for k, v in self.headers.items()}
                facts = Facts(self.client_address[0], headers.get("user-agent", ""), {k: v for k, v in headers.items() if k not in ("authorization", "x-api-key", "cookie")})
                got = route(authenticate(headers), facts)
                if isinstance(got, tuple):
                    self._send(200, got[0].encode(), got[1])
                else:
                    self._send(200, json.dumps(got, default=str).encode())
            except GovernError as e:
                self._send(e.status, json.dumps({"error": {"code": e.code, "message": e.message, "details": e.details}}, default=str).encode())
            except Exception as e:  # whatever else goes wrong is not told to callers
                self._send(500, json.dumps({"error": {"code": "ERR_INTERNAL", "message": type(e).__name__}}).encode())

        def _body(self) -> dict:
            n = int(self.headers.get("Content-Length") or 0)
            if n > MAX_BODY:
                self.close_connection = True
                raise GovernError("ERR_PAYLOAD_TOO_LARGE", "the body is too long")
            try:
                d = json.loads(self.rfile.read(n) or b"{}")
            except ValueError:
                d = None
            if not isinstance(d, dict):
                raise GovernError("ERR_SYNTAX", "the body is a JSON object")
            return d

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            parts = [unquote(p) for p in url.path.strip("/").split("/")]
            if parts == ["healthz"]:
                self._send(200, b'{"status": "ok"}')
                return

            def route(user: UserCtx, facts: Facts) -> object:
                if parts == ["v1", "catalogs"]:
                    return {"catalogs": g.catalogs(user, facts)}
                if parts == ["v1", "tables"]:
                    names, cursor = g.list_tables(user, facts, q.get("catalog"), q.get("cursor", ""), int(q["limit"]) if q.get("limit", "").isdigit() else None)
                    return {"tables": names, "cursor": cursor}
                if parts[:2] == ["v1", "tables"] and len(parts) == 3:
                    return {"columns": g.describe(parts[2], user, facts)}
                if parts == ["v1", "whoami"]:
                    return g.whoami(user)
                if parts[:2] == ["v1", "approvals"] and len(parts) == 3:
                    r = g.approvals.get(parts[2])
                    if user.subject != r.subject and approvers not in user.groups:
                        raise GovernError("ACL_DENIED", "not your approval")
                    return {"id": r.id, "state": r.state, "policy": r.policy, "reason": r.reason}
                raise GovernError("ERR_UNSUPPORTED_SYNTAX", "no such route")

            self._answer(route)

        def do_POST(self) -> None:
            parts = urlsplit(self.path).path.strip("/").split("/")

            def route(user: UserCtx, facts: Facts) -> object:
                d = self._body()
                if parts == ["v1", "query"]:
                    form = d.get("format") or "json"
                    if form not in ("json", "csv"):
                        raise GovernError("ERR_UNSUPPORTED_SYNTAX", "format is json or csv")
                    r = g.execute(str(d.get("sql") or ""), user, facts, d.get("params") or None, d.get("max_rows"), d["timeout_ms"] / 1000 if d.get("timeout_ms") else None, d.get("approval_id"), d.get("meta"))
                    return (r.to_csv(), "text/csv") if form == "csv" else (r.to_json(), "application/json")
                if parts == ["v1", "explain"]:
                    return g.explain_access(str(d.get("sql") or ""), user, facts)
                if parts[:2] == ["v1", "approvals"] and len(parts) == 3:
                    if approvers not in user.groups:
                        raise GovernError("ACL_DENIED", "only approvers decide")
                    return {"state": g.approvals.decide(parts[2], d.get("approve") is True, user.subject).state}
                raise GovernError("ERR_UNSUPPORTED_SYNTAX", "no such route")

            self._answer(route)

    return ThreadingHTTPServer((host, port), Handler)
