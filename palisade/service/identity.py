"""Identities: API keys (HMAC with a pepper), HS, RS and ES tokens, and claim paths of a subject binding."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time
from collections.abc import Callable
from typing import Any

from palisade.functions import secrets, template
from palisade.model import GovernError, UserCtx
from palisade.operators.dsl import Policy


def _unauthorized(message: str) -> GovernError:
    return GovernError("ERR_UNAUTHORIZED", message)


def api_key_hash(pepper: str, key_id: str, secret: str) -> str:
    return hmac.new(pepper.encode(), f"{key_id}:{secret}".encode(), hashlib.sha256).hexdigest()


def from_api_key(presented: str, pepper: str, bindings: list[Policy]) -> UserCtx:
    """The key is id.secret, split at the last dot."""
    key_id, _, secret = presented.rpartition(".")
    for b in bindings:
        for k in b.spec.get("apiKeys") or []:
            if k.get("id") == key_id and key_id:
                want = secrets.resolve(k["hashRef"]) if k.get("hashRef") else k.get("hash", "")
                if hmac.compare_digest(want, api_key_hash(pepper, key_id, secret)):
                    subject = (b.spec.get("claims") or {}).get("subjectId") or key_id
                    return UserCtx(subject, groups=tuple(k.get("groups") or ()), claims=dict(k.get("claims") or {}), auth_method="api_key", api_key=key_id, binding=b.name)
    raise _unauthorized("unknown API key")


def _part(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def _number(text: str) -> int:
    return int.from_bytes(_part(text))


#: ASN.1 heads of digests in RSA signatures, and the curve P-256.
DIGESTS = {"256": ("sha256", "3031300d060960864801650304020105000420"), "384": ("sha384", "3041300d060960864801650304020205000430"), "512": ("sha512", "3051300d060960864801650304020305000440")}
P256 = 2**256 - 2**224 + 2**192 + 2**96 - 1
A256, N256 = P256 - 3, 0xFFFFFFFF00000000FFFFFFFFFFFFFFFFBCE6FAADA7179E84F3B9CAC2FC632551
G256 = (0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296, 0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5)


def _rsa(key: dict, bits: str, data: bytes, sign: bytes) -> bool:
    n, e = _number(key["n"]), _number(key["e"])
    size = (n.bit_length() + 7) // 8
    name, head = DIGESTS[bits]
    digest = bytes.fromhex(head) + hashlib.new(name, data).digest()
    if size < 256 or len(sign) != size or (s := int.from_bytes(sign)) >= n:
        return False
    want = b"\0\1" + b"\xff" * (size - len(digest) - 3) + b"\0" + digest
    return hmac.compare_digest(pow(s, e, n).to_bytes(size), want)


def _add(p: tuple | None, q: tuple | None) -> tuple | None:
    if p is None or q is None:
        return p or q
    if p[0] == q[0] and (p[1] + q[1]) % P256 == 0:
        return None
    slope = (3 * p[0] * p[0] + A256) * pow(2 * p[1], -1, P256) if p == q else (q[1] - p[1]) * pow(q[0] - p[0], -1, P256)
    x = (slope * slope - p[0] - q[0]) % P256
    return x, (slope * (p[0] - x) - p[1]) % P256


def _times(k: int, p: tuple | None) -> tuple | None:
    out = None
    while k:
        if k & 1:
            out = _add(out, p)
        p, k = _add(p, p), k >> 1
    return out


def _ecdsa(key: dict, data: bytes, sign: bytes) -> bool:
    q = (_number(key["x"]), _number(key["y"]))
    b = (G256[1] ** 2 - G256[0] ** 3 - A256 * G256[0]) % P256
    if key.get("crv") != "P-256" or len(sign) != 64 or (q[1] ** 2 - q[0] ** 3 - A256 * q[0] - b) % P256:
        return False
    r, s = int.from_bytes(sign[:32]), int.from_bytes(sign[32:])
    if not (0 < r < N256 and 0 < s < N256):
        return False
    w = pow(s, -1, N256)
    at = _add(_times(int.from_bytes(hashlib.sha256(data).digest()) * w % N256, G256), _times(r * w % N256, q))
    return at is not None and at[0] % N256 == r


def read_keys(url: str) -> dict[str, Any]:
    """A key set from a file; pass another ``fetch`` for keys behind HTTPS."""
    if not url.startswith("file://"):
        raise GovernError("ERR_CONFIG_INVALID", "only key files can be read here")
    with open(url.removeprefix("file://"), encoding="utf-8") as f:
        return json.load(f)


def _signed(b: Policy, head: dict, data: bytes, sign: bytes, fetch: Callable[[str], dict[str, Any]]) -> bool:
    """The key's own kind decides what algorithm may be, so a public key is never an HMAC secret."""
    kind, bits = str(head.get("alg", ""))[:2], str(head.get("alg", ""))[2:]
    if kind == "HS" and bits in DIGESTS and b.spec.get("hmacSecretRef"):
        return hmac.compare_digest(hmac.new(secrets.resolve(b.spec["hmacSecretRef"]).encode(), data, DIGESTS[bits][0]).digest(), sign)
    if (kind == "RS" and bits in DIGESTS or head.get("alg") == "ES256") and b.spec.get("jwksUrl"):
        for k in fetch(b.spec["jwksUrl"]).get("keys") or []:
            if head.get("kid") in (None, k.get("kid")) and k.get("kty") == {"RS": "RSA", "ES": "EC"}[kind]:
                if _rsa(k, bits, data, sign) if kind == "RS" else _ecdsa(k, data, sign):
                    return True
        return False
    raise _unauthorized("unsupported algorithm")


def from_jwt(token: str, bindings: list[Policy], clock: Callable[[], float] = time.time, leeway: float = 60, fetch: Callable[[str], dict[str, Any]] = read_keys) -> UserCtx:
    try:
        head64, body64, sign64 = token.split(".")
        head, claims, sign = json.loads(_part(head64)), json.loads(_part(body64)), _part(sign64)
    except ValueError:
        raise _unauthorized("not a token") from None
    for b in bindings:
        if b.spec.get("issuer") != claims.get("iss") or not (b.spec.get("hmacSecretRef") or b.spec.get("jwksUrl")):
            continue
        audience = claims.get("aud")
        if (want := b.spec.get("audience")) and want not in (audience if isinstance(audience, list) else [audience]):
            continue
        if not _signed(b, head, f"{head64}.{body64}".encode(), sign, fetch):
            raise _unauthorized("bad signature")
        now = clock()
        if "exp" not in claims or now > claims["exp"] + leeway or now < claims.get("nbf", 0) - leeway:
            raise _unauthorized("the token is not valid now")
        return user_from_claims(claims, b)
    raise _unauthorized("unknown issuer or audience")


def user_from_claims(claims: dict[str, Any], binding: Policy) -> UserCtx:
    paths = binding.spec.get("claims") or {}

    def at(name: str, default: str) -> Any:
        value, found = template.walk(claims, (paths.get(name) or default).split("."))
        return value if found else None

    subject, groups = at("subjectId", "sub"), at("groups", "groups") or []
    if not isinstance(subject, str) or not subject:
        raise _unauthorized("the token names no subject")
    groups = [groups] if isinstance(groups, str) else [g for g in groups if isinstance(g, str)]
    return UserCtx(subject, str(claims.get("iss") or ""), at("email", "email") or "", tuple(groups), claims, "jwt", binding=binding.name)
