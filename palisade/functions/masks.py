"""Column masks: each provider checks its arguments when policies load and makes a Column for each query.

All but ``fpe`` are built-in expressions, so masked scans stay in generated code.  ``post`` masks (hmac hash, jitter,
fpe, fake) are allowed only on bare columns of the outermost select list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions import cel, fpe, secrets
from palisade.model import GovernError, invalid

Build = Callable[[Column, T.DataType, dict[str, Any]], Column]


@dataclass(frozen=True)
class Provider:
    build: Build
    check: Callable[[dict[str, Any]], None] = lambda args: None
    post: Callable[[dict[str, Any]], bool] = lambda args: False
    numeric: bool = False


class MaskRegistry:
    """Named providers; ``register`` adds one of your own."""

    REFUSED = ("custom", "external")

    def __init__(self):
        self.providers: dict[str, Provider] = {}

    def register(self, name: str, provider: Provider) -> None:
        if name in self.REFUSED or name in self.providers:
            raise invalid(f"mask provider {name} cannot be registered")
        self.providers[name] = provider

    def get(self, name: str) -> Provider:
        if name not in self.providers:
            raise invalid(f"mask provider not enabled: {name}")
        return self.providers[name]

    def check(self, name: str, args: dict[str, Any]) -> None:
        self.get(name).check(args)

    def is_post(self, name: str, args: dict[str, Any]) -> bool:
        return self.get(name).post(args)

    def column(self, name: str, c: Column, kind: T.DataType, args: dict[str, Any]) -> Column:
        return self.get(name).build(c, kind, args)


def secret(text: str | None) -> str:
    return secrets.resolve(text) if text and secrets.is_reference(text) else text or ""


def _text(c: Column) -> Column:
    return c.cast("string")


def _null(c: Column, kind: T.DataType, args: dict) -> Column:
    return F.lit(None).cast(kind)


def _constant_ok(args: dict) -> None:
    if args.get("value") is None or isinstance(args["value"], (dict, list)):
        raise invalid("constant needs a scalar value")


def _partial_ok(args: dict) -> None:
    for k in ("showFirst", "showLast"):
        if not isinstance(args.get(k, 0), int) or isinstance(args.get(k, 0), bool) or args.get(k, 0) < 0:
            raise invalid(f"{k} is a count")
    if len(args.get("maskChar") or "*") != 1:
        raise invalid("maskChar is one character")


def _partial(c: Column, kind: T.DataType, args: dict) -> Column:
    """Values of at most showFirst + showLast characters stay as they are."""
    t, first, last = _text(c), args.get("showFirst", 0), args.get("showLast", 0)
    n = F.char_length(t)
    tail = F.substr(t, F.greatest(n - last + 1, F.lit(first + 1)))
    return F.concat(F.substr(t, F.lit(1), F.lit(first)), F.repeat(F.lit(args.get("maskChar") or "*"), F.greatest(n - first - last, F.lit(0))), tail)


def _hash_ok(args: dict) -> None:
    if args.get("algorithm", "sha256") not in ("sha256", "hmac_sha256"):
        raise invalid("algorithm is sha256 or hmac_sha256")
    if args.get("algorithm") == "hmac_sha256" and not args.get("saltRef"):
        raise invalid("hmac_sha256 needs saltRef")


def hmac_hex(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a binary column, in hexadecimal."""
    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in k)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def _hash(c: Column, kind: T.DataType, args: dict) -> Column:
    t = _text(c)
    if args.get("algorithm") == "hmac_sha256":
        return hmac_hex(secret(args["saltRef"]).encode(), t.cast("binary"))
    if args.get("saltRef"):  # a null hashes as the salt alone
        return F.sha2(F.concat(F.lit(secret(args["saltRef"])), F.coalesce(t, F.lit(""))), 256)
    return F.sha2(t, 256)


def _regex_ok(args: dict) -> None:
    cel.safe_regex(args.get("pattern"))


def java_replacement(text: str) -> str:
    r"""``\1`` refers to a group, everything else stands for itself."""
    out, i = [], 0
    while i < len(text):
        if text[i] == "\\" and text[i + 1 : i + 2].isdigit():
            out.append("$" + text[i + 1])
            i += 2
        else:
            out.append("\\" + text[i] if text[i] in "\\$" else text[i])
            i += 1
    return "".join(out)


def _regex(c: Column, kind: T.DataType, args: dict) -> Column:
    return F.regexp_replace(_text(c), F.lit(args["pattern"]), F.lit(java_replacement(args.get("replacement") or "")))


def _truncate_ok(args: dict) -> None:
    if not isinstance(args.get("length"), int) or args["length"] < 1:
        raise invalid("truncate needs a length of at least 1")


def _truncate(c: Column, kind: T.DataType, args: dict) -> Column:
    t, n = _text(c), args["length"]
    return F.when(F.char_length(t) > n, F.concat(F.substr(t, F.lit(1), F.lit(n)), F.lit(args.get("suffix") or ""))).otherwise(t)


def _jitter_ok(args: dict) -> None:
    r = args.get("range")
    if not isinstance(r, (int, float)) or isinstance(r, bool) or not 0 < r < 1:
        raise invalid("jitter needs a range between 0 and 1")
    if not args.get("seed"):
        raise invalid("jitter needs a seed")


def first_number(hexa: Column) -> Column:
    """The first 8 bytes as an unsigned number."""
    return F.conv(F.substr(hexa, F.lit(1), F.lit(16)), 16, 10).cast("decimal(20,0)")


def _jitter(c: Column, kind: T.DataType, args: dict) -> Column:
    if not isinstance(kind, (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)):
        raise GovernError("ERR_REWRITE_FAILED", "jitter needs a numeric column")
    u = first_number(hmac_hex(secret(args["seed"]).encode(), _text(c).cast("binary"))).cast("double") / F.lit(float(2**64 - 1))
    x = c.cast("double") * (1 + (2 * u - 1) * F.lit(float(args["range"])))
    return F.round(x).cast(kind) if isinstance(kind, (T.IntegerType, T.LongType)) else x.cast(kind)


def _alphabet(args: dict) -> str:
    return args.get("customAlphabet") or fpe.ALPHABETS.get(args.get("alphabet") or "numeric", "")


def _fpe_ok(args: dict) -> None:
    a = _alphabet(args)
    if not 2 <= len(a) <= 36 or len(set(a)) != len(a):
        raise invalid("an alphabet has 2 to 36 different characters")
    if not args.get("keyRef"):
        raise invalid("fpe needs keyRef")
    try:
        if len(bytes.fromhex(args.get("tweak") or "")) > 16:
            raise ValueError
    except ValueError:
        raise invalid("a tweak is up to 16 bytes in hexadecimal") from None


def _fpe(c: Column, kind: T.DataType, args: dict) -> Column:
    raw, tweak, alphabet = secret(args["keyRef"]), bytes.fromhex(args.get("tweak") or ""), _alphabet(args)
    key = raw.encode()
    if len(key) not in (16, 24, 32):
        try:
            key = bytes.fromhex(raw)
        except ValueError:
            key = b""
    if len(key) not in (16, 24, 32):
        raise GovernError("ERR_CONFIG_INVALID", "the fpe key has 16, 24 or 32 bytes")

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return fpe.encrypted(values, key, tweak, alphabet)

    return run(_text(c))


WORDS = {
    "first_name": "Ada Ben Cleo Dario Elin Farid Greta Hugo Ines Jonas Kaya Liam Mina Noor Oskar Pia Quentin Rosa Samir Tilda Uma Viktor Wanda Yara".split(),
    "last_name": "Abel Brandt Cordova Dalgaard Eriksen Fontaine Garcia Hartmann Ito Jansen Kowalski Lindqvist Moreau Novak Okafor Petrov Quist Rossi Silva Tanaka Ulrich Vega Weber Zhang".split(),
    "company": ["Amber Works", "Blue Harbor", "Cedar Line", "Delta Forge", "Evergreen Labs", "Fairwind", "Granite House", "Highmoor", "Iron Gate", "Juniper Co", "Kestrel", "Lakeside Foods"],
    "city": ["Aarhus", "Bilbao", "Coimbra", "Dresden", "Espoo", "Florence", "Ghent", "Haifa", "Izmir", "Jena", "Kyoto", "Leeds", "Malmo", "Nantes", "Oulu", "Porto"],
    "country": ["Argentina", "Belgium", "Canada", "Denmark", "Estonia", "Finland", "Ghana", "Hungary", "Iceland", "Japan", "Kenya", "Latvia"],
}
FAKES = ("name", "first_name", "last_name", "email", "phone", "company", "city", "country", "uuid")


def _fake_ok(args: dict) -> None:
    if args.get("fakeType") not in FAKES:
        raise invalid(f"fakeType is one of {', '.join(FAKES)}")


def _fake(c: Column, kind: T.DataType, args: dict) -> Column:
    what, t = args["fakeType"], _text(c)
    h = hmac_hex(secret(args.get("seed")).encode(), F.concat(F.lit(what.encode() + b"\0"), t.cast("binary")))
    n = first_number(h)
    shifted = lambda bits: F.floor(n / F.lit(2**bits).cast("decimal(20,0)")).cast("decimal(20,0)")

    def pick(name: str, x: Column) -> Column:
        words = WORDS[name]
        return F.element_at(F.array(*map(F.lit, words)), (x % len(words)).cast("int") + 1)

    if what in WORDS:
        out = pick(what, n)
    elif what == "name":
        out = F.concat_ws(" ", pick("first_name", n), pick("last_name", shifted(16)))
    elif what == "email":
        out = F.concat(F.lower(pick("first_name", n)), F.lit("."), F.lower(pick("last_name", shifted(16))), (shifted(32) % 1000).cast("int").cast("string"), F.lit("@example.com"))
    elif what == "phone":
        out = F.concat(F.lit("+1-555-"), F.lpad((n % 1000).cast("int").cast("string"), 3, "0"), F.lit("-"), F.lpad((shifted(10) % 10000).cast("int").cast("string"), 4, "0"))
    else:
        variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4) + 1)
        part = lambda a, k: F.substr(h, F.lit(a), F.lit(k))
        out = F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(out)


def default_registry() -> MaskRegistry:
    r = MaskRegistry()
    always = lambda args: True
    r.register("null", Provider(_null))
    r.register("constant", Provider(lambda c, kind, args: F.lit(args["value"]), _constant_ok))
    r.register("partial", Provider(_partial, _partial_ok))
    r.register("hash", Provider(_hash, _hash_ok, lambda args: args.get("algorithm") == "hmac_sha256"))
    r.register("regex", Provider(_regex, _regex_ok))
    r.register("truncate", Provider(_truncate, _truncate_ok))
    r.register("jitter", Provider(_jitter, _jitter_ok, always, numeric=True))
    r.register("fpe", Provider(_fpe, _fpe_ok, always))
    r.register("fake", Provider(_fake, _fake_ok, always))
    return r
