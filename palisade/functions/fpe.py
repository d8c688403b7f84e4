"""Format-preserving encryption: FF1 of NIST SP 800-38G over AES, for all values of one length at once."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd


def _tables() -> tuple[bytes, list[int]]:
    """The AES substitution box and round constants, by their definition over GF(2^8)."""
    def times(a: int, b: int) -> int:
        out = 0
        while b:
            out ^= a * (b & 1)
            a, b = (a << 1) ^ (0x11B if a & 0x80 else 0), b >> 1
        return out

    box = bytearray(256)
    for x in range(256):
        inv = next((y for y in range(256) if times(x, y) == 1), 0)
        box[x] = 0x63
        for k in range(5):
            box[x] ^= (inv << k | inv >> (8 - k)) & 0xFF
    rcon = [1]
    while len(rcon) < 14:
        rcon.append(times(rcon[-1], 2))
    return bytes(box), rcon


BOX, RCON = _tables()
DOUBLE = bytes((x << 1) ^ (0x11B if x & 0x80 else 0) for x in range(256))


_BOX, _DOUBLE = np.frombuffer(BOX, np.uint8), np.frombuffer(DOUBLE, np.uint8)
_SHIFT = [(i + 4 * (i % 4)) % 16 for i in range(16)]


class Aes:
    """Encryption of many blocks at once."""

    def __init__(self, key: bytes):
        if len(key) not in (16, 24, 32):
            raise ValueError("an AES key has 16, 24 or 32 bytes")
        n = len(key) // 4
        words = [key[4 * i : 4 * i + 4] for i in range(n)]
        self.rounds = n + 6
        for i in range(n, 4 * (self.rounds + 1)):
            w = words[-1]
            if i % n == 0:
                w = bytes(BOX[b] for b in w[1:] + w[:1])
                w = bytes([w[0] ^ RCON[i // n - 1]]) + w[1:]
            elif n > 6 and i % n == 4:
                w = bytes(BOX[b] for b in w)
            words.append(bytes(a ^ b for a, b in zip(words[i - n], w, strict=True)))
        self.keys = [b"".join(words[4 * r : 4 * r + 4]) for r in range(self.rounds + 1)]

    def blocks(self, data: np.ndarray) -> np.ndarray:
        """(blocks, 16) bytes, each encrypted."""
        keys = [np.frombuffer(k, np.uint8) for k in self.keys]
        s = data ^ keys[0]
        for r in range(1, self.rounds + 1):
            s = _BOX[s][:, _SHIFT]
            if r < self.rounds:
                a = s.reshape(-1, 4, 4)
                b = np.roll(a, -1, axis=2)
                s = (_DOUBLE[a ^ b] ^ b ^ np.roll(a, -2, axis=2) ^ np.roll(a, -3, axis=2)).reshape(-1, 16)
            s = s ^ keys[r]
        return s


#: Named alphabets.
ALPHABETS = {"numeric": "0123456789", "lower": "abcdefghijklmnopqrstuvwxyz", "alphanumeric": "0123456789abcdefghijklmnopqrstuvwxyz"}


class Ff1:
    def __init__(self, key: bytes, tweak: bytes = b"", radix: int = 10):
        self.aes, self.tweak, self.radix = Aes(key), tweak, radix
        self.least = 2
        while radix**self.least < 1_000_000:
            self.least += 1

    def _number(self, x: list[int]) -> int:
        out = 0
        for d in x:
            out = out * self.radix + d
        return out

    def _digits(self, n: int, size: int) -> list[int]:
        out = []
        for _ in range(size):
            n, d = divmod(n, self.radix)
            out.append(d)
        return out[::-1]

    def run(self, xs: list[list[int]], decrypt: bool = False) -> list[list[int]]:
        """Sequences of digits, all of one length; halves are numbers until the end."""
        n, t = len(xs[0]), len(self.tweak)
        if n < self.least:
            raise ValueError(f"format-preserving encryption needs {self.least} characters of the alphabet")
        u, v = n // 2, n - n // 2
        a, b = [self._number(x[:u]) for x in xs], [self._number(x[u:]) for x in xs]
        size = -(-((self.radix**v - 1).bit_length()) // 8)
        d = 4 * -(-size // 4) + 4
        p = bytes([1, 2, 1]) + self.radix.to_bytes(3) + bytes([10, u % 256]) + n.to_bytes(4) + t.to_bytes(4)
        begun = self.aes.blocks(np.frombuffer(p, np.uint8)[None])
        for i in range(9, -1, -1) if decrypt else range(10):
            head = self.tweak + bytes((-t - size - 1) % 16) + bytes([i])
            q = np.frombuffer(b"".join(head + x.to_bytes(size) for x in (a if decrypt else b)), np.uint8).reshape(len(xs), -1)
            r = begun
            for k in range(0, q.shape[1], 16):
                r = self.aes.blocks(r ^ q[:, k : k + 16])
            more = [self.aes.blocks(r ^ np.frombuffer(j.to_bytes(16), np.uint8)) for j in range(1, -(-d // 16))]
            raw = np.ascontiguousarray(np.concatenate([r, *more], axis=1)[:, :d]).tobytes()
            y = [int.from_bytes(raw[k : k + d]) for k in range(0, len(raw), d)]
            top = self.radix ** (u if i % 2 == 0 else v)
            if decrypt:
                a, b = [(z - w) % top for z, w in zip(b, y, strict=True)], a
            else:
                a, b = b, [(z + w) % top for z, w in zip(a, y, strict=True)]
        return [self._digits(x, u) + self._digits(z, v) for x, z in zip(a, b, strict=True)]

    def texts(self, values: list[str], alphabet: str, decrypt: bool = False) -> list[str]:
        """Characters of the alphabet are encrypted among themselves; all others keep their places."""
        at = {c: i for i, c in enumerate(alphabet)}
        inside = [[at[c] for c in v if c in at] for v in values]
        by_size: dict[int, list[int]] = {}
        for k, x in enumerate(inside):
            by_size.setdefault(len(x), []).append(k)
        out = list(values)
        for size, ks in by_size.items():
            if size:
                for k, digits in zip(ks, self.run([inside[k] for k in ks], decrypt), strict=True):
                    new = iter(digits)
                    out[k] = "".join(alphabet[next(new)] if c in at else c for c in values[k])
        return out

    def text(self, value: str, alphabet: str, decrypt: bool = False) -> str:
        return self.texts([value], alphabet, decrypt)[0]


def encrypted(values: pd.Series, key: bytes, tweak: bytes, alphabet: str, decrypt: bool = False) -> pd.Series:
    """Each distinct value is encrypted once."""
    f = Ff1(key, tweak, len(alphabet))
    kinds = list(_distinct(values))
    known: dict[str, str] = dict(zip(kinds, f.texts(kinds, alphabet, decrypt), strict=True))
    return values.map(known, na_action="ignore").astype(object).where(values.notna(), None)


def _distinct(values: pd.Series) -> Iterable[str]:
    return values.dropna().unique()
