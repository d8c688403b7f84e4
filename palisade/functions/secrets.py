"""``secret://env/NAME`` and ``secret://file/path`` references."""

from __future__ import annotations

import os
from pathlib import Path

from palisade.model import GovernError


def is_reference(text: str) -> bool:
    return text.startswith("secret://")


def resolve(reference: str) -> str:
    kind, _, rest = reference.removeprefix("secret://").partition("/")
    if is_reference(reference) and rest:
        if kind == "env" and rest in os.environ:
            return os.environ[rest]
        if kind == "file" and (p := Path("/" + rest.lstrip("/"))).is_file():
            return p.read_text().rstrip("\r\n")
    raise GovernError("ERR_CONFIG_INVALID", "a secret reference cannot be resolved")
