"""Settings: built-in values, then ``key=value`` files, then the environment, each over the one before."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

PREFIX = "LODESTONE_"
TRUE = frozenset(("true", "1", "yes"))


@dataclass(frozen=True)
class Settings:
    store_path: str = "lodestone-store"
    chunk_size: int = 1024
    batch_size: int = 32
    results: int = 5
    exclude_tests: bool = False
    additional_ignored: tuple[str, ...] = ()
    rerank_multiplier: int = 2
    debounce_minutes: int = 10
    verify_with_hash: bool = True


def read_file(path: str) -> dict[str, str]:
    """Keys and values of a file's lines; blank lines and comments are passed over, a missing file is empty."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        lines = [line.strip() for line in f]
    return {k.strip().lower(): v.strip().strip("\"'") for k, _, v in (line.partition("=") for line in lines if "=" in line and not line.startswith("#"))}


def write_file(path: str, settings: Settings) -> None:
    with open(path, "w", encoding="utf-8") as f:
        for field in fields(settings):
            value = getattr(settings, field.name)
            f.write(f"{field.name}={','.join(value) if isinstance(value, tuple) else value}\n")


def load(files=(), env: Mapping[str, str] | None = None) -> Settings:
    """The first of ``files`` that exists counts, the environment over it. A value that is no number, where one
    is wanted, is passed over; sizes are one at least."""
    env = os.environ if env is None else env
    found = next((read_file(p) for p in files if os.path.exists(p)), {})
    found |= {k[len(PREFIX) :].lower(): v for k, v in env.items() if k.startswith(PREFIX)}
    given: dict = {}
    for field in fields(Settings):
        raw, default = found.get(field.name), field.default
        if raw is None:
            continue
        if isinstance(default, bool):
            given[field.name] = raw.lower() in TRUE
        elif isinstance(default, int):
            if raw.lstrip("-").isdigit():
                given[field.name] = int(raw) if field.name == "debounce_minutes" else max(1, int(raw))
        elif isinstance(default, tuple):
            given[field.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
        else:
            given[field.name] = raw
    return replace(Settings(), **given)
