"""What a commit to a collection is: states, conflicts, and putting the next state in place.

A state says which folders hold each bucket. A writer starts from one state and proposes the next. If another writer was
faster, its state is looked at: as long as it changed none of the buckets that the proposal read or replaced, the proposal is
moved on top of it; else it is a ``Conflict``. These functions know no file system, so Spark's driver and the writers
of the data source share them.
"""

from __future__ import annotations

import uuid

STATE = "state-"


class Conflict(RuntimeError):
    """Another writer has changed what this one read or replaces."""


def state_file(version: int) -> str:
    return f"{STATE}{version:012d}.json"


def is_state(name: str) -> bool:
    return name.startswith(STATE) and name.endswith(".json")


def fresh_folder(version: int) -> str:
    """A folder name that no other writer takes."""
    return f"{version}-{uuid.uuid4().hex[:12]}"


def folders(held: object) -> list[str]:
    """The folders of a bucket: the one that was written as a whole, and those added to it since."""
    return [str(v) for v in held] if isinstance(held, list) else [str(held)]


def proposed(base: dict, newest: dict, touched: set[str], made: dict[str, object], added: bool = False) -> dict:
    """The state after ``newest`` in which the touched buckets are as ``made`` says (none: empty).

    ``base`` is the state that was read. With ``added`` the folders come to what the buckets hold, which conflicts with nothing
    but another schema or another number of buckets.
    """
    for what in ("schema", "n_buckets", "key", "dimension", "model_name"):
        if base[what] != newest[what]:
            raise Conflict(f"another writer has changed the {what}")
    if added:
        own = {b: [*(folders(newest["buckets"][b]) if b in newest["buckets"] else []), *folders(v)] for b, v in made.items()}
        return newest | {"version": newest["version"] + 1, "buckets": newest["buckets"] | own}
    changed = {b for b in touched if base["buckets"].get(b) != newest["buckets"].get(b)}
    if changed:
        raise Conflict(f"another writer has changed the buckets {', '.join(sorted(changed, key=int))}")
    kept = {b: v for b, v in newest["buckets"].items() if b not in touched}
    return newest | {"version": newest["version"] + 1, "buckets": kept | made}
