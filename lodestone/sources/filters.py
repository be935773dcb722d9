"""Which paths are indexed: ignore patterns, test files, source suffixes; and the filters of a search."""

from __future__ import annotations

import fnmatch
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# These lists decide which files belong to an index (the library's own folder stands among the ignored).
SOURCE_SUFFIXES = (
    ".py .js .ts .jsx .tsx .java .c .cpp .h .hpp .cs .go .rs .rb .php .swift .kt .scala .clj .lua .r .m .mm .pl .pm .sh .bash .zsh "
    ".html .htm .css .scss .sass .less .vue .svelte .json .yaml .yml .toml .xml .ini .cfg .conf .md .rst .txt "
    ".dockerfile .makefile .gradle .cmake"
).split()
SOURCE_NAMES = ("makefile", "dockerfile", "vagrantfile", "gemfile", "rakefile")
IGNORED = (
    "node_modules .git __pycache__ .venv venv .egg-info dist build .lodestone .idea .vscode *.pyc *.pyo *.egg *.whl .DS_Store Thumbs.db "
    "package-lock.json yarn.lock pnpm-lock.yaml poetry.lock Pipfile.lock Cargo.lock go.sum Gemfile.lock *.min.js *.min.css *.map *.log"
).split()
TEST_FILES = (
    "test_*.py *_test.py *_test.go *_test.js *_test.ts *.spec.js *.spec.ts *.test.js *.test.ts *.test.jsx *.test.tsx "
    "Test*.java *Test.java *Tests.java *_test.rb test_*.rb *_spec.rb"
).split()
TEST_FOLDERS = ("test", "tests", "testing", "__tests__", "spec", "specs")
CODEBASE_MARKERS = ("setup.py", "pyproject.toml", "requirements.txt", "Pipfile", "package.json", "package-lock.json", "yarn.lock", "Cargo.toml", "go.mod", ".git", "src")


def glob_regex(patterns) -> str:
    """One regular expression for any of some shell patterns over a whole string; ``*`` also crosses ``/``."""
    # fnmatch writes Python's end-of-text mark, which Java spells otherwise.
    return "|".join(f"(?:{fnmatch.translate(p)})".replace(r"\Z", r"\z") for p in patterns)


def _any(path: Column, patterns, whole: bool = True) -> Column:
    if not patterns:
        return F.lit(False)
    regex = rf"^(?:{glob_regex(patterns)})"
    parts = F.exists(F.split(path, "/"), lambda p: p.rlike(regex))
    return parts | path.rlike(regex) if whole else parts


def ignored(path: Column, gitignore=(), additional=()) -> Column:
    """Whether a relative path matches a default, additional or gitignore pattern.

    A pattern holds for any part of the path or the whole of it; a gitignore pattern that ends in ``/`` only
    for parts. There is no negation or anchoring.
    """
    lines = [g.strip() for g in gitignore]
    lines = [g for g in lines if g and not g.startswith("#")]
    return (_any(path, [*IGNORED, *additional]) | _any(path, [g for g in lines if not g.endswith("/")])
            | _any(path, [g[:-1] for g in lines if g.endswith("/")], whole=False))


def is_test_file(path: Column) -> Column:
    """By file name, or by any folder of the path."""
    name = F.substring_index(path, "/", -1)
    folders = F.transform(F.split(path, "/"), F.lower)
    return name.rlike(rf"^(?:{glob_regex(TEST_FILES)})") | F.arrays_overlap(folders, F.array(*map(F.lit, TEST_FOLDERS)))


def is_source_file(path: Column) -> Column:
    """By lower-case suffix, where a leading dot makes none, or by a special name."""
    name = F.lower(F.substring_index(path, "/", -1))
    return F.regexp_extract(name, r".(\.[^.]+)$", 1).isin(*SOURCE_SUFFIXES) | name.isin(*SOURCE_NAMES)


def of_types(path: Column, suffixes) -> Column:
    """Whether the path ends in one of some suffixes, in any case; no suffixes: every path."""
    return reduce(or_, (F.lower(path).endswith(s.lower()) for s in suffixes)) if suffixes else F.lit(True)


def in_paths(path: Column, parts) -> Column:
    """Whether the path has one of some strings in it; none given: every path."""
    return reduce(or_, (path.contains(p) for p in parts)) if parts else F.lit(True)
