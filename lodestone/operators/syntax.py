"""Blocks and definitions of brace languages, in one pass over the text.

A lexer that knows each language's strings, characters, comments, raw strings, templates, regular expressions, lifetimes and
preprocessor lines hands on words and brackets. Brackets nest; at every opening brace the words since the last statement
ended say what it opens. Each token is looked at a fixed number of times, so the time is in proportion to the text.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

_LINE, _BLOCK = r"//[^\n]*", r"/\*(?s:.*?)(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\(?s:.))*"', r"'(?:[^'\\\n]|\\(?s:.))*'"
_CHAR = r"'(?:[^'\\\n]|\\(?:u\{[^}\n]*\}|[^\n])[0-9a-fA-F]*)'"
_PREPROCESSOR = r"(?m:^)[ \t]*\#(?:[^\n\\]|\\(?s:.))*"
#: What is skipped in each language, first things first; ``skip`` counts as nothing, ``value`` as a value.
_SKIP = {
    "javascript": (f"{_LINE}|{_BLOCK}", f"{_DOUBLE}|{_SINGLE}"),
    "go": (f"{_LINE}|{_BLOCK}", f"{_DOUBLE}|{_SINGLE}|`[^`]*(?:`|\\Z)"),
    "rust": (f"{_LINE}|{_BLOCK}", rf'b?r(?P<fence>\#*)"(?s:.*?)(?:"(?P=fence)|\Z)|b?"(?:[^"\\]|\\(?s:.))*"|b?{_CHAR}|\'\w+'),
    "java": (f"{_LINE}|{_BLOCK}", rf'"""(?s:(?:[^\\]|\\.)*?)(?:"""|\Z)|{_DOUBLE}|{_SINGLE}'),
    "c": (f"{_LINE}|{_BLOCK}|{_PREPROCESSOR}", f"{_DOUBLE}|{_SINGLE}"),
    "cpp": (f"{_LINE}|{_BLOCK}|{_PREPROCESSOR}", rf'(?:u8|[uUL])?R"(?P<fence>[^()\\\s]{{0,16}})\((?s:.*?)(?:\)(?P=fence)"|\Z)|{_DOUBLE}|{_SINGLE}'),
    "c_sharp": (f"{_LINE}|{_BLOCK}|{_PREPROCESSOR}", rf'"""(?s:.*?)(?:"""|\Z)|\$?@\$?"(?:[^"]|"")*"|\$?{_DOUBLE}|{_SINGLE}'),
    "php": (rf"{_LINE}|{_BLOCK}|\#(?!\[)[^\n]*", rf"<<<['\"]?(?P<fence>\w+)['\"]?\n(?s:.*?)(?:\n\s*(?P=fence)\b|\Z)|" + r'"(?:[^"\\]|\\(?s:.))*"' + r"|'(?:[^'\\]|\\(?s:.))*'"),
}
_SKIP |= dict.fromkeys(("typescript", "tsx"), _SKIP["javascript"])
LANGUAGES = frozenset(_SKIP)
_SCRIPTS = frozenset(("javascript", "typescript", "tsx"))
_REST = r"(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<line>\n)|(?P<mark>=>|::|->|[^\s\w])"
_TOKENS = {name: re.compile(f"(?P<skip>{skip})|(?P<value>{value}|\\d(?:[\\w.]|'\\w)*)|{_REST}") for name, (skip, value) in _SKIP.items()}
_REGEX = re.compile(r"/(?![/*])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/\w*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))*(?:`|\$\{|\Z)")

# Words of the languages.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
CLASSES = frozenset("class interface struct enum trait impl union record".split())
_OPEN = frozenset("namespace extern mod module package".split())
_CONTROL = frozenset("if for foreach while switch catch return else do try new sizeof throw await match loop unsafe select case default synchronized using lock with go defer finally when fixed checked guard where".split())
_STARTS = frozenset("function class const let var export async interface type enum import abstract static if for while switch return try public private protected".split())
_NO_NAMES = frozenset("throw throws noexcept decltype alignas alignof __attribute__ __declspec requires where returns super this".split()) | _CONTROL
_BEFORE_CLASS = frozenset("new typename friend return . -> : ,".split())


@dataclass
class Node:
    """A definition: from its first word to behind its closing brace; ``head`` is behind its opening one."""

    start: int
    head: int
    end: int
    name: str
    kind: str  # function or class
    parent: int  # number of the definition round it, -1 if there is none
    depth: int


@dataclass
class _Frame:
    bracket: str
    start: int
    kind: str  # what the bracket holds: function, class, open (a namespace, or the file), object, other
    node: int = -1
    around: int = -1  # the innermost definition that it is or stands in
    head: list[tuple[str, str, int]] = field(default_factory=list)  # (kind, text, place) since the last statement


@dataclass
class Scan:
    """What one pass finds: definitions in order of their starts, and the ends of statements and blocks."""

    nodes: list[Node]
    blocks: list[tuple[int, int]]
    stops: list[tuple[int, int]]


_CLOSES = {")": "(", "]": "[", "}": "{"}


@functools.lru_cache(1)
def scan(text: str, language: str) -> Scan:
    """Blocks, statement ends and definitions of a text in one of ``LANGUAGES``; what is never closed is none."""
    token, script, go = _TOKENS[language], language in _SCRIPTS, language == "go"
    frames = [_Frame("", 0, "open")]
    nodes: list[Node] = []
    blocks: list[tuple[int, int]] = []
    stops: list[tuple[int, int]] = []
    open_at = {"(": 0, "[": 0, "{": 0, "${": 0}
    at, last, fresh = 0, ("", "", 0), False  # the last token, and whether a line began after it
    while m := token.search(text, at):
        at, kind, word, place = m.end(), m.lastgroup, m[0], m.start()
        if kind == "fence":
            kind = "value"
        frame = frames[-1]
        if kind == "skip":
            if word.lstrip().startswith("#") and language in ("c", "cpp", "c_sharp"):
                frame.head.clear()
            continue
        if kind == "line":
            fresh = True
            if go and frame.bracket in ("", "{") and (last[0] in ("word", "value") or last[1] in (")", "]", "}", "++", "--")):
                frame.head.clear()
            continue
        if script and word == "/" and (last[0] == "" or last[0] == "word" and last[1] in _BEFORE_REGEX or last[0] == "mark" and last[1] not in (")", "]", "}")) and (r := _REGEX.match(text, place)):
            kind, at = "value", r.end()
        if script and word == "`":
            at = _TEMPLATE.match(text, at).end()
            kind = "value"
            if text.endswith("${", 0, at) and at - 2 > place:
                frames.append(_Frame("${", place, "other", -1, frames[-1].around))
                open_at["${"] += 1
                last = ("mark", "{", place)
                continue
        if kind == "word" and script and fresh and word in _STARTS and last[0] != "" and last[1] not in ("=", "=>", "(", ",", "export", "default", "async", "static", "abstract", "public", "private", "protected"):
            frame.head.clear()
        fresh = False
        last = (kind, word, place)
        if kind != "mark":
            frame.head.append((kind, word, place))
        elif word in "([":
            frames.append(_Frame(word, place, "other", -1, frame.around))
            open_at[word] += 1
        elif word == "{":
            what, name, start = _classify(frame, language)
            number = -1
            if name:
                number = len(nodes)
                nodes.append(Node(start, at, -1, name, what, frame.around, 0))
            frames.append(_Frame("{", place, what, number, number if name else frame.around))
            open_at["{"] += 1
        elif word in ")]}":
            opener = _CLOSES[word]
            if word == "}" and frame.bracket == "${":
                frames.pop()
                open_at["${"] -= 1
                at = _TEMPLATE.match(text, at).end()
                if text.endswith("${", 0, at):
                    frames.append(_Frame("${", place, "other", -1, frames[-1].around))
                    open_at["${"] += 1
                else:
                    last = ("value", "`", place)
                    frames[-1].head.append(last)
                continue
            if not open_at[opener] or word != "}" and frame.bracket != opener:
                continue  # closes nothing
            while frames[-1].bracket != opener:  # what was left open in there
                open_at[frames.pop().bracket] -= 1
            done = frames.pop()
            open_at[opener] -= 1
            if word == "}":
                blocks.append((done.start, at))
                if done.node >= 0:
                    nodes[done.node].end = at
                frames[-1].head.clear()
                if frames[-1].bracket in ("(", "["):
                    frames[-1].head.append(("value", "{}", done.start))
            else:
                frames[-1].head.append(("group", opener + word, done.start))
        elif word == ";":
            stops.append((place, at))
            frame.head.clear()
        elif word == "," and (frame.bracket in ("(", "[") or frame.kind == "object"):
            frame.head.clear()
        else:
            frame.head.append((kind, word, place))
    return Scan(_closed(nodes), blocks, stops)


def _closed(nodes: list[Node]) -> list[Node]:
    """The definitions that end, by their starts, with parents and depths among them."""
    place: dict[int, int] = {-1: -1}
    out: list[Node] = []
    for k, n in enumerate(nodes):  # a parent was opened before its children
        while n.parent >= 0 and nodes[n.parent].end < 0:
            n.parent = nodes[n.parent].parent
        if n.end >= 0:
            place[k] = len(out)
            n.parent = place[n.parent]
            n.depth = out[n.parent].depth + 1 if n.parent >= 0 else 0
            out.append(n)
    return out


def _classify(frame: _Frame, language: str) -> tuple[str, str | None, int]:
    """(kind of what the brace opens, name, first place) by the words before it."""
    head = _without_template(frame.head)
    start = frame.head[0][2] if frame.head else 0
    if not head:
        return ("object" if language in _SCRIPTS and frame.bracket in ("(", "[") else "other"), None, start
    words = [t for _, t, _ in head]
    if language == "go" and "type" in words and words[-1] in ("struct", "interface"):
        k = words.index("type")
        return "class", words[k + 1] if head[k + 1][0] == "word" else None, start
    equals = next((k for k, w in enumerate(words) if w == "=" and (k == 0 or words[k - 1] != "operator")), len(words))
    if "operator" not in words:
        for k, w in enumerate(words):
            if w in CLASSES and head[k][0] == "word" and (k == 0 or words[k - 1] not in _BEFORE_CLASS):
                found = _class_name(head, words, k, language)
                if found is not None:
                    name = found or (_assigned(head, words, equals) if equals < k else None)
                    return "class", name, start
                break
    for key in ("function", "fn", "func"):
        if key in words:
            k = len(words) - 1 - words[::-1].index(key)
            if key == "func" and k + 1 < len(words) and words[k + 1] == "()" and k + 2 < len(words) and head[k + 2][0] == "word" and "()" in words[k + 3 :]:
                return "function", words[k + 2], start
            j = k + 1 + (words[k + 1 : k + 2] in (["*"], ["&"]))
            if j < len(words) and head[j][0] == "word":
                return "function", words[j], start
            sign = max((i for i in range(k) if words[i] in ("=", ":")), default=-1)
            return "function", _assigned(head, words, sign) if language in _SCRIPTS else None, start
    if words[-1] == "=>":
        k = max((i for i, w in enumerate(words) if w in ("=", ":")), default=-1) if "=" not in words else words.index("=")
        return "function", _assigned(head, words, k) if k > 0 else None, start
    first = next((w for k, w in enumerate(words) if head[k][0] == "word"), "")
    if first in _OPEN:
        return "open", None, start
    if "new" in words and words[-1] == "()" and language in ("java", "c_sharp"):
        return "class", None, start
    if frame.kind in ("open", "class", "object") and first not in _CONTROL and words[0] not in (".", "?"):
        name = _method(head, words, min(equals, len(words)) if "operator" not in words else len(words))
        if name:
            return "function", name, start
    if language in _SCRIPTS and (words[-1] in ("=", ":", "return", "default", "?", "(", "&&", "||") or frame.bracket in ("(", "[")):
        return "object", None, start
    return "other", None, start


def _without_template(head: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """The head without ``template <...>``, ``impl``'s parameters and labels before it."""
    out, k = [], 0
    while k < len(head):
        _, t, _ = head[k]
        if t in ("template", "impl") and k + 1 < len(head) and head[k + 1][1] == "<":
            if t == "impl":
                out.append(head[k])
            depth, k = 0, k + 1
            while k < len(head):
                depth += {"<": 1, ">": -1}.get(head[k][1], 0)
                k += 1
                if depth == 0:
                    break
            continue
        if t == "@" and k + 1 < len(head) and head[k + 1][0] == "word" and head[k + 1][1] != "interface":
            k += 2
            while k + 1 < len(head) and head[k][1] == ".":
                k += 2
            k += k < len(head) and head[k][1] == "()"
            continue
        if t == "#" and k + 1 < len(head) and head[k + 1][1] == "[]":
            k += 2
            continue
        if t == ":" and len(out) == 1 and out[0][1] in ("public", "private", "protected", "default"):
            out.clear()
            k += 1
            continue
        out.append(head[k])
        k += 1
    return out


def _class_name(head, words: list[str], k: int, language: str) -> str | None:
    """The name of the class whose keyword is at ``k``, empty if it has none; None if this is no class."""
    j = k + 1
    while j < len(words) and (words[j] in CLASSES or words[j] in ("[]", "final", "sealed") and language in ("cpp", "c")):
        j += 1
    if j >= len(words) or head[j][0] != "word" or words[j] in ("extends", "implements"):
        return "" if j >= len(words) or words[j] in ("extends", "implements") else None
    after = words[j + 1 :]
    if words[k] != "record" and language in ("c", "cpp") and "()" in after and ":" not in after[: after.index("()")]:
        return None  # a function that returns one
    if "=" in words and language not in _SCRIPTS or "=" in after[:1]:
        return None
    if language in ("c", "cpp") and "::" in after[:1]:
        j += 2 * sum(1 for i in range(0, len(after) - 1, 2) if after[i] == "::" and all(x == "::" for x in after[0:i:2]))
    return words[j]


def _assigned(head, words: list[str], k: int) -> str | None:
    """What stands before the sign at ``k`` and gets the value: a variable, a field, or a key."""
    if 0 < k < len(words) and words[k] == "=" and ":" in words[:k] and "?" not in words[:k]:
        k = words.index(":")  # a declared type stands between
    return words[k - 1] if 0 < k < len(words) and words[k] in ("=", ":") and head[k - 1][0] == "word" else None


def _method(head, words: list[str], stop: int) -> str | None:
    """The name before the first list of parameters."""
    for k in range(1, stop):
        if words[k] != "()":
            continue
        if "operator" in words[:k]:
            at = words.index("operator")
            end = k + (k + 1 < len(words) and words[k + 1] == "()" and k == at + 1)
            return "".join(words[at:end])
        j = k - 1
        if words[j] == ">":
            depth = 0
            while j >= 0:
                depth += {">": 1, "<": -1}.get(words[j], 0)
                j -= 1
                if depth == 0:
                    break
        if j >= 0 and head[j][0] == "word" and words[j] not in _NO_NAMES:
            return ("~" if j and words[j - 1] == "~" else "") + words[j].lstrip("$")
    return None
