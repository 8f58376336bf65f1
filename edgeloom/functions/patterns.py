"""Patterns on identifiers: globs, anchored regular expressions and literals as Columns.

Glob rules: ``*`` and ``?`` stay within a segment, ``**`` crosses segments, ``/**`` at
the end also matches the folder itself, ``**/`` and ``/**/`` also match no folder;
``[abc]``, ``[a-z]`` and ``[!..]`` are classes.  There is no escape character.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from edgeloom.errors import UserError
from edgeloom.functions import identifiers as ids

_SPECIAL = set("\\.+*?()|[]{}^$#&-~")

#: One token of a glob; the longest wildcards come first.
_TOKEN = re.compile(r"(?P<inside>/\*\*\Z)|(?P<wild>/\*\*/|\*\*/?|[*?])|\[(?P<not>!?)(?P<set>[^]]*)(?P<close>\]?)|(?P<plain>.)", re.DOTALL)
#: What a wildcard stands for (fixed values).
_WILD = {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}

_ESCAPE = re.compile(r"\\(?:[pPx]\{[^}]*\}|.)", re.DOTALL)
_CLASS = r"\[\^?\]?[^]]*\]"
#: What java.util.regex accepts but a linear-time engine does not, in a pattern without escapes and classes.
_NOT_LINEAR = re.compile(r"\\|\(\?(?:=|!|<=|<!|>)|(?:[*+?]|\{\d+(?:,\d*)?\})\+")
_GROUP = re.compile(rf"\\.|{_CLASS}|\((?:\?P?<(?P<name>[A-Za-z_]\w*)>|(?!\?))", re.DOTALL)


def _literally(text: str) -> str:
    return "".join(f"\\{c}" if c in _SPECIAL else c for c in text)


def glob_to_regex(glob: str) -> str:
    text = re.sub("/+", "/", glob.replace("\\", "/"))
    if not text.strip():
        raise UserError("a glob must not be empty")

    def fragment(token: re.Match) -> str:
        if token["inside"]:
            return "(?:/.*)?"
        if token["wild"]:
            return _WILD[token["wild"]]
        if token["plain"]:
            return _literally(token["plain"])
        if not token["set"] or not token["close"]:
            raise UserError(f"glob {glob!r} has an empty or unclosed class")
        members = re.sub(r"[\\\[^&~]", r"\\\g<0>", token["set"])
        return f"[{'^' if token['not'] else ''}{members}]"

    return _TOKEN.sub(fragment, text.rstrip("/") or "/")


def group_names(regex: str) -> list[str | None]:
    """The names of the capture groups, in order; None for those without."""
    return [m["name"] for m in _GROUP.finditer(regex) if m[0].startswith("(")]


def checked_regex(regex: str) -> str:
    """The pattern in Java's dialect, groups without names; what only a backtracking engine can do is refused."""
    if not regex.strip():
        raise UserError("a pattern must not be empty")
    bare = _ESCAPE.sub(lambda m: "\\" if m[0][1] in "123456789k" else "x", regex)
    if _NOT_LINEAR.search(re.sub(_CLASS, "c", bare)):
        raise UserError(f"pattern {regex!r} uses lookaround, a back reference or a possessive quantifier")
    java = _GROUP.sub(lambda m: "(" if m["name"] else m[0], regex)
    session = SparkSession.getActiveSession()
    try:
        if session is not None:
            session._jvm.java.util.regex.Pattern.compile(java)
        else:  # as far as the two engines agree
            re.compile(re.sub(r"\\[pP]\{[^}]*\}", "x", java).replace(r"\z", r"\Z"))
    except (re.error, PySparkException, Py4JJavaError) as e:
        raise UserError(f"pattern {regex!r} can't be compiled: {str(e).splitlines()[0]}") from e
    return java


@dataclass(frozen=True)
class Pattern:
    """``body`` is an unanchored Java regular expression; a match covers the whole candidate."""

    body: str
    case_insensitive: bool = False
    names: tuple[str | None, ...] = ()

    @classmethod
    def glob(cls, text: str, case_insensitive: bool = False) -> Pattern:
        return cls(glob_to_regex(text), case_insensitive)

    @classmethod
    def regex(cls, text: str, case_insensitive: bool = False) -> Pattern:
        return cls(checked_regex(text), case_insensitive, tuple(group_names(text)))

    @classmethod
    def literal(cls, text: str, case_insensitive: bool = False) -> Pattern:
        flat = re.sub("/+", "/", text.replace("\\", "/"))
        if not flat.strip():
            raise UserError("a literal must not be empty")
        return cls(_literally(flat), case_insensitive)

    @property
    def java(self) -> str:
        return ("(?iu)" if self.case_insensitive else "") + rf"\A(?:{self.body})\z"

    def matches(self, candidate: Column) -> Column:
        return candidate.rlike(self.java)

    def replaced(self, candidate: Column, replacement: str) -> Column:
        """The replacement of a match of the whole candidate: ``$1``, ``${1}``, ``$name``, ``${name}`` are captures
        (empty where there is no such group), ``$$`` is a dollar sign."""
        parts, at = [], 0
        for m in re.finditer(r"\$(?:\$|\{(?P<braced>\w+)\}|(?P<word>\w+))", replacement):
            name = m["braced"] or m["word"]
            group = int(name) if name and name.isdecimal() else self.names.index(name) + 1 if name in self.names else None
            parts.append(F.lit(replacement[at : m.start()]))
            if name is None:
                parts.append(F.lit("$"))
            elif group is not None and group <= len(self.names):
                parts.append(F.regexp_extract(candidate, self.java, group))
            at = m.end()
        return F.concat(*parts, F.lit(replacement[at:]))


TARGETS: dict[str, Callable[[Column], Column]] = {"filename": ids.filename, "path": ids.normalize_candidate, "folder": ids.folder, "type": ids.type_name}


@dataclass(frozen=True)
class Filter:
    """A pattern on a part of the identifier, perhaps inverted, minus exclusions.

    An empty identifier never matches, also not an inverted filter.
    """

    pattern: Pattern
    target: str = "path"
    inverted: bool = False
    exclusions: tuple[Filter, ...] = ()

    def not_matching(self) -> Filter:
        return replace(self, inverted=not self.inverted)

    def column(self, identifier: Column | str) -> Column:
        identifier = F.col(identifier) if isinstance(identifier, str) else identifier
        hit = self.pattern.matches(TARGETS[self.target](identifier))
        hit = ~hit if self.inverted else hit
        for exclusion in self.exclusions:
            hit = hit & ~exclusion.column(identifier)
        return F.coalesce((F.trim(identifier) != "") & hit, F.lit(False))


def all_of(filters: list[Filter], identifier: Column | str) -> Column:
    return reduce(lambda a, b: a & b, (f.column(identifier) for f in filters), F.lit(True))


def any_of(filters: list[Filter], identifier: Column | str) -> Column:
    return reduce(lambda a, b: a | b, (f.column(identifier) for f in filters), F.lit(False))


@dataclass(frozen=True)
class PatternSpec:
    """A pattern's text, its syntax, and what is excepted from it."""

    text: str
    syntax: str = "glob"
    case_insensitive: bool = False
    exceptions: tuple[tuple[str | None, str], ...] = field(default=())

    def _with(self, target: str | None, *texts: str) -> PatternSpec:
        return replace(self, exceptions=(*self.exceptions, *((target, t) for t in texts)))

    def except_(self, text: str) -> PatternSpec:
        return self._with(None, text)

    def except_all(self, *texts: str) -> PatternSpec:
        return self._with(None, *texts)

    def except_in_path(self, text: str) -> PatternSpec:
        return self._with("path", text)

    def except_in_folder(self, text: str) -> PatternSpec:
        return self._with("folder", text)

    def except_with_name(self, text: str) -> PatternSpec:
        return self._with("filename", text)

    def except_for_types_matching(self, text: str) -> PatternSpec:
        return self._with("type", text)

    def compile(self, text: str | None = None) -> Pattern:
        make = {"glob": Pattern.glob, "regex": Pattern.regex, "literal": Pattern.literal}[self.syntax]
        return make(self.text if text is None else text, self.case_insensitive)

    def filter(self, target: str) -> Filter:
        """Exclusions take the parent's target unless they name one, and its syntax."""
        return Filter(self.compile(), target, False, tuple(Filter(self.compile(t), kind or target) for kind, t in self.exceptions))


def pattern(text: str, syntax: str = "glob", case_insensitive: bool = False) -> PatternSpec:
    return PatternSpec(text, syntax, case_insensitive)


def _spec(spec: str | PatternSpec) -> PatternSpec:
    return spec if isinstance(spec, PatternSpec) else PatternSpec(spec)


def with_name(spec: str | PatternSpec) -> Filter:
    return _spec(spec).filter("filename")


def in_folder(spec: str | PatternSpec) -> Filter:
    return _spec(spec).filter("folder")


def in_path(spec: str | PatternSpec) -> Filter:
    return _spec(spec).filter("path")


def types_matching(spec: str | PatternSpec) -> Filter:
    return _spec(spec).filter("type")


def in_file(path: str) -> Filter:
    return PatternSpec(path, "literal").filter("path")
