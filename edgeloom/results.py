"""Results of checks as text for people: findings with a heading each, colours, expectations.

``Rule.findings()`` gives single violations, ``Rule.result(options)`` the whole message.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Mapping
from dataclasses import dataclass

from edgeloom.errors import TechnicalError, UserError

#: Codes of terminals (fixed values).
STYLES = {"bold": "1", "dim": "2", "red": "31", "green": "32", "yellow": "33", "blue": "34", "cyan": "36", "red bold": "1;31", "green bold": "1;32"}


@dataclass(frozen=True)
class Result:
    passed: bool
    message: str


@dataclass(frozen=True)
class ResultOptions:
    """``color`` is auto (a terminal that can, not in CI), always or never; beyond ``limit`` the message says that there is more."""

    color: str = "auto"
    expect_violations: bool = False
    limit: int = 1000

    def __post_init__(self) -> None:
        if self.color not in {"auto", "always", "never"}:
            raise UserError(f"color is auto, always or never, not {self.color!r}")
        if self.limit < 1:
            raise UserError("the limit is at least 1")


@dataclass(frozen=True)
class Finding:
    """One violation: what kind it is, and what was found."""

    message: str
    details: str


def terminal_has_colors(terminal: bool | None = None, env: Mapping[str, str] | None = None) -> bool:
    """Whether ``auto`` means colours: a terminal that is not dumb, without NO_COLOR, outside of CI."""
    env = os.environ if env is None else env
    terminal = sys.stdout.isatty() if terminal is None else terminal
    return terminal and "NO_COLOR" not in env and env.get("TERM", "").lower() != "dumb" and env.get("CI", "").lower() != "true"


def styled(text: str, style: str, color: str = "auto") -> str:
    shown = color == "always" or (color == "auto" and terminal_has_colors())
    return f"\x1b[{STYLES[style]}m{text}\x1b[0m" if shown else text


def shaped(findings: list[Finding], options: ResultOptions | None = None) -> Result:
    """The result of a check that found ``findings``: one more than the limit are enough to tell that there is more."""
    options = options or ResultOptions()
    passed = bool(findings) == options.expect_violations
    say = lambda text, style: styled(text, style, options.color)
    if not findings:
        nothing = say("Expected architecture violations, but none were found.", "red bold") if options.expect_violations else say("No architecture violations found.", "green")
        return Result(passed, nothing)
    more = len(findings) > options.limit
    shown = findings[: options.limit]
    many = f"{'more than ' if more else ''}{len(shown)} architecture violation{'' if len(shown) == 1 and not more else 's'}"
    parts = [say(f"Found {many}, as expected:", "green bold") if options.expect_violations else say(f"Found {many}:", "red bold")]
    for i, one in enumerate(shown, 1):
        parts.append("\n".join([say(f"  {i}. {one.message}", "yellow"), *(f"     {line}" for line in one.details.splitlines())]))
    return Result(passed, "\n\n".join(parts))


def shaped_error(error: UserError | TechnicalError, options: ResultOptions | None = None) -> Result:
    """A check that reached no verdict fails, whatever was expected."""
    what = "Architecture rule is invalid" if isinstance(error, UserError) else "Architecture check could not run"
    return Result(False, styled(f"{what}: {error}", "red bold", (options or ResultOptions()).color))
