"""The dictionaries that classify commands and redact text, and their files."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

#: Commands of each class, matched at the start of a segment without regard to case.
COMMAND_CLASSES: dict[str, list[str]] = {
    "composite": [r"^preflight\b"],
    "test": [r"^(npx\s+)?vitest\b", r"^(npx\s+)?jest\b", r"^npm\s+(run\s+)?test\b", r"^pnpm\s+test\b", r"^yarn\s+test\b", r"^bun\s+(run\s+)?test\b", r"^bun\s+(run\s+)?vitest\b", r"^bunx\s+vitest\b", r"^bunx\s+jest\b", r"^pytest\b"],
    "lint": [r"^(npx\s+)?eslint\b", r"^biome\s+check\b", r"^npm\s+run\s+lint\b", r"^pnpm\s+lint\b", r"^bun\s+run\s+lint\b", r"^bunx\s+eslint\b"],
    "build": [r"^tsc\b.*--noEmit", r"^npm\s+run\s+build\b", r"^vite\s+build\b", r"^bun\s+run\s+build\b", r"^bun\s+run\s+typecheck\b", r"^bunx\s+tsc\b.*--noEmit"],
}

#: Fixed value: the default redaction dictionary.
REDACTIONS: list[tuple[str, str]] = [(r"\bJIRA-\d+\b", "TICKET-N")]


def load_command_classes(path: str | Path) -> dict[str, list[str]]:
    """A file like the default: lists of patterns for test, lint and build, and composite.patterns, which are tried first."""
    data = json.loads(Path(path).read_text("utf-8"))
    return {"composite": data["composite"]["patterns"]} | {k: data[k] for k in ("test", "lint", "build")}


def load_redactions(path: str | Path) -> list[tuple[str, str]]:
    """A file with a list of {pattern, replacement}; anything else is an error."""
    data = json.loads(Path(path).read_text("utf-8"))
    if not isinstance(data, list) or any(not isinstance(x, dict) or not isinstance(x.get("pattern"), str) or not isinstance(x.get("replacement"), str) for x in data):
        raise ValueError(f"{path}: a redaction dictionary is a list of objects with the strings pattern and replacement")
    return [(x["pattern"], x["replacement"]) for x in data]


def merged(user: list[tuple[str, str]], default: list[tuple[str, str]] = REDACTIONS) -> list[tuple[str, str]]:
    """Both dictionaries; a user's entry replaces the default's of the same pattern."""
    return list((dict(default) | dict(user)).items())


@dataclass(frozen=True)
class Redaction:
    """Settings of redaction: the name of the system's user, and the dictionary's (pattern, replacement) entries."""

    user: str | None = None
    dictionary: tuple[tuple[str, str], ...] = field(default=tuple(REDACTIONS))

    @property
    def known_user(self) -> str | None:
        """Names of under three characters would hit too much."""
        return self.user if self.user and len(self.user) >= 3 else None
