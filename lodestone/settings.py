"""Settings from the environment: a blank value is the default, and a bad one too, but it is remembered."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass
class Settings:
    environment: Mapping[str, str] = field(default_factory=lambda: os.environ)
    bad: list[tuple[str, str, int]] = field(default_factory=list)

    def text(self, name: str, default: str) -> str:
        return (self.environment.get(name) or "").strip() or default

    def number(self, name: str, default: int) -> int:
        given = self.text(name, "")
        try:
            return int(given) if given else default
        except ValueError:
            self.bad.append((name, given, default))
            return default

    def summary(self, names: dict[str, str | int]) -> dict[str, str | int]:
        """Each name with its value, read as text or number like its default."""
        return {n: self.number(n, d) if isinstance(d, int) else self.text(n, d) for n, d in names.items()}
