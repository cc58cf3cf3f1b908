"""Settings, from a mapping such as os.environ."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    language: str
    plain_pagelinks: bool = False
    port: int = 8080

    @classmethod
    def of(cls, env: Mapping[str, str]) -> Settings:
        """WIKI_LANG has to be there; USE_MULTITHREAD is on for "true" and "1"; an unusable PORT means 8080."""
        if not env.get("WIKI_LANG"):
            raise ValueError("WIKI_LANG isn't set")
        port = env.get("PORT", "")
        good = port.isascii() and port.isdigit() and int(port) < 1 << 16
        return cls(env["WIKI_LANG"], env.get("USE_MULTITHREAD") in ("true", "1"), int(port) if good else 8080)
