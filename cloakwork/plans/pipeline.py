"""Components in dependency order, profiles, configuration, and the egress, response and at-rest passes."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame


@dataclass
class Component:
    id: str
    depends: tuple[str, ...] = ()
    enabled: bool = True
    available: Callable[[], bool] = lambda: True
    egress: Callable[[DataFrame], DataFrame] | None = None
    response: Callable[[DataFrame], DataFrame] | None = None
    at_rest: Callable[[bytes], bytes] | None = None
    config: dict[str, Any] = field(default_factory=dict)


class Registry:
    def __init__(self):
        self._all: dict[str, Component] = {}

    def add(self, c: Component) -> None:
        if c.id in self._all:
            raise ValueError(f"component {c.id!r} is there already")
        self._all[c.id] = c

    def get(self, id_: str) -> Component | None:
        return self._all.get(id_)

    def order(self) -> list[Component]:
        """Enabled components, those depended on first, in order of registration otherwise."""
        enabled = {k: c for k, c in self._all.items() if c.enabled}
        for c in enabled.values():
            for d in c.depends:
                if d not in enabled:
                    raise LookupError(f"{c.id!r} needs {d!r}, which is {'disabled' if d in self._all else 'missing'}")
        done: list[Component] = []
        names: set[str] = set()
        while len(done) < len(enabled):
            ready = next((c for c in enabled.values() if c.id not in names and set(c.depends) <= names), None)
            if ready is None:
                raise LookupError("cycle among " + ", ".join(sorted(set(enabled) - names)))
            done.append(ready)
            names.add(ready.id)
        return done


def _usable(c: Component) -> Component:
    if not c.available():
        raise RuntimeError(f"component {c.id!r} is not available")
    return c


def run_egress(registry: Registry, payload: DataFrame) -> DataFrame:
    """Every enabled component in order; one that is not available stops the pass."""
    for c in registry.order():
        if c.egress:
            payload = payload.transform(_usable(c).egress)
    return payload


def run_response(registry: Registry, payload: DataFrame) -> DataFrame:
    for c in reversed(registry.order()):
        if c.response and c.available():
            payload = payload.transform(c.response)
    return payload


def run_at_rest(registry: Registry, data: bytes) -> bytes:
    for c in registry.order():
        if c.at_rest:
            data = _usable(c).at_rest(data)
    return data


_BASE = ("audit", "envelope", "keys")
# Components of a profile and what text-deid hides in it.
PROFILES: dict[str, dict[str, dict]] = {
    "base": {k: {} for k in _BASE},
    "common": {k: {} for k in _BASE} | {"text-deid": {"vertical": "common"}},
    "standard": {k: {} for k in _BASE} | {"text-deid": {"types": ["PER", "ORG"]}},
    "geo": {k: {} for k in _BASE} | {"geo-mask": {}, "text-deid": {"vertical": "geo"}, "scan-redact": {}},
    "legal": {k: {} for k in _BASE} | {"text-deid": {"vertical": "legal"}, "scan-redact": {}},
    "finance": {k: {} for k in _BASE} | {"text-deid": {"vertical": "finance"}, "scan-redact": {}},
    "medical": {k: {} for k in _BASE} | {"text-deid": {"vertical": "medical"}, "scan-redact": {}},
    "hr": {k: {} for k in _BASE} | {"text-deid": {"vertical": "hr"}, "scan-redact": {}},
    "strict": {k: {} for k in _BASE} | {"text-deid": {"types": ["PER", "ORG", "DATE", "CASE", "COORD"]}, "scan-redact": {}},
}


def apply_profile(registry: Registry, profile: dict[str, dict]) -> list[str]:
    """Enables and configures a profile's components, disables the others; returns ids that the registry lacks."""
    for c in registry._all.values():
        c.enabled = c.id in profile
        if c.enabled:
            c.config = dict(profile[c.id])
    return [k for k in profile if registry.get(k) is None]


class ConfigStore:
    """Component settings in memory or a JSON file; listeners hear each change."""

    def __init__(self, path: str | None = None):
        self._path = Path(path) if path else None
        self._state = json.loads(self._path.read_text()) if self._path and self._path.exists() else {}
        self._listeners: list[Callable[[str, dict], None]] = []

    def get(self, id_: str) -> dict:
        return dict(self._state.get(id_, {}))

    def set(self, id_: str, value: dict) -> None:
        self._state[id_] = dict(value)
        if self._path:
            self._path.write_text(json.dumps(self._state, sort_keys=True))
        for f in self._listeners:
            f(id_, value)

    def on_change(self, f: Callable[[str, dict], None]) -> None:
        self._listeners.append(f)


def provision(path: str, values: dict[str, str]) -> None:
    """Inserts or replaces this engine's block of settings in an .env file; other lines stay."""
    start, end = "# >>> cloakwork", "# <<< cloakwork"
    file = Path(path)
    old = file.read_text() if file.exists() else ""
    if start in old and end in old:
        old = old[: old.index(start)] + old[old.index(end) + len(end) :].lstrip("\n")
    block = "\n".join([start, *(f"{k}={v}" for k, v in sorted(values.items())), end])
    file.write_text((old.rstrip("\n") + "\n" if old.strip() else "") + block + "\n")


def degrade(model: str | None, healthy: bool, failed: bool = False) -> str:
    """What to do about a model: rules alone if there is none, block if it should answer and does not."""
    if model is None:
        return "rules"
    return "model" if healthy and not failed else "block"
