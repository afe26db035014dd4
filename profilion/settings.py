"""All settings as one tree: defaults, overrides from JSON, and back."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from profilion.operators import detect, preprocess, track


@dataclass(frozen=True)
class Storage:
    """Hours kept, and hours of a bucket."""

    path: str = "data"
    retention_hours: float = 72.0
    bucket_hours: float = 6.0


@dataclass(frozen=True)
class Settings:
    site: str = "site"
    instrument: str = "instrument"
    altitude: float = 0.0
    preprocess: preprocess.Settings = field(default_factory=preprocess.Settings)
    detect: detect.Settings = field(default_factory=detect.Settings)
    track: track.Settings = field(default_factory=track.Settings)
    storage: Storage = field(default_factory=Storage)

    def merged(self, overrides: dict) -> Settings:
        """These settings with some replaced; keys that are no settings are ignored."""
        return _merged(self, overrides)

    def to_dict(self) -> dict:
        return json.loads(json.dumps(dataclasses.asdict(self)))


def _merged(settings, overrides: dict):
    known, out = {f.name for f in dataclasses.fields(settings)}, {}
    for name, value in overrides.items():
        if name not in known:
            continue
        old = getattr(settings, name)
        out[name] = _merged(old, value) if dataclasses.is_dataclass(old) else tuple(value) if isinstance(old, tuple) else value
    return dataclasses.replace(settings, **out)


def load(path: str | None) -> Settings:
    """Defaults, with what a file of JSON says instead. A few hundred bytes, read by the driver."""
    if path is None:
        return Settings()
    with open(path, encoding="utf-8") as f:
        return Settings().merged(json.load(f))


def save(settings: Settings, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(settings.to_dict(), f, indent=2)
