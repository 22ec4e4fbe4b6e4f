"""Settings from a YAML file, with overrides."""

from __future__ import annotations

SYNTHETIC = {"corpus.name": "synthetic", "corpus.source": "synthetic"}


def load_settings(path: str, overrides: dict[str, object] | None = None) -> dict:
    """The file's nested settings; an override is named by its dotted path, and None leaves what is there."""
    import yaml

    with open(path, encoding="utf-8") as f:
        settings = yaml.safe_load(f) or {}
    for name, value in (overrides or {}).items():
        if value is None:
            continue
        *outer, last = name.split(".")
        at = settings
        for key in outer:
            if not isinstance(at.get(key), dict):
                at[key] = {}
            at = at[key]
        at[last] = value
    return settings


def setting(settings: dict, name: str, default=None):
    """The value at a dotted path, or the default."""
    for key in name.split("."):
        if not isinstance(settings, dict) or key not in settings:
            return default
        settings = settings[key]
    return settings
