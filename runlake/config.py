"""Settings: a YAML file, and the API key from the environment or ``env/.env``."""

from __future__ import annotations

import os
from pathlib import Path
from typing import Any


def environment(path: str | Path = "env/.env") -> dict[str, str]:
    """KEY=value lines, overridden by the process's environment."""
    own: dict[str, str] = {}
    if Path(path).exists():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            key, found, value = line.strip().removeprefix("export ").partition("=")
            if found and not key.startswith("#"):
                own[key.strip()] = value.strip().strip("\"'")
    return own | dict(os.environ)


def load(path: str | Path = "config/local.yaml", env_file: str | Path = "env/.env") -> dict[str, Any]:
    """The file's content; space_weather.api_key is what the variable named by api_key_env holds (None without)."""
    import yaml

    config = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    own = config["space_weather"]
    own["api_key"] = environment(env_file).get(own["api_key_env"])
    return config
