"""Settings and lint rules: given values before environment, environment before a TOML file, the file before defaults."""

from __future__ import annotations

import dataclasses
import os
import pathlib
import tomllib
from collections.abc import Mapping

# Where the tools keep their logs, below the home folder, by platform where it differs.
DEFAULT_PATHS: dict[str, dict[str, str]] = {
    "claude-code": {"": ".claude/projects"},
    "codex": {"": ".codex/sessions"},
    "gemini": {"": ".gemini/tmp"},
    "openclaw": {"": ".openclaw/sessions"},
    "cursor": {"darwin": "Library/Application Support/Cursor/User", "win32": "AppData/Roaming/Cursor/User", "": ".config/Cursor/User"},
    "cline": {
        "darwin": "Library/Application Support/Code/User/globalStorage/saoudrizwan.claude-dev/tasks",
        "win32": "AppData/Roaming/Code/User/globalStorage/saoudrizwan.claude-dev/tasks",
        "": ".config/Code/User/globalStorage/saoudrizwan.claude-dev/tasks",
    },
}


def default_path(source: str, home: str, platform: str = "") -> str:
    """The folder of a source's logs below home on a platform (as sys.platform names it)."""
    places = DEFAULT_PATHS[source]
    return f"{home.rstrip('/')}/{places.get(platform, places[''])}"


@dataclasses.dataclass(frozen=True)
class Settings:
    """What queries take as parameters."""

    embedder: str = "tfidf"
    duplicate_similarity: float = 0.85
    pattern_similarity: float = 0.5
    least_pattern: int = 3
    keep_threshold: float = 0.3


@dataclasses.dataclass(frozen=True)
class LintConfig:
    """Parameters of `functions.text.lint`: text.lint(c, **dataclasses.asdict(config))."""

    least: int = 20
    short: int = 40
    max_tokens: int = 0
    model: str = ""


def _cast(kind: type, name: str, value: object) -> object:
    try:
        return kind(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be of type {kind.__name__}, not {value!r}") from None


def load[T](cls: type[T], file: str | None = None, section: str = "", env: Mapping[str, str] | None = None, prefix: str = "PARLANCE_", **given: object) -> T:
    """A settings object. Unknown names in the file or the environment are ignored, given ones are an error."""
    table: Mapping[str, object] = {}
    if file and pathlib.Path(file).is_file():
        table = tomllib.loads(pathlib.Path(file).read_text(encoding="utf-8"))
        for part in filter(None, section.split(".")):
            table = table.get(part, {})
    env = os.environ if env is None else env
    values = {}
    for f in dataclasses.fields(cls):
        kind = type(f.default)
        for source, key in ((given, f.name), (env, prefix + f.name.upper()), (table, f.name)):
            if key in source:
                values[f.name] = _cast(kind, f.name, source[key])
                break
    unknown = set(given) - {f.name for f in dataclasses.fields(cls)}
    if unknown:
        raise ValueError(f"no setting {', '.join(sorted(unknown))}")
    return cls(**values)
