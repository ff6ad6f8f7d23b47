"""Settings of an engine: environment over file over defaults, all checked."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

from searchloom import contracts as c

PREFIX = "SEARCHLOOM_"


class ConfigError(ValueError):
    """A setting that isn't known or not of its kind."""


@dataclass(frozen=True)
class Config:
    """Where the vault and the index are, what is read, and limits."""

    vault: str | None = None
    store: str | None = None
    index_whole_folder: bool = False
    included_sections: tuple[str, ...] = c.INCLUDED_SECTIONS
    excluded_dirs: tuple[str, ...] = c.EXCLUDED_DIRS
    excluded_files: tuple[str, ...] = c.EXCLUDED_FILES
    max_markdown_bytes: int = c.MARKDOWN_BYTES
    max_pdf_bytes: int = c.PDF_BYTES
    lock_wait_seconds: float = c.LOCK_WAIT
    retention_generations: int = 3


def _checked(name: str, kind: str, value: object, text: bool) -> object:
    """value as a field of kind; text says that it comes from the environment."""
    bad = ConfigError(f"{name} isn't a {kind}: {value!r}")
    if kind.startswith("tuple"):
        items = [x.strip() for x in str(value).split(",")] if text else value
        if not isinstance(items, list) or not all(isinstance(x, str) and x.strip() for x in items):
            raise bad
        return tuple(dict.fromkeys(items))
    if kind == "bool":
        if text:
            value = {"true": True, "1": True, "false": False, "0": False}.get(str(value).lower())
        if not isinstance(value, bool):
            raise bad
        return value
    if kind in ("int", "float"):
        try:
            number = (int if kind == "int" else float)(value) if text else value
        except ValueError:
            raise bad from None
        if isinstance(number, bool) or not isinstance(number, (int, float) if kind == "float" else int) or not 0 < number < float("inf"):
            raise bad
        return number
    if not isinstance(value, str) or not value.strip():
        raise bad
    return value


def load(path: str | Path | None = None, environ: Mapping[str, str] | None = None) -> Config:
    """The settings of a TOML file (none if it isn't there), with those of the
    environment, such as SEARCHLOOM_STORE, over them. Names that aren't known
    and values of another kind are errors; lists are comma-separated in the
    environment."""
    environ = os.environ if environ is None else environ
    told: dict[str, object] = {}
    if path is not None and Path(path).exists():
        try:
            told = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        except (tomllib.TOMLDecodeError, UnicodeDecodeError) as error:
            raise ConfigError(f"{path}: {error}") from error
    kinds = {f.name: str(f.type) for f in fields(Config)}
    if unknown := set(told) - set(kinds):
        raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
    values = {k: _checked(k, kinds[k], v, False) for k, v in told.items()}
    values |= {k: _checked(PREFIX + k.upper(), kinds[k], environ[PREFIX + k.upper()], True) for k in kinds if PREFIX + k.upper() in environ}
    return Config(**values)
