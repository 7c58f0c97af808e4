"""Settings from TOML: the first file found counts, environment variables override a loaded file, defaults fill the rest."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, replace

from tessera.operators.context import MAX_FILE, MAX_TOTAL


@dataclass(frozen=True)
class Context:
    max_file_size: int = MAX_FILE
    max_total_size: int = MAX_TOTAL
    exclude_mode: str = "substring"


@dataclass(frozen=True)
class Knowledge:
    max_chunk_size: int = 1000
    chunk_overlap: int = 100
    search_limit: int = 10
    dimension: int = 384


@dataclass(frozen=True)
class Llm:
    provider: str = "none"
    model: str = ""
    max_tokens: int = 4096


@dataclass(frozen=True)
class Storage:
    data_dir: str = "~/.tessera"


@dataclass(frozen=True)
class Config:
    context: Context = field(default_factory=Context)
    knowledge: Knowledge = field(default_factory=Knowledge)
    llm: Llm = field(default_factory=Llm)
    storage: Storage = field(default_factory=Storage)


def _filled(kind: type, values: dict):
    return kind(**{f.name: values[f.name] for f in fields(kind) if f.name in values})


def from_text(text: str) -> Config:
    raw = tomllib.loads(text)
    return Config(*(_filled(kind, raw.get(name, {})) for name, kind in (("context", Context), ("knowledge", Knowledge), ("llm", Llm), ("storage", Storage))))


def load(candidates: list[str], env: dict[str, str] | None = None) -> Config:
    env = dict(os.environ) if env is None else env
    for path in candidates:
        path = os.path.expanduser(path)
        if os.path.isfile(path):
            try:
                with open(path, encoding="utf-8") as f:
                    config = from_text(f.read())
            except (OSError, ValueError, TypeError):
                return Config()
            if env.get("TESSERA_DATA_DIR"):
                config = replace(config, storage=replace(config.storage, data_dir=env["TESSERA_DATA_DIR"]))
            if env.get("TESSERA_MODEL"):
                config = replace(config, llm=replace(config.llm, model=env["TESSERA_MODEL"]))
            return config
    return Config()
