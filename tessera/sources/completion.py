"""The interface to a completion model. No client is part of this package: a caller brings one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol


class RateLimited(RuntimeError):
    pass


class ApiError(RuntimeError):
    pass


class Completion(Protocol):
    def complete(self, prompt: str) -> str: ...

    def stream(self, prompt: str) -> Iterator[str]: ...


@dataclass
class Endpoint:
    """What a client needs to know; the first of explicit value, environment and default counts."""

    provider: str
    model: str
    base_url: str
    api_key: str | None
    max_tokens: int = 4096


def endpoint(provider: str, defaults: dict[str, tuple[str, str]], env: dict[str, str], model: str | None = None, base_url: str | None = None, api_key: str | None = None) -> Endpoint:
    """defaults: provider → (model, base URL)."""
    if provider not in defaults:
        raise ValueError(f"unknown provider {provider}")
    name = provider.upper()
    return Endpoint(provider, model or env.get(f"{name}_MODEL") or defaults[provider][0], base_url or env.get(f"{name}_BASE_URL") or defaults[provider][1], api_key or env.get(f"{name}_API_KEY"))


def checked(status: int, body: str) -> str:
    """The body of a good answer; the kind of failure otherwise. Nothing is tried again."""
    if status == 429:
        raise RateLimited(body)
    if not 200 <= status < 300:
        raise ApiError(f"{status}: {body}")
    return body
