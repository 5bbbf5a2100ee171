"""Providers by name: how their answers state model and usage, how their chunks do, what their models cost."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from tracelake.functions.payloads import body_facts, chunk_delta_tokens
from tracelake.functions.pricing import ANTHROPIC_EXACT, ANTHROPIC_PREFIX, OPENAI_EXACT, Price


def prices_of(name: str, exact: dict[str, tuple[float, float]], prefixes: dict[str, tuple[float, float]] | None = None) -> list[Price]:
    """A provider's price list: exact names before prefixes, in the order given."""
    groups = ((exact, True), (prefixes or {}, False))
    return [Price(name, pattern, is_exact, *rates) for rows, is_exact in groups for pattern, rates in rows.items()]


@dataclass(frozen=True)
class Provider:
    """``answers`` adds model and usage columns to a DataFrame (body, streaming, prefix); ``chunks`` reads the tokens of one chunk."""

    name: str
    prices: list[Price] = field(default_factory=list)
    answers: Callable[[DataFrame, str, str, str], DataFrame] = body_facts
    chunks: Callable[[str], Column] = chunk_delta_tokens


class Registry:
    """Names are compared trimmed and in lower case; one that is registered again replaces the former."""

    def __init__(self, *providers: Provider):
        self._known: dict[str, Provider] = {}
        for provider in providers:
            self.add(provider)

    def add(self, provider: Provider) -> None:
        name = provider.name.strip().lower()
        if not name:
            raise ValueError("a provider needs a name")
        self._known[name] = provider

    def get(self, name: str) -> Provider | None:
        return self._known.get(name.strip().lower())

    def names(self) -> list[str]:
        return sorted(self._known)

    def prices(self) -> list[Price]:
        """All price lists, for ``estimate_cost``."""
        return [p for name in self.names() for p in self._known[name].prices]


def default_registry() -> Registry:
    return Registry(Provider("openai", prices_of("openai", OPENAI_EXACT)), Provider("anthropic", prices_of("anthropic", ANTHROPIC_EXACT, ANTHROPIC_PREFIX)))
