"""Settings, rules and providers as values: overlays give new ones, nothing is changed in place."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed
from .operators import detect
from .sources import rules as rule_source


def overlaid(base: Mapping, *others: Mapping | None) -> dict:
    """Nested settings with later ones over earlier ones, key by key (S34); lists and plain values replace, nulls too."""
    out = dict(base)
    for other in others:
        for key, value in (other or {}).items():
            inner = out.get(key)
            out[key] = overlaid(inner if isinstance(inner, Mapping) else {}, value) if isinstance(value, Mapping) else value
    return out


def whole_number(low: int, high: int | None = None) -> Callable[[str], int | None]:
    """Reads a whole number as far as its digits go; null where there is none or it is out of bounds."""

    def read(text: str) -> int | None:
        digits = ""
        for sign in text.strip():
            if not (sign.isdigit() or (sign in "+-" and not digits)):
                break
            digits += sign
        number = int(digits) if digits.strip("+-") else None
        return number if number is not None and number >= low and (high is None or number <= high) else None

    return read


def flag(text: str) -> bool:
    return text.lower() == "true"


def from_environment(settings: Mapping, environment: Mapping[str, str], known: Mapping[str, tuple[tuple[str, ...], Callable]]) -> dict:
    """Settings with what the environment says, which comes last (S34); empty and unreadable values change nothing.

    ``known`` names, for each variable, the path of its setting and how it is read.
    """
    out: Mapping = settings
    for name, (path, read) in known.items():
        value = read(environment[name]) if environment.get(name) else None
        if value is not None:
            out = overlaid(out, reduce(lambda inner, key: {key: inner}, reversed(path), value))
    return dict(out)


@dataclass(frozen=True)
class RuleSet:
    """Detection rules that can't be changed; every method that adds, removes or merges gives another set."""

    rules: Mapping[str, tuple[str, str, float, tuple[str, ...]]] = field(default_factory=lambda: MappingProxyType({}))

    @classmethod
    def of(cls, rules: rule_source.Rules = fixed.RULES) -> RuleSet:
        return cls(MappingProxyType({name: (s, d, t, tuple(ps)) for name, (s, d, t, ps) in rules.items()}))

    @classmethod
    def parsed(cls, text: str) -> RuleSet:
        """Rules from JSON or YAML."""
        return cls.of(rule_source.parse(text))

    @property
    def names(self) -> list[str]:
        return list(self.rules)

    def get(self, name: str):
        return self.rules.get(name)

    def with_rule(self, name: str, severity: str, description: str, threshold: float, patterns: Iterable[str]) -> RuleSet:
        return RuleSet(MappingProxyType({**self.rules, name: (severity, description, threshold, tuple(patterns))}))

    def without(self, *names: str) -> RuleSet:
        return RuleSet(MappingProxyType({k: v for k, v in self.rules.items() if k not in names}))

    def merged(self, custom: RuleSet) -> RuleSet:
        """The custom rules over these."""
        return RuleSet(MappingProxyType({**self.rules, **custom.rules}))

    def plain(self) -> rule_source.Rules:
        return {name: (s, d, t, list(ps)) for name, (s, d, t, ps) in self.rules.items()}

    def problems(self, spark: SparkSession) -> list[str]:
        return rule_source.problems(spark, self.plain())

    def apply(self, files: DataFrame, content: str = "content") -> DataFrame:
        return detect.rule_hits(files, self.plain(), content)


@dataclass(frozen=True)
class Provider:
    """A source of advisories (X6): a function of session and settings, which are its defaults under the caller's."""

    name: str
    read: Callable[[SparkSession, Mapping], DataFrame]
    defaults: Mapping = field(default_factory=lambda: MappingProxyType({}))


@dataclass(frozen=True)
class Providers:
    """Registered providers by name; the last one of a name counts."""

    known: tuple[Provider, ...] = ()

    def with_provider(self, provider: Provider) -> Providers:
        return replace(self, known=(*(p for p in self.known if p.name != provider.name), provider))

    @property
    def names(self) -> list[str]:
        return [p.name for p in self.known]

    def advisories(self, spark: SparkSession, settings: Mapping[str, Mapping] | None = None) -> DataFrame:
        """The rows of all providers that aren't disabled, as a union by name with a column ``provider``.

        A provider without a column has nulls there.  Without any enabled provider there is nothing to be a table of,
        which is an error.
        """
        tables = []
        for provider in self.known:
            own = overlaid(provider.defaults, (settings or {}).get(provider.name))
            if own.get("enabled", True):
                tables.append(provider.read(spark, own).withColumn("provider", F.lit(provider.name)))
        if not tables:
            raise ValueError("no provider is enabled")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def registry_order(default: Iterable[str], custom: Iterable[Mapping] = ()) -> list[str]:
    """Names of registries in the order in which they are asked (U5, X7): the default ones and then custom ones, each once."""
    return list(dict.fromkeys([*default, *(c["name"] for c in custom if c.get("name"))]))
