"""Detection settings and their checks."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..functions.sentinel import MAX_TYPE_BYTES
from .fixed import CURATED_ENTROPY, CURATED_RULES


@dataclass(frozen=True)
class Rule:
    name: str
    ty: str
    pattern: str
    priority: int = 0


@dataclass(frozen=True)
class Term:
    term: str
    ty: str | None
    priority: int = 0
    tenant: str | None = None


@dataclass(frozen=True)
class Entropy:
    enabled: bool = False
    min_bits: float = 3.5
    min_len: int = 20
    priority: int = 10
    entity_type: str = "SECRET"


@dataclass(frozen=True)
class Names:
    enabled: bool = False
    entity_type: str = "PERSON"
    priority: int = 30
    names: tuple[str, ...] = ()


@dataclass(frozen=True)
class Ruleset:
    """What to look for. Small by nature: it is written by hand."""

    rules: tuple[Rule, ...] = ()
    terms: tuple[Term, ...] = ()
    entropy: Entropy = field(default_factory=Entropy)
    names: Names = field(default_factory=Names)

    def __post_init__(self):
        kinds = [r.ty for r in self.rules] + [t.ty for t in self.terms]
        kinds += [self.entropy.entity_type, self.names.entity_type]
        for ty in kinds:
            if ty is not None and len(ty.encode()) > MAX_TYPE_BYTES:
                raise ValueError(
                    f"type {ty!r} is longer than {MAX_TYPE_BYTES} bytes: "
                    "its placeholders would exceed the size bound and never resolve"
                )
        if any(t.term == "" for t in self.terms):
            raise ValueError("a glossary term is empty")

    def with_terms(self, terms) -> "Ruleset":
        """Append terms (for example from a secret source) after the glossary."""
        return replace(self, terms=self.terms + tuple(terms))

    def for_tenant(self, tenant: str | None) -> "Ruleset":
        """Global terms first, then the tenant's own."""
        general = tuple(t for t in self.terms if t.tenant is None)
        own = tuple(t for t in self.terms if tenant is not None and t.tenant == tenant)
        return replace(self, terms=general + own)

    def tenants(self) -> list[str]:
        return sorted({t.tenant for t in self.terms if t.tenant is not None})


def curated(entropy: bool = True) -> Ruleset:
    """The curated pack: 22 patterns for keys, tokens, credentials and e-mail."""
    return Ruleset(
        rules=tuple(Rule(n, t, p, prio) for n, t, prio, p in CURATED_RULES),
        entropy=Entropy(enabled=entropy, **CURATED_ENTROPY),
    )
