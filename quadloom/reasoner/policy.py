"""What the reasoner does: modes, feature flags, presets, capabilities."""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

MODES = ("disabled", "rules-mvp", "owl-dl-target")


@dataclass(frozen=True)
class Policy:
    """Feature flags; the preset 'bounded-owl' has all, 'rdfs-core' the first four."""

    rdfs_subclass_closure: bool = True
    rdfs_subproperty_closure: bool = True
    rdfs_type_propagation: bool = True
    rdfs_domain_range_typing: bool = True
    owl_property_assertion_closure: bool = True
    owl_equality_reasoning: bool = True
    owl_property_chain_axioms: bool = True
    owl_consistency_check: bool = True
    diagnose_unsupported: bool = True
    #: 'reference': reflexive seeds follow the chain flag and chains the closure flag; 'strict': each its own.
    gates: str = "reference"
    #: leave x subClassOf x and x subPropertyOf x, which cycles entail, out of what is derived
    drop_reflexive: bool = True

    @property
    def preset(self) -> str:
        for name, policy in PRESETS.items():
            if self == policy:
                return name
        return "custom"

    @property
    def key(self) -> tuple:
        return astuple(self)

    @property
    def reflexive(self) -> bool:
        return self.owl_property_chain_axioms if self.gates == "reference" else self.owl_property_assertion_closure

    @property
    def chains(self) -> bool:
        return self.owl_property_assertion_closure if self.gates == "reference" else self.owl_property_chain_axioms


PRESETS = {
    "rdfs-core": Policy(owl_property_assertion_closure=False, owl_equality_reasoning=False, owl_property_chain_axioms=False, owl_consistency_check=False),
    "bounded-owl": Policy(),
}


def capabilities(mode: str, policy: Policy) -> list[dict[str, object]]:
    """Features with their maturity in a mode."""
    if mode == "rules-mvp":
        names = [f.name for f in fields(Policy) if f.name.startswith(("rdfs", "owl"))]
        return [{"feature": n, "maturity": "stable" if n.startswith("rdfs") else "experimental", "enabled": getattr(policy, n)} for n in names]
    if mode == "owl-dl-target":
        return [{"feature": n, "maturity": "target", "enabled": False} for n in ("owl_class_satisfiability", "owl_consistency_check", "incremental_refresh", "explanation_trace")]
    return []
