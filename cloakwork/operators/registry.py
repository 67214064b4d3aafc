"""Entity types, verticals, profiles: the dimension tables of detection.

The table of types is a set of fixed values that names, verticals and defaults must equal.
"""

from __future__ import annotations

from dataclasses import dataclass

VERTICALS = ("common", "geo", "legal", "finance", "medical", "hr")


@dataclass(frozen=True)
class EntityDef:
    type: str
    verticals: tuple[str, ...]
    detector: str
    confidence: str = "high"
    default_on: bool = True
    not_in: tuple[str, ...] = ()


# Fixed values.
REGISTRY = (
    EntityDef("PER", ("common",), "ner"),
    EntityDef("ORG", ("common",), "ner"),
    EntityDef("DATE", ("common",), "regex"),
    EntityDef("PHONE", ("common",), "regex"),
    EntityDef("PASSPORT", ("common",), "regex"),
    EntityDef("INN", ("common",), "checksum"),
    EntityDef("EMAIL", ("common",), "regex"),
    EntityDef("ADDR", ("common",), "ner", "medium"),
    EntityDef("URL", ("common",), "regex"),
    EntityDef("IP", ("common",), "regex", not_in=("geo",)),
    EntityDef("COORD", ("geo",), "coords"),
    EntityDef("LICENSE_SUBSOIL", ("geo",), "regex", "medium"),
    EntityDef("WELL", ("geo",), "regex", "medium"),
    EntityDef("GEO_NAME", ("geo",), "ner", "medium"),
    EntityDef("CADASTRE", ("geo", "legal"), "regex", "medium"),
    EntityDef("CASE", ("legal",), "regex"),
    EntityDef("OGRN", ("legal",), "checksum"),
    EntityDef("OGRNIP", ("legal",), "checksum"),
    EntityDef("KPP", ("legal",), "regex", "medium"),
    EntityDef("CONTRACT_NO", ("geo", "legal"), "regex", "medium"),
    EntityDef("NOTARY_REG", ("legal",), "regex", "medium"),
    EntityDef("BIK", ("finance",), "checksum"),
    EntityDef("ACCOUNT", ("finance",), "checksum"),
    EntityDef("CARD", ("finance",), "checksum"),
    EntityDef("AMOUNT", ("finance",), "regex", default_on=False),
    EntityDef("SNILS", ("medical", "hr"), "checksum"),
    EntityDef("POLICY_OMS", ("medical",), "regex", "medium"),
    EntityDef("MRN", ("medical",), "regex", "medium"),
    EntityDef("ICD", ("medical",), "regex"),
    EntityDef("PERSONNEL_NO", ("hr",), "regex", "medium"),
    EntityDef("LABOUR_BOOK", ("hr",), "regex", "medium"),
    EntityDef("DL", ("hr",), "regex", "medium"),
    EntityDef("PLATE", ("hr",), "regex"),
)
TYPES = tuple(d.type for d in REGISTRY)
DEFAULT_TYPES = ("PER", "ORG", "DATE", "CASE")

# What each gate profile hides.
GATE_PROFILES = {
    "base": (),
    "geo": ("PER", "ORG", "DATE", "COORD"),
    "legal": ("PER", "ORG", "DATE", "CASE", "PASSPORT", "INN", "PHONE"),
    "standard": ("PER", "ORG", "PASSPORT", "INN", "PHONE"),
    "strict": ("PER", "ORG", "DATE", "CASE", "PASSPORT", "INN", "PHONE", "COORD"),
}


def entities_for_vertical(vertical: str) -> list[str]:
    """Types on by default that are common or the vertical's, without those excluded from it."""
    if vertical not in VERTICALS:
        raise ValueError(f"unknown vertical {vertical!r}")
    return [d.type for d in REGISTRY if d.default_on and vertical not in d.not_in and {"common", vertical} & set(d.verticals)]


def read_types(config: dict) -> list[str]:
    """An explicit list of types, else those of a vertical, else the default four."""
    listed = config.get("types")
    if listed:
        return [t for t in listed if t in TYPES]
    if config.get("vertical") in VERTICALS:
        return entities_for_vertical(config["vertical"])
    return list(DEFAULT_TYPES)


def gate_types(profile: str, pass_through: bool = False) -> list[str]:
    """Types of a gate profile. A profile that hides nothing fails closed unless passing through is explicit."""
    types = list(GATE_PROFILES.get(profile, ()))
    if not types and not pass_through:
        raise PermissionError(f"profile {profile!r} hides nothing; pass_through must be explicit")
    return types
