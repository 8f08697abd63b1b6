"""Rule sets of the bound fleet: every kind carries the rules not limited to other kinds."""

from __future__ import annotations

from fleetloom.constants import SCOPE_IMAGE, SCOPE_KIND, SCOPE_POD
from fleetloom.functions.labels import Requirement, Selector
from fleetloom.operators.rules import ActivityRule, Condition, FilterRule


def _on(source: str, match: dict[str, str] | None = None, *exprs: Requirement) -> Condition:
    return Condition(source, Selector(match or {}, exprs))


FILTER_RULES = [
    FilterRule(
        SCOPE_IMAGE,
        (_on("namespace", {"tier": "production"}), _on("image", {"type": "PROMO"})),
        ui_hide=True,
    ),
    FilterRule(
        SCOPE_IMAGE,
        (
            _on("image", None, Requirement("type", "NotIn", ("ECONOMY", "SMALL"))),
            _on("pod", None, Requirement("gpu", "Exists")),
        ),
        api_hide=True,
    ),
    FilterRule(
        SCOPE_POD,
        (_on("image", {"type": "LARGE"}), _on("namespace", None, Requirement("region", "NotIn", ("ASIA",)))),
        deny=True,
        deny_message="large images need another pod size",
    ),
    FilterRule(
        SCOPE_POD,
        (_on("pod", None, Requirement("gpu", "Exists")), _on("namespace", {"tier": "dev"})),
        api_hide=True,
        deny=True,
        deny_message="no GPUs in dev",
    ),
    # the first condition is invalid (no values) and is dropped; the other one still applies
    FilterRule(
        SCOPE_IMAGE,
        (_on("image", None, Requirement("size", "In")), _on("image", {"type": "CUSTOM"})),
        deny=True,
    ),
    # no valid condition is left: never fires
    FilterRule(SCOPE_IMAGE, (_on("image", None, Requirement("size", "Near", ("1",))),), api_hide=True),
    FilterRule(SCOPE_KIND, (_on("namespace", {"region": "ASIA"}),), ui_hide=True),
    FilterRule(
        SCOPE_KIND,
        (_on("namespace", None, Requirement("region", "In", ("EUROPE", "AFRICA"))),),
        api_hide=True,
        deny=True,
        deny_message="secret reason",
        kinds=("Brand#13", "Brand#17"),
    ),
    FilterRule(
        SCOPE_KIND,
        (_on("namespace", None, Requirement("tier", "NotIn", ("production", "staging"))),),
        deny=True,
        deny_message="not in dev",
        kinds=("Brand#2", "Brand#12", "Brand#22"),
    ),
    # an image condition has no meaning in the kind scope, and the rule has no effect: both are lint errors
    FilterRule(SCOPE_KIND, (_on("image", {"type": "PROMO"}),), kinds=("Brand#5",)),
]

ACTIVITY_RULES = [
    ActivityRule((_on("namespace", {"tier": "production"}),), pause=False),
    ActivityRule((_on("pod", None, Requirement("gpu", "Exists")),), True, 1800, 300),
    ActivityRule(),
    ActivityRule(
        (_on("namespace", {"tier": "dev"}), _on("pod", None, Requirement("cpu", "Near", ("1",)))),
        True,
        60,
        kinds=("Brand#12", "Brand#18"),
    ),
    ActivityRule((_on("pod", None, Requirement("memory", "NotIn", ("2Gi", "4Gi"))),), True, 7200, kinds=("Brand#4", "Brand#6")),
    ActivityRule((), True, 3600, kinds=tuple(f"Brand#{n}" for n in range(1, 14))),
    ActivityRule((), True, 9000, 60, kinds=("Brand#7", "Brand#8")),
]
