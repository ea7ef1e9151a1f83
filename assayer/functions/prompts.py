"""Extraction prompts that a graph's ontology fills in, on the driver."""

from __future__ import annotations

import json
import re
from typing import Any

from assayer.sources.tables import Ontology

#: The only relations that a graph built with these prompts has. Fixed values.
RELATIONS = ("is_a", "part_of", "located_in", "causes", "uses", "associated_with", "same_as")
HEADING = "### System Role"
#: Lines that end the system role though they aren't headings. Fixed values.
NEXT_PARTS = frozenset({"user role", "assistant role", "task", "instructions"})


def rules_text(rules: dict[str, Any]) -> str:
    """A list of rules; nested ones as indented JSON below their name."""
    if not rules:
        return "- none"
    out = []
    for name, rule in rules.items():
        nested = isinstance(rule, (dict, list, tuple))
        out.append(f"- {name}:" if nested else f"- {name}: {rule}")
        if nested:
            out += ["  " + x for x in json.dumps(rule, ensure_ascii=False, indent=2).split("\n")]
    return "\n".join(out)


def _bullets(items: tuple[str, ...]) -> str:
    return "\n".join(f"- {x}" for x in items) or "- any that the text supports"


def entity_role(ontology: Ontology | None) -> str:
    types, rules = (ontology.allowed_types, ontology.rules) if ontology else ((), {})
    return f"You extract entities for a knowledge graph. Name only what the text says.\nAllowed types:\n{_bullets(types)}\nRules:\n{rules_text(rules)}"


def relation_role(ontology: Ontology | None, relations: tuple[str, ...] = RELATIONS) -> str:
    types, rules = (ontology.allowed_types, ontology.rules) if ontology else ((), {})
    return f"You extract relations for a knowledge graph. Give every relation exactly one of these labels, the most specific that holds:\n{_bullets(relations)}\nTypes of entities:\n{_bullets(types)}\nRules:\n{rules_text(rules)}"


def with_role(template: str, role: str) -> str:
    """The template with its system role replaced, up to the next heading or part; one without a system role gets it at the top."""
    lines = template.splitlines()
    at = next((i for i, x in enumerate(lines) if "system role" in x.lower()), None)
    if at is None:
        return f"{HEADING}\n{role}\n\n{template.lstrip()}"

    def ends(line: str) -> bool:
        text = line.strip().lower()
        return text in NEXT_PARTS or bool(re.match(r"#{1,3} ", text)) and "system role" not in text

    rest = next((i for i in range(at + 1, len(lines)) if ends(lines[i])), len(lines))
    return "\n".join([*lines[: at + 1], role, "", *lines[rest:]]).strip() + "\n"
