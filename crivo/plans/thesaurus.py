"""Default synonyms and equivalent terms (fixed values); callers may give their own."""

from __future__ import annotations

#: Unquoted words that also match these.
SYNONYMS: dict[str, list[str]] = {
    "alegre": ["feliz", "sorridente"],
    "feliz": ["alegre", "sorridente"],
    "sorridente": ["alegre", "feliz"],
}
#: Quoted phrases (underscores are spaces) that are expanded to alternatives.
EQUIVALENTS: dict[str, list[str]] = {
    "inss": ["instituto nacional de seguridade social"],
    "instituto_nacional_de_seguridade_social": ["inss"],
}
