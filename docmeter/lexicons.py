"""Word lists, patterns, weights and thresholds. All are defaults of parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

# They have to be these for the scores to come out right.
WEIGHTS = {"sc": 0.30, "dq": 0.20, "bf": 0.50}
THRESHOLDS = {"sc": 0.60, "dq": 0.50, "bf": 0.55}
STRUCTURAL_WEIGHTS = {"business_rules": 0.40, "data_structures": 0.25, "control_flow": 0.20, "external_calls": 0.15}
DOCUMENT_WEIGHTS = {"structure": 0.30, "traceability": 0.30, "readability": 0.20, "abstraction": 0.20}
SECTIONS = {
    "description": r"(?:program\s+)?(?:description|overview|purpose|summary)",
    "input": r"(?:input|data\s+)?input",
    "output": r"(?:output|data\s+)?output",
    "processing": r"(?:processing|logic|business\s+rules?)",
}
WHY = (
    "because", "since", "therefore", "thus", "hence", "consequently",
    "in order to", "so that", "to ensure", "to prevent", "to allow",
    "enables", "ensures", "prevents", "validates", "purpose", "reason",
)
WHAT = (
    "is", "are", "contains", "has", "includes", "consists", "stores",
    "holds", "represents", "defines", "specifies", "sets", "gets",
)
SYNONYMS = {
    "compute": ["calculate", "determine", "derive", "computes", "calculates", "calculated", "computed"],
    "add": ["sum", "accumulate", "total", "adds", "sums"],
    "subtract": ["deduct", "reduce", "minus", "subtracts", "deducts"],
    "multiply": ["times", "product", "multiplies"],
    "divide": ["split", "quotient", "divides"],
    "perform": ["execute", "call", "invoke", "run", "performs", "executes"],
    "if": ["when", "check", "condition", "conditional"],
    "evaluate": ["switch", "case", "select", "evaluates"],
    "move": ["assign", "set", "copy", "transfer", "moves", "assigns"],
    "read": ["input", "load", "fetch", "retrieve", "reads", "retrieves"],
    "write": ["output", "store", "save", "writes", "stores"],
    "open": ["initialize", "connect", "opens"],
    "close": ["terminate", "disconnect", "finalize", "closes"],
    "error": ["exception", "failure", "invalid", "errors"],
    "handler": ["handle", "handling", "process", "trap"],
}
# End of fixed values.


@dataclass(frozen=True)
class Lexicon:
    """What the document scorers look for."""

    sections: dict[str, str] = field(default_factory=lambda: SECTIONS)
    why: tuple[str, ...] = WHY
    what: tuple[str, ...] = WHAT
    synonyms: dict[str, list[str]] = field(default_factory=lambda: SYNONYMS)
    grade_range: tuple[float, float] = (8.0, 12.0)
    grade_penalty: float = 0.05
    target_why_share: float = 0.40


#: For corpora of invented prose, in which the English terms above hardly occur.
CORPUS = Lexicon(
    sections={"first": r"the\s+of", "second": r"in\s+a", "third": r"un\s+de|der\s+die|de\s+la", "fourth": r"and\s+th|el\s+que|qui\s+"},
    why=("of", "to", "that", "in", "que", "von"),
    what=("is", "the", "and", "a", "le", "die", "el"),
)
