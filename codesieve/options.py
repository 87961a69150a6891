"""Options of a scan job; every field feeds column expressions of the plan."""

from __future__ import annotations

from dataclasses import dataclass, field

MODEL_PACK = "M"
HEURISTIC_PACK = "H"
PATTERN_PACK = "X"
ALL_PACKS = frozenset({MODEL_PACK, HEURISTIC_PACK, PATTERN_PACK})

# Severities in rank order with their default risk weights.
SEVERITY_WEIGHTS = {"CRITICAL": 10, "HIGH": 7, "MEDIUM": 4, "LOW": 1}


@dataclass(frozen=True)
class ScanOptions:
    """What to scan for and how to report it.

    ``max_chunk_size`` None keeps every chunk whole. Control blocks (``if``, ``for``, ``while``,
    ``switch``) count as function chunks unless switched off.
    """

    max_chunk_size: int | None = 3000
    packs: frozenset[str] = ALL_PACKS
    include_control_blocks: bool = True
    confidence_threshold: float = 0.0
    include_context: bool = True
    max_context_lines: int = 0
    ignore_patterns: tuple[str, ...] = ()
    severity_weights: dict[str, int] = field(default_factory=lambda: dict(SEVERITY_WEIGHTS))

    @classmethod
    def from_config(cls, config: dict) -> "ScanOptions":
        """Build options from the documented nested configuration keys."""
        analysis = config.get("analysis", {})
        output = config.get("output", {})
        vulnerabilities = config.get("vulnerabilities", {})
        packs = ALL_PACKS if analysis.get("enable_llm", True) else ALL_PACKS - {MODEL_PACK}
        return cls(
            max_chunk_size=analysis.get("max_chunk_size", cls.max_chunk_size),
            packs=packs,
            confidence_threshold=analysis.get("confidence_threshold", 0.0),
            include_context=output.get("include_context", True),
            max_context_lines=output.get("max_context_lines", 0),
            ignore_patterns=tuple(vulnerabilities.get("ignore_patterns", ())),
            severity_weights={**SEVERITY_WEIGHTS, **vulnerabilities.get("severity_weights", {})},
        )
