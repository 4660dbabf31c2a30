"""Options of planning, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import StrEnum


class PlanError(Exception):
    """Base of all errors that an operator raises on purpose; rows that break a rule are reported as violations."""


class AssignmentType(StrEnum):
    WHOLE_FILE = "whole_file"
    PARTIAL_HUNKS = "partial_hunks"


class Priority(StrEnum):
    ORTHOGONAL = "orthogonal"
    LOGICAL = "logical"


class ChunkStrategy(StrEnum):
    GREEDY = "greedy"
    DYNAMIC_PROGRAMMING = "dynamic_programming"


class PartitionStrategy(StrEnum):
    LLM = "llm"
    GRAPH = "graph"
    CP_SAT = "cp_sat"


class Violation(StrEnum):
    BELOW_MIN = "below_min"
    ABOVE_MAX = "above_max"


class PRState(StrEnum):
    OPEN = "open"
    CLOSED = "closed"
    MERGED = "merged"


class Provider(StrEnum):
    ANTHROPIC = "anthropic"
    OPENAI = "openai"


# Weights and limits that results depend on.
TOKEN_RATIO = 0.25
CHUNK_BASE_COST = 100.0
CHUNK_FILE_MIX = 50.0
CHUNK_SAME_FILE_BOUNDARY = 10_000.0
SAME_FILE = 500
SHARED_DIR = 25
SAME_SUFFIX = 10
TEST_PAIR = 40
ORTHOGONAL_PENALTY = 20
LOGICAL_DIR_BONUS = 10
ORTHOGONAL_FILE_PENALTY = 25.0
EXACT_OVERFLOW = 1000
EXACT_UNDERFLOW = 1000
#: Priority: (weight of a group, penalty of a pair over two files, divisor of affinity).
EXACT_WEIGHTS = {Priority.LOGICAL: (200, 0, 5), Priority.ORTHOGONAL: (250, 400, 10)}
CONTEXT_TOKENS = {Provider.ANTHROPIC: 1_000_000, Provider.OPENAI: 1_050_000}
MAX_OUTPUT_TOKENS = 128_000
CHUNK_TARGET_RATIO = 2 / 3
CHUNK_ATTEMPTS = 2
AUTO_MIN_RATIO = 4  # min_loc = max_loc // 4 when it is derived


@dataclass(frozen=True)
class PlanOptions:
    max_loc: int = 400
    min_loc: int | None = None
    strict_loc_bounds: bool = False
    stacked: bool = False
    draft: bool = False
    priority: Priority = Priority.ORTHOGONAL
    chunk_strategy: ChunkStrategy = ChunkStrategy.DYNAMIC_PROGRAMMING
    partition_strategy: PartitionStrategy = PartitionStrategy.GRAPH
    provider: Provider = Provider.ANTHROPIC
    exact_steps: int = 500
    max_refinement_iterations: int = 0

    def __post_init__(self) -> None:
        for name, kind in (("priority", Priority), ("chunk_strategy", ChunkStrategy), ("partition_strategy", PartitionStrategy), ("provider", Provider)):
            object.__setattr__(self, name, kind(getattr(self, name)))
        if self.max_loc <= 0:
            raise ValueError("max_loc must be above 0")
        if self.min_loc is not None and self.min_loc < 1:
            raise ValueError("min_loc must be 1 or more")
        if self.max_refinement_iterations < 0:
            raise ValueError("max_refinement_iterations must be 0 or more")
        if self.min_loc is None and self.max_refinement_iterations > 0:
            object.__setattr__(self, "min_loc", max(1, self.max_loc // AUTO_MIN_RATIO))
        if self.min_loc is not None and self.min_loc >= self.max_loc:
            raise ValueError("min_loc must be below max_loc")

    def with_(self, **changes) -> PlanOptions:
        return replace(self, **changes)

    @property
    def context_tokens(self) -> int:
        return CONTEXT_TOKENS[self.provider]

    def needs_chunking(self, tokens: int) -> bool:
        """Whether a prompt of so many tokens leaves no room for the answer."""
        return tokens > self.context_tokens - MAX_OUTPUT_TOKENS

    def chunk_budget(self, overhead: int) -> int:
        return int(self.context_tokens * CHUNK_TARGET_RATIO) - overhead - MAX_OUTPUT_TOKENS


def options_from(values: dict[str, str], prefix: str = "WEFTLINE_") -> PlanOptions:
    """Options from names and texts such as an environment; unknown names are ignored."""
    kinds = {"max_loc": int, "min_loc": int, "exact_steps": int, "max_refinement_iterations": int, "priority": str, "chunk_strategy": str, "partition_strategy": str, "provider": str}
    flags = ("strict_loc_bounds", "stacked", "draft")
    got = {}
    for name, text in values.items():
        key = name.removeprefix(prefix).lower()
        if not name.startswith(prefix):
            continue
        if key in flags:
            got[key] = text.strip().lower() in ("1", "true", "yes", "on")
        elif key in kinds:
            try:
                got[key] = kinds[key](text)
            except ValueError as bad:
                raise PlanError(f"{name} must be a number, not {text!r}") from bad
    return PlanOptions(**got)
