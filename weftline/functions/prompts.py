"""Texts for a planning model: what an answer looks like, by which checks it is judged, and what is told of a diff, a
chunk or a plan. All templates can be replaced; what is put into them has fixed formats."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import options as O
from ..options import Priority
from .text import MESSAGES

#: Checks of operators/validate.py that a model's plan has to pass.
CHECKS = ("unknown_dependency", "cycle", "coverage_gap", "coverage_overlap", "conflict", "above_max")


def answer_schema() -> str:
    """The columns of an answer, one a line, as sources/documents.py reads them."""
    assignment = "file_path, assignment_type (" + " | ".join(O.AssignmentType) + "), hunk_indices"
    return f"groups: list of\n  id, title, description, depends_on: list of ids, estimated_loc\n  assignments: list of {assignment}"


def checks() -> str:
    """A line for each check, made of the message that its failure is reported with."""
    return "\n".join(f"- {name}: {re.sub('%[ds]', '..', MESSAGES[name])}" for name in CHECKS)


@dataclass(frozen=True)
class Prompts:
    """Templates with {placeholders}; a template may leave placeholders out."""

    system: str = "Output\n{schema}\nhunk_indices are the numbers in the labels [hunk_index=N].\n\nA plan fails with\n{checks}\nhere the maximum is {max_loc}.\n\n{priority_instructions}"
    orthogonal: str = f"Units are kept together by file ({O.SAME_FILE} points), then by test and subject ({O.TEST_PAIR}) and directory ({O.SHARED_DIR} a level, {O.ORTHOGONAL_PENALTY} off); every further file in a group costs {O.ORTHOGONAL_FILE_PENALTY:g}."
    logical: str = f"Units are kept together by file ({O.SAME_FILE} points), then by test and subject ({O.TEST_PAIR}) and directory ({O.SHARED_DIR} a level, {O.LOGICAL_DIR_BONUS} more for the first); further files are free."
    user: str = "# Files\n{file_summary}\n\n# Hunks\n{full_diff}"
    chunk_first: str = "# Part: chunk 1 of {total_chunks}, {remaining_chunks} more to come\n\n# Files\n{file_summary}\n\n# Hunks\n{chunk_diff}"
    chunk_next: str = "# Part: chunk {chunk_index} of {total_chunks}\n\n# Known groups; an id of theirs adds to that group\n{group_catalog}\n\n# Files\n{file_summary}\n\n# Hunks\n{chunk_diff}"
    refine: str = "# Limits broken\n{violations}\n\n# Plan to replace\n{current_plan}\n\n# Hunks\n{full_diff}"

    def system_text(self, priority: str | Priority, max_loc: int) -> str:
        return self.system.format(schema=answer_schema(), checks=checks(), max_loc=max_loc, priority_instructions=self.logical if Priority(priority) == Priority.LOGICAL else self.orthogonal)

    def filled(self, name: str, **values: Column | str | int) -> Column:
        """The named template with columns or constants in its placeholders."""
        if name not in {f.name for f in fields(self)}:
            raise ValueError(f"no template {name}")
        parts = []
        for literal, field, _, _ in Formatter().parse(getattr(self, name)):
            parts.append(F.lit(literal))
            if field is not None:
                value = values[field]
                parts.append(value.cast("string") if isinstance(value, Column) else F.lit(str(value)))
        return F.concat(*parts)


def violation_line(kind: Column, group: Column, loc: Column, added: Column, removed: Column, limit: Column) -> Column:
    way = F.when(kind == "below_min", "below minimum").otherwise("above maximum")
    return F.format_string("  - %s: %s LOC (+%s/-%s), %s %s", *[c.cast("string") for c in (group, loc, added, removed, way, limit)])
