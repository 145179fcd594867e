"""Budgets and thresholds; plain literals, so that the optimiser folds them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Defaults of a large model; ``SMALL`` splits ordinary documents."""

    context_limit: int = 200_000
    output_reserved: int = 8_000
    prompt_reserved: int = 3_000
    single_pass: float = 0.80
    map_reduce: float = 3.00
    overlap: int = 200
    min_chunk: int = 500
    rows_per_block: int = 1000
    slides_per_block: int = 10
    ontology_ratio: float = 0.15

    @property
    def available(self) -> int:
        """Tokens left for content."""
        return self.context_limit - self.output_reserved - self.prompt_reserved

    @property
    def ontology_budget(self) -> int:
        """Tokens for the graph's part of a context, from 1,000 to 8,000."""
        return max(1000, min(8000, int(self.available * self.ontology_ratio)))


DEFAULT = Settings()
SMALL = Settings(context_limit=10_000, output_reserved=1_000, prompt_reserved=500, overlap=50, min_chunk=100, rows_per_block=100, slides_per_block=3)
#: A budget under which the longest documents are hierarchical.
TINY = Settings(context_limit=2_000, output_reserved=200, prompt_reserved=300, overlap=20, min_chunk=50, rows_per_block=100, slides_per_block=3)
