"""Protocol constants: one frozen object that every operator takes as a parameter. Hash domains are this engine's own."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Protocol:
    """Numbers of the evaluation protocol; they are fixed values that results depend on."""

    evaluation_rows: int = 100_000
    window_blocks: int = 3_600
    budget_levels: tuple[int, ...] = (1_024, 2_048, 4_096, 8_192, 16_384)
    budget_tolerance_bps: int = 1_000
    weight_interval: int = 150
    audit_delay: int = 5
    audit_rows: int = 32
    required_rounds: int = 30
    total_rounds: int = 50
    max_rank: int = 3
    max_gap: float = 0.25
    exact_ratio: float = 0.995
    max_prompt: int = 32_768
    max_context: int = 32_768
    burn_share: float = 0.9
    scan_bps: int = 9_000
    domain: str = "gradelake/window/1"


PROTOCOL = Protocol()
