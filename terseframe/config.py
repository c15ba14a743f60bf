"""Settings of a run; a frozen record that is read while plans are built, never a table."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    scrub: bool = True
    near_dup: bool = True
    decay: bool = True
    code: bool = True
    json: bool = True
    shell: bool = True
    prose: bool = True
    offload: bool = True
    file_versions: bool = True
    cross_component: bool = True
    cache_align: bool = True
    near_dup_threshold: float = 0.85
    near_dup_window: int = 10
    near_dup_least_chars: int = 80
    recent_turns: int = 2
    partial_turns: int = 8
    most_keywords: int = 25
    offload_tokens: int = 2000
    json_depth: int = 4
    most_lines: int = 200
    group_ratio: float = 0.15
    cross_least_chars: int = 200
    delta_ratio: float = 0.6
    cache_tail: int = 3
