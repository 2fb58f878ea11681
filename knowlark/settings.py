"""Settings: typed defaults under overrides that can be reset one by one."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

#: Fixed values.
DEFAULTS: dict[str, Any] = {
    "top_k": 8, "multiplier": 3, "min_score": 0.1, "rerank": "hybrid", "score_norm": "none", "graph_hop": 2, "graph_entities": 5, "graph_chunks": 15,
    "history": 10, "merge_similarity": 0.92, "extract_batch": 4, "chunk_strategy": "fixed", "chunk_size": 600, "chunk_overlap": 100,
}
STRATEGIES = ("fixed", "paragraph", "parent_child")


@dataclass
class Settings:
    path: str | None = None
    overrides: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.path and Path(self.path).exists():
            try:
                found = json.loads(Path(self.path).read_text())
                self.overrides = {k: v for k, v in found.items() if k in DEFAULTS} if isinstance(found, dict) else {}
            except ValueError:
                self.overrides = {}  # a corrupt file counts as none

    def get(self, key: str) -> Any:
        value = self.overrides.get(key, DEFAULTS[key])
        kind = type(DEFAULTS[key])
        try:
            return kind(value)
        except (TypeError, ValueError):
            return DEFAULTS[key]

    def set(self, key: str, value: Any) -> None:
        if key not in DEFAULTS:
            raise KeyError(key)
        self.overrides[key] = value
        self._save()

    def reset(self, key: str | None = None) -> None:
        self.overrides = {} if key is None else {k: v for k, v in self.overrides.items() if k != key}
        self._save()

    def _save(self) -> None:
        if self.path:
            part = Path(self.path + ".tmp")
            part.write_text(json.dumps(self.overrides))
            part.replace(self.path)


def check_knowledge_base(strategy: str, size: int, overlap: int) -> None:
    """Raise ValueError for a knowledge base's chunking outside its limits."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if not 100 <= size <= 4000 or not 0 <= overlap <= 500 or overlap >= size:
        raise ValueError("chunk size is 100 to 4000, overlap 0 to 500 and less than the size")
