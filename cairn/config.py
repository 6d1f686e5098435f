"""Settings of an index and of searches over it."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

EMOJI_MODES = ("full", "alias", "both")

#: Settings that change what ends up in an index; a registry row records them.
TRACKED = ("embedding_model", "chunk_size", "chunk_overlap", "preprocess_guide", "emoji_mode", "enrage_bands", "hybrid")


@dataclass(frozen=True)
class Settings:
    guide_dir: str = "data"
    collection_name: str = "default"
    embedding_model: str = "all-MiniLM-L6-v2"
    llm_model: str = "none"
    judge_model: str = "none"
    chunk_size: int = 500
    chunk_overlap: int = 50
    preprocess_guide: bool = True
    emoji_mode: str = "both"
    enrage_bands: bool = True
    top_k: int = 3
    hybrid: bool = True
    hybrid_prefetch: int = 40
    rrf_k: int = 60
    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self):
        if self.emoji_mode not in EMOJI_MODES:
            raise ValueError(f"unknown emoji mode: {self.emoji_mode!r}")

    def given(self, **flags) -> Settings:
        """With the flags that were given; None means not given."""
        known = {f.name for f in fields(self)}
        if unknown := set(flags) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **{k: v for k, v in flags.items() if v is not None})

    def tracked(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k in TRACKED}

    def depth(self, k: int | None) -> int:
        """k, or the default where k is 0 or not given."""
        return k or self.top_k
