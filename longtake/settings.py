"""Settings with the defaults of the computation they parameterise."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

# Fixed values.
HYSTERESIS = 0.15
LONGEST_SPEECH_MARGIN = 1e-6
FRAME_COUNT_MARGIN = 1e-9
BLOCK_FRAMES = 1 << 16


@dataclass(frozen=True)
class SegmentationSettings:
    max_chunk_seconds: float = 15.0
    threshold: float = 0.5
    min_speech_seconds: float = 0.25
    min_silence_seconds: float = 0.1
    speech_pad_seconds: float = 0.2
    max_merge_gap_seconds: float = 1.0
    energy_margin_db: float = 15.0
    block_frames: int = BLOCK_FRAMES

    def __post_init__(self) -> None:
        if not (math.isfinite(self.max_chunk_seconds) and self.max_chunk_seconds > 0):
            raise ValueError("max_chunk_seconds must be finite and positive")

    @property
    def pad(self) -> float:
        """Padding, never more than a quarter of the longest chunk."""
        return min(max(0.0, self.speech_pad_seconds), self.max_chunk_seconds / 4)


DEFAULT = SegmentationSettings()
TIGHT = SegmentationSettings(
    max_chunk_seconds=1.0,
    min_speech_seconds=0.064,
    min_silence_seconds=0.08,
    speech_pad_seconds=0.032,
    max_merge_gap_seconds=0.1,
)


@dataclass(frozen=True)
class InferenceSettings:
    """What the transcriber is asked for; part of the identity of a result."""

    backend: str = "mock"
    model: str = "model"
    language: str | None = None
    prompt: str | None = None
    temperature: float = 0.0
    seed: int = 42
    response_mode: str = "plain"
    max_tokens: int = 1024
    min_tokens: int = 48
    tokens_per_second: float = 8.0
    compression_ratio_threshold: float = 2.4
    fallback_temperatures: tuple[float, ...] = (0.2, 0.4)
    split_on_failure: bool = True
    context_free_fallback: bool = True
    retries: int = 2
    parallel_requests: int = 1
    collect_logprobs: bool = False
    max_duration: float | None = None
    start_seconds: float = 0.0
    runtime: dict | None = field(default=None, hash=False)
