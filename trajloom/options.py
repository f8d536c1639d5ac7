"""Options handed to the operators. They are checked here, before any job runs."""

from __future__ import annotations

from dataclasses import dataclass

TRUNCATION_MODES = ("keep_start", "keep_end")

# Ids below FIRST_TOKEN_ID are kept for the special tokens of a built vocabulary.
PAD_ID, UNK_ID, BOS_ID, EOS_ID = 0, 1, 2, 3
FIRST_TOKEN_ID = 4


@dataclass(frozen=True)
class LossOptions:
    """Options of the off-policy loss.

    alpha                  upper cap of the importance weight
    clip_ratio_max         upper clip of the raw probability ratio
    length_normalize       use per-token mean log-probs in ratio and loss
    require_old_nll        a missing or null ``nll_seq`` is an error
    use_dataset_advantage  take the advantage column, else the default for all
    default_advantage      fallback for a missing advantage
    """

    alpha: float = 1.0
    clip_ratio_max: float = 10.0
    length_normalize: bool = False
    require_old_nll: bool = True
    use_dataset_advantage: bool = True
    default_advantage: float = 1.0

    def __post_init__(self) -> None:
        # ln(0) is NULL in Spark, which would silently switch the clip off.
        if not self.clip_ratio_max > 0:
            raise ValueError(f"clip_ratio_max must be positive, got {self.clip_ratio_max}")


@dataclass(frozen=True)
class TokenOptions:
    """Options of templating, truncation, masking and padding."""

    template: str = "ours"
    max_length: int = 1024
    max_prompt_length: int = 512
    truncation_mode: str = "keep_end"
    label_pad_token_id: int = -100
    bos_token_id: int | None = None
    eos_token_id: int | None = None
    pad_token_id: int | None = None

    def __post_init__(self) -> None:
        if self.truncation_mode not in TRUNCATION_MODES:
            raise ValueError(f"Unknown truncation mode: {self.truncation_mode}")
        if self.max_length < 0 or self.max_prompt_length < 0:
            raise ValueError("max_length and max_prompt_length must not be negative")

    @property
    def pad_id(self) -> int:
        """The pad id; without one the end-of-sequence id, without that 0."""
        if self.pad_token_id is not None:
            return self.pad_token_id
        return self.eos_token_id if self.eos_token_id is not None else 0


@dataclass(frozen=True)
class BatchOptions:
    """Options of the seeded order and of batching.

    A forward call takes ``per_device`` rows on each of ``processes`` devices; an
    optimiser step takes ``accumulation`` forward calls.
    """

    per_device: int = 1
    processes: int = 1
    accumulation: int = 16
    epochs: int = 2
    seed: int = 42
    max_steps: int | None = None

    def __post_init__(self) -> None:
        for name in ("per_device", "processes", "accumulation", "epochs"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")

    @property
    def rows_per_batch(self) -> int:
        return self.per_device * self.processes
