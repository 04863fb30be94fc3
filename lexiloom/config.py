"""Arguments of the verbs as frozen records that refuse values out of range."""

from __future__ import annotations

from dataclasses import asdict, dataclass

SELECTORS = ("seg", "tgts.human", "tgts.base", "tgts.corrected")


def _positive(**values: float | None) -> None:
    for name, value in values.items():
        if value is not None and value <= 0:
            raise ValueError(f"{name} must be positive")


@dataclass(frozen=True)
class Generation:
    """What a model run is made of; its fields stand in the manifest. max_model_len counts the prompt and the new tokens."""

    model: str
    prompt: str
    source_language: str = "en"
    target_language: str = "fr"
    output_field: str = "base"
    max_model_len: int = 2048
    max_new_tokens: int = 512
    batch_size: int = 32
    gpu_memory_utilization: float = 0.90
    tensor_parallel_size: int = 1
    seed: int = 42
    limit: int | None = None
    revision: str | None = None
    skip_header: bool = False

    def __post_init__(self) -> None:
        _positive(max_model_len=self.max_model_len, max_new_tokens=self.max_new_tokens, batch_size=self.batch_size, tensor_parallel_size=self.tensor_parallel_size, limit=self.limit)
        if self.source_language == self.target_language:
            raise ValueError("source and target languages must differ")
        if self.max_new_tokens >= self.max_model_len:
            raise ValueError("max_new_tokens must be smaller than max_model_len")
        if not 0 < self.gpu_memory_utilization < 1:
            raise ValueError("gpu_memory_utilization must be between 0 and 1")
        if not self.prompt.strip():
            raise ValueError("empty prompt")

    def manifest(self, **more: object) -> dict:
        return asdict(self) | {"temperature": 0, "failure_policy": "skip"} | more


@dataclass(frozen=True)
class PostEdit(Generation):
    """A teacher's run: by default a longer context, and the share of changed tokens above which an edit is marked for review."""

    output_field: str = "corrected"
    max_model_len: int = 4096
    max_new_tokens: int = 1024
    tensor_parallel_size: int = 4
    review_edit_fraction: float = 0.30

    def __post_init__(self) -> None:
        super().__post_init__()
        if not 0 <= self.review_edit_fraction <= 1:
            raise ValueError("review_edit_fraction must be between 0 and 1")


@dataclass(frozen=True)
class Selection:
    """Which fields go where: selectors of src, tgt and, for preferences, reject."""

    src: str
    tgt: str
    reject: str | None = None
    target_language: str | None = None
    format: str | None = None

    def __post_init__(self) -> None:
        if not {self.src, self.tgt, self.reject} - {None} <= set(SELECTORS):
            raise ValueError(f"selectors are {', '.join(SELECTORS)}")
        if self.format not in (None, "jsonl", "tsv"):
            raise ValueError("format is jsonl or tsv")

    def columns(self) -> dict[str, str]:
        return {"src": self.src, "tgt": self.tgt} | ({"reject": self.reject} if self.reject else {})


@dataclass(frozen=True)
class Inspection:
    """max_length: tokens of prompt and candidate; longer ones are not scored."""

    target_language: str | None = None
    max_length: int = 4096
    limit: int | None = None
    dry_run: bool = False

    def __post_init__(self) -> None:
        _positive(max_length=self.max_length, limit=self.limit)


@dataclass(frozen=True)
class Training:
    """Columns are 1-based places in the four-column file. Without a learning rate it is 1e-4 for sft and 5e-6 for the others."""

    method: str
    src_col: int = 1
    tgt_col: int | None = None
    chosen_col: int | None = None
    rejected_col: int | None = None
    max_length: int = 2048
    max_new_tokens: int = 512
    learning_rate: float | None = None
    micro_batch_size: int = 1
    gradient_accumulation_steps: int = 16
    epochs: float = 1
    eval_steps: int = 100
    eval_batch_size: int = 1
    logging_steps: int = 10
    warmup_ratio: float = 0.03
    lora_rank: int = 16
    lora_alpha: int = 32
    lora_dropout: float = 0.05
    dpo_beta: float = 0.1
    cpo_beta: float = 0.1
    cpo_alpha: float = 1.0

    def __post_init__(self) -> None:
        if self.method not in ("sft", "dpo", "cpo"):
            raise ValueError("method is sft, dpo or cpo")
        needed = [self.tgt_col] if self.method == "sft" else [self.chosen_col, self.rejected_col]
        if None in needed or not {self.src_col, *needed} <= {1, 2, 3, 4}:
            raise ValueError(f"{self.method} needs its columns, from 1 to 4")
        if len(needed) > len(set(needed)):
            raise ValueError("chosen_col and rejected_col must differ")
        if self.learning_rate is None:
            object.__setattr__(self, "learning_rate", 1e-4 if self.method == "sft" else 5e-6)
        numbers = "micro_batch_size gradient_accumulation_steps epochs max_length max_new_tokens eval_steps eval_batch_size logging_steps lora_rank lora_alpha learning_rate dpo_beta cpo_beta"
        _positive(**{n: getattr(self, n) for n in numbers.split()})
        if self.max_new_tokens >= self.max_length or self.cpo_alpha < 0 or not 0 <= self.lora_dropout < 1 or not 0 <= self.warmup_ratio <= 1:
            raise ValueError("max_new_tokens must be below max_length, cpo_alpha not negative, dropout and warm-up within 0 and 1")

    def answers(self) -> list[int]:
        return [self.tgt_col] if self.method == "sft" else [self.chosen_col, self.rejected_col]


@dataclass(frozen=True)
class Evaluation:
    """max_length counts the prompt and the reserved new tokens."""

    max_length: int = 2048
    max_new_tokens: int = 512
    batch_size: int = 1

    def __post_init__(self) -> None:
        _positive(max_length=self.max_length, max_new_tokens=self.max_new_tokens, batch_size=self.batch_size)
        if self.max_new_tokens >= self.max_length:
            raise ValueError("max_new_tokens must be below max_length")
