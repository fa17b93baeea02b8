"""Options of the engine, checked once."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    data_root: str = "data"
    ocr_languages: str = "eng+rus"
    ocr_enabled: bool = True
    ocr_command: str = "ocrmypdf"
    ocr_timeout_seconds: int = 900
    chunk_target_chars: int = 4500
    chunk_overlap_chars: int = 600
    default_top_k: int = 10

    def __post_init__(self) -> None:
        for name, least in (("ocr_timeout_seconds", 1), ("chunk_target_chars", 1000), ("chunk_overlap_chars", 0), ("default_top_k", 1)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}")
