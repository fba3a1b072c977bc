"""Settings of a run, checked once on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from corpusforge import fixed_values as fixed

MODES = ("extract-only", "generate", "full", "direct_to_llm", "resume", "analyze")


@dataclass(frozen=True)
class Settings:
    mode: str = "extract-only"
    output_dir: str = "output"
    output_format: str = "jsonl"
    max_file_size: int = fixed.MAX_FILE_BYTES
    start_page: int = 1
    end_page: int | None = None
    skip_pages: tuple[int, ...] = ()
    min_image_size: int = fixed.MIN_IMAGE_AREA
    min_text_length: int = fixed.MIN_TEXT_LENGTH
    skip_single_color_images: bool = False
    header_regex: str = ""
    quality_threshold: float = fixed.QUALITY_THRESHOLD
    use_ocr: bool = True
    chunk_size: int = fixed.CHUNK_SIZE
    overlap: int = fixed.CHUNK_OVERLAP
    text_generators: tuple[str, ...] = tuple(fixed.GENERATORS)
    media_generators: tuple[str, ...] = tuple(fixed.MEDIA_GENERATORS)
    prompt_style: str = "default"
    custom_prompts: dict[str, str] = field(default_factory=dict)
    provider: str = "openai"
    model: str = "gpt-4o"
    batch_size: int = fixed.BATCH_SIZE
    timeout: int = 300
    threads: int = 4
    max_workers: int = 4
    known_generators: tuple[str, ...] = tuple(fixed.GENERATORS + fixed.MEDIA_GENERATORS)

    def __post_init__(self) -> None:
        errors = self.problems()
        if errors:
            raise ValueError("; ".join(errors))

    def problems(self) -> list[str]:
        """Everything wrong with the settings, as messages."""
        checks = [
            (self.mode in MODES, f"unknown mode: {self.mode}"),
            (self.start_page >= 1, f"start_page must be at least 1, got {self.start_page}"),
            (self.end_page is None or self.end_page >= self.start_page, "end_page must not be before start_page"),
            (1 <= self.threads <= 64, f"threads must be between 1 and 64, got {self.threads}"),
            (1 <= self.max_workers <= 32, f"max_workers must be between 1 and 32, got {self.max_workers}"),
            (self.min_image_size >= 0, "min_image_size must not be negative"),
            (self.min_text_length >= 0, "min_text_length must not be negative"),
            (0.0 <= self.quality_threshold <= 1.0, "quality_threshold must be between 0 and 1"),
            (self.chunk_size >= 100, f"chunk_size must be at least 100, got {self.chunk_size}"),
            (0 <= self.overlap and 2 * self.overlap <= self.chunk_size, "overlap must be at most half of chunk_size"),
            (self.timeout >= 10, f"timeout must be at least 10 seconds, got {self.timeout}"),
            (self.provider != "local" or bool(self.model), "the local provider needs a model"),
        ]
        unknown = [g for g in (*self.text_generators, *self.media_generators) if g not in self.known_generators]
        return [message for fine, message in checks if not fine] + [f"unknown generator: {g}" for g in unknown]

    def extraction_facts(self) -> dict:
        """The settings that change an extraction, and so belong to its cache key."""
        return {
            "start_page": self.start_page,
            "end_page": self.end_page,
            "skip_pages": ",".join(map(str, self.skip_pages)),
            "min_image_size": self.min_image_size,
            "min_text_length": self.min_text_length,
            "header_regex": self.header_regex,
            "skip_single_color_images": self.skip_single_color_images,
            "use_ocr": self.use_ocr,
            "quality_threshold": self.quality_threshold,
        }

    @classmethod
    def of(cls, **values) -> "Settings":
        names = {f.name for f in fields(cls)}
        unknown = set(values) - names
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**values)
