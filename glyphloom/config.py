"""The configuration of a dataset run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class GenerationConfig:
    """Paths, sizes and probabilities of a run; every draw follows from ``seed``.

    ``num_workers`` is the least number of partitions of the rendering stage; ``queue_maxsize`` has no meaning here and is
    accepted for compatibility.
    """

    wordlist_path: str
    font_dir: str
    output_dir: str
    num_images: int
    bg_image_dir: str | None = None
    val_percent: float = 0.2
    num_workers: int = 4
    font_size_range: tuple[int, int] = (18, 35)
    padding: int = 4
    max_attempts: int = 5
    queue_maxsize: int = 100
    bold_prob: float = 0.5
    rotation_prob: float = 0.6
    blur_prob: float = 0.3
    perspective_prob: float = 0.5
    rotation_range: tuple[float, float] = (-2.0, 2.0)
    blur_radius_range: tuple[float, float] = (0.3, 1.0)
    perspective_margin: int = 2
    seed: int = 0

    def __post_init__(self) -> None:
        if not 0 <= self.val_percent <= 1:
            raise ValueError("val_percent must lie between 0 and 1")
        if self.max_attempts < 1:
            raise ValueError("max_attempts must be 1 or more")
        if self.num_images < 0:
            raise ValueError("num_images must not be negative")
