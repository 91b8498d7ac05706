"""Options of the inspecting and cleaning functions, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1 << 20


@dataclass(frozen=True)
class TextOptions:
    """Which invisible characters cleaning removes, and whether typography is normalised first."""

    strip_zero_width: bool = True
    strip_zero_width_joiner: bool = False
    strip_bidi_controls: bool = True
    strip_unicode_tags: bool = True
    strip_variation_selectors: bool = True
    normalize_typography: bool = False


@dataclass(frozen=True)
class InspectTextOptions:
    """style adds the writing-style lint; families, where given, limits the passes to those named."""

    style: bool = False
    families: tuple[str, ...] | None = None


@dataclass(frozen=True)
class FileLimits:
    """Most bytes of an input file; None lifts a limit."""

    image: int | None = 256 * MIB
    ooxml: int | None = 256 * MIB
    pdf: int | None = 256 * MIB
    media: int | None = 256 * MIB
    text: int | None = 256 * MIB


@dataclass(frozen=True)
class ImageOptions:
    max_input_bytes: int | None = 256 * MIB
    max_dimension: int | None = 12_000
    max_alloc_bytes: int | None = 512 * MIB
    #: Format to write (png, bmp, tiff or gif), if not that of the input.
    output_format: str | None = None
    upscale: float = 1.0
    enhance: bool = False
    fingerprint_reset: bool = False
    strength: int = 2
    fraction: float = 0.25
    seed: int = 0


@dataclass(frozen=True)
class ZipLimits:
    max_input_bytes: int | None = 256 * MIB
    max_entries: int = 10_000
    max_entry_bytes: int = 256 * MIB
    max_total_bytes: int = 1024 * MIB


@dataclass(frozen=True)
class PdfLimits:
    max_input_bytes: int | None = 256 * MIB
    max_stream_bytes: int = 256 * MIB
