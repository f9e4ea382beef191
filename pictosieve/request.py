"""What a caller asks for: a scan, and a view of its result."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Extensions of images that are scanned if none are asked for.
SUPPORTED = (
    ".jpg", ".jpeg", ".png", ".tiff", ".tif", ".bmp", ".webp", ".gif", ".dng", ".arw",
    ".cr2", ".cr3", ".nef", ".orf", ".rw2", ".raf", ".psd", ".emf",
)


@dataclass(frozen=True)
class ScanRequest:
    """Bounds of 0 are no bounds; ``threshold`` is a number of differing bits."""

    path: str
    threshold: int = 10
    algorithm: str = "dhash"
    extensions: tuple[str, ...] = ()
    include_subfolders: bool = True
    min_file_size: int = 0
    max_file_size: int = 0
    min_width: int = 0
    max_height: int = 0
    extra_paths: tuple[str, ...] = ()
    include_series: bool = True

    @classmethod
    def of(cls, path: str, **more: object) -> ScanRequest:
        """From what a user typed: roots may be several, separated by semicolons; odd values fall back."""
        roots = [p.strip() for p in path.split(";")]
        extra = tuple(p for p in (*roots[1:], *more.pop("extra_paths", ())) if p)
        threshold = int(more.pop("threshold", 0) or 0)
        algorithm = str(more.pop("algorithm", "") or "dhash")
        return cls(roots[0], threshold if threshold > 0 else 10, "phash" if algorithm == "phash" else "dhash", extra_paths=extra, **more)

    @property
    def roots(self) -> tuple[str, ...]:
        return (self.path, *self.extra_paths)

    @property
    def wanted(self) -> tuple[str, ...]:
        """Extensions with their dot, lower-case."""
        asked = tuple("." + e.strip().lower().lstrip(".") for e in self.extensions if e.strip())
        return asked or SUPPORTED


@dataclass(frozen=True)
class FilterSpec:
    """How a result is narrowed; None is no bound."""

    max_diff: float | None = None
    filename: str = ""
    extensions: tuple[str, ...] = ()
    min_size: int | None = None
    max_size: int | None = None
    min_group: int | None = None
    max_group: int | None = None
    folder: str | None = None


@dataclass(frozen=True)
class SortSpec:
    """Groups by ``diff`` or images within their group by another key."""

    key: str = "diff"
    descending: bool = False
    keys: tuple[str, ...] = field(default=("name", "path", "dim", "ext", "size", "block", "blur"), repr=False)
