"""The settings that change results, validated when made."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Application:
    name: str
    source_root: str
    nested_roots: tuple[str, ...] = ()


@dataclass(frozen=True)
class Weights:
    """Terms of a candidate's score; the defaults are fixed values."""

    line_count: float = 1.0
    file: float = 5.0
    consumer: float = 10.0
    test_coverage: float = 50.0
    prerequisite: float = -12.0
    rejection: float = -1000.0
    rewrite_escape: float = -100.0
    domain_crossing: float = -500.0
    runtime_crossing: float = -300.0
    retained_edge: float = -250.0


@dataclass(frozen=True)
class Config:
    applications: tuple[Application, ...] = ()
    package_roots: tuple[str, ...] = ("libs",)
    first_party_packages: tuple[str, ...] = ()
    domains: tuple[tuple[str, str], ...] = ()
    test_patterns: tuple[tuple[str, str], ...] = (("unit", r"\.(test|spec)\.[cm]?[jt]sx?$"),)
    source_extensions: tuple[str, ...] = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs")
    asset_extensions: tuple[str, ...] = (".css", ".svg", ".png", ".json")
    composition_paths: tuple[str, ...] = ()
    composition_patterns: tuple[str, ...] = ()
    retained_roots: tuple[str, ...] = ()
    protected_paths: tuple[str, ...] = ()
    scope: str | None = None
    min_files: int = 2
    max_files: int = 120
    hub_threshold: int = 12
    similarity: float = 0.8
    generic_segments: tuple[str, ...] = ("root", "components", "src", "shared", "common", "utils")
    framework_packages: tuple[str, ...] = ()
    compatibility_shim_min_inbound: int = 5
    max_recommended_files: int | None = None
    max_recommended_lines: int | None = None
    high_inbound: int = 12
    high_fan_out: int = 8
    fan_in_action: int = 8
    fan_out_action: int = 8
    weights: Weights = field(default_factory=Weights)

    def __post_init__(self) -> None:
        for name, pattern in (*self.domains, *self.test_patterns):
            if re.search(r"\(\?<[=!]|\(\?P", pattern):
                raise ValueError(f"{name}: lookbehind and named groups aren't portable between regular expression engines")
            re.compile(pattern)
        if not 0 < self.similarity <= 1:
            raise ValueError("similarity must be above 0 and at most 1")
        if self.min_files > self.max_files:
            raise ValueError("min_files exceeds max_files")
        roots = sorted(self.first_party_packages)
        for a, b in zip(roots, roots[1:], strict=False):
            if b == a or b.startswith(a + "/"):
                raise ValueError(f"first-party package roots overlap: {a}, {b}")
