"""Job parameters and the peak finders they choose from."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame

from lumenpeak.functions import constants as K
from lumenpeak.functions.lines import check_try_lines
from lumenpeak.operators.continuum import find_broken_power_law_peaks, find_power_law_peaks
from lumenpeak.operators.peaks import find_peaks

MODES = ("training", "test", "operation", "candidates", "merge", "merge_training", "merge_test",
         "merge_operation")


@dataclass(frozen=True)
class PeakFinder:
    """pixels, **options -> (SPECID, pix, wave, significance), with option defaults."""

    find: Callable[..., DataFrame]
    defaults: dict[str, float]


PEAK_FINDERS: dict[str, PeakFinder] = {
    "smoothing": PeakFinder(find_peaks, {
        "width": K.PEAK_WIDTH, "min_significance": K.PEAK_MIN_SIGNIFICANCE}),
    "power_law": PeakFinder(find_power_law_peaks, {
        "min_significance": K.POWER_LAW_MIN_SIGNIFICANCE}),
    "broken_power_law": PeakFinder(find_broken_power_law_peaks, {
        "min_significance": K.POWER_LAW_MIN_SIGNIFICANCE}),
}


def register_peak_finder(name: str, find: Callable[..., DataFrame],
                         defaults: dict[str, float]) -> None:
    """Add a peak finder of one's own."""
    PEAK_FINDERS[name] = PeakFinder(find, dict(defaults))


def peak_finder(name: str, options: dict | None = None) -> Callable[[DataFrame], DataFrame]:
    """The named finder with its options checked and defaults filled in."""
    if name not in PEAK_FINDERS:
        raise ValueError(f"unknown peak finder {name!r}, expected one of {sorted(PEAK_FINDERS)}")
    finder = PEAK_FINDERS[name]
    unknown = set(options or {}) - set(finder.defaults)
    if unknown:
        raise ValueError(f"unknown options {sorted(unknown)} for peak finder {name!r}, "
                         f"accepted are {sorted(finder.defaults)}")
    chosen = {**finder.defaults, **(options or {})}
    return lambda pixels: finder.find(pixels, **chosen)


@dataclass(frozen=True)
class JobParams:
    """Everything a job can be told; stored next to a trained model."""

    mode: str = "training"
    lines: tuple = K.LINES
    try_lines: tuple[str, ...] = K.TRY_LINES
    num_pixels: int = K.NUM_PIXELS
    pixels_as_metrics: bool = False
    prob_cut: float = 0.0
    save_catalogue: bool = False
    z_precision: float = K.REDSHIFT_TOLERANCE
    peak_finder: str = "smoothing"
    peak_finder_options: dict = field(default_factory=dict)
    extra_features: tuple[str, ...] = ()
    split: bool = True
    num_trees: int = K.NUM_TREES
    max_depth: int = K.MAX_DEPTH
    # side (high, low or all) -> its own num_trees or max_depth
    forest_options: dict = field(default_factory=dict)
    seed: int = K.RANDOM_STATE
    report_cuts: tuple[float, ...] = tuple(K.REPORT_CUTS)
    run_stats: bool = True

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"invalid mode {self.mode!r}, expected one of {MODES}")
        if self.num_pixels <= 0:
            raise ValueError("num_pixels must be greater than 0")
        if self.prob_cut < 0:
            raise ValueError("prob_cut must not be negative")
        if self.z_precision <= 0:
            raise ValueError("z_precision must be greater than 0")
        for side, options in self.forest_options.items():
            if side not in ("high", "low", "all") or set(options) - {"num_trees", "max_depth"}:
                raise ValueError(f"invalid forest options {options} for {side!r}")
        check_try_lines(self.try_lines, self.lines)
        peak_finder(self.peak_finder, self.peak_finder_options)

    @property
    def truth_needed(self) -> bool:
        return "training" in self.mode or "test" in self.mode

    def adopting(self, trained: "JobParams") -> "JobParams":
        """These parameters with the candidate, peak finder and model settings of a model."""
        return replace(trained, mode=self.mode, report_cuts=self.report_cuts,
                       run_stats=self.run_stats)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "JobParams":
        data = json.loads(text)
        data["lines"] = tuple(tuple(line) for line in data["lines"])
        for name in ("try_lines", "extra_features", "report_cuts"):
            data[name] = tuple(data[name])
        return cls(**data)
