"""Run parameters and the fixed values the results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values -----------------------------------------------------------
# Quality profile
MAX_PHRED = 41                    # report rows are Q 0..41
MAX_QUALITY_CODE = 126            # raw character codes 0..126
QUALITY_CUTOFF_SHARE = 0.05       # cumulative share that sets the low cutoff
EXTREMELY_LOW_SHARE = 0.01        # cumulative share that sets the second one
EXTREMELY_LOW_WARN_SHARE = 0.06   # warn if the second share is already this big
# Phred offset limits: (last minimum of the +33 band, largest maximum there,
# last minimum of the undecided band, largest maximum that still means +33)
PHRED_LIMITS = {
    "paired": (58, 78, 75, 75),
    "single": (58, 74, 74, 74),
    "single76": (58, 76, 74, 76),
}
# k-mer spectrum
MIN_KMER_LENGTH = 10
MAX_KMER_LENGTH = 255
MIN_COUNT = 2
MAX_THRESHOLD = 65535
HISTOGRAM_TOP = 255               # last bucket saturates
PACKED_MAX_K = 31                 # k-mers up to here fit a bigint, 2 bits a base
# Membership filter
WIDTH_SLACK = 1.2                 # accept a filter this much larger for fewer hashes
# Read gating
MAX_N_SHARE_PCT = 10              # percent of N allowed
MIN_KEPT_BASES = 30
MAX_TRIM_SHARE_PCT = 60
CHECK_RANGE_PCT = 7
MAX_EDIT_SHARE_PCT = 25
# Solid regions
MIN_SOLID_LENGTH = 2
FP_SUSPECT_LENGTH = 1
ADJUST_RANGE = 4
# Path search
MAX_PATHS = 74
ALLOWED_FAILS = 2
MAX_EDITS_IN_WINDOW = 4
MIN_QUALITY_GAP = 10
LOW_BASES_IN_COMBOS = 3
BASES = "ACGT"
# -----------------------------------------------------------------------------

#: Most bytes that a 32-bit hash addresses. Up to here a filter is shipped to the
#: executors; a larger one has parts, and tests move to the parts.
PART_BYTES = 512 * 1024 * 1024
#: Up to here k-mers are shipped; more are joined. Executors map the file, they do not hold it.
SHIP_BYTES = 2 * 1024 * 1024 * 1024


class ConfigError(ValueError):
    """A parameter is out of range."""


class InputError(ValueError):
    """The reads cannot be processed as given."""


@dataclass(frozen=True)
class RunConfig:
    """Parameters of one correction run."""

    k: int
    prefix: str = "out"
    threshold: int | None = None   # None: take the valley of the histogram
    fpr: float = 0.001
    seed: int = 0
    max_extension: int = 5
    trim: bool = True
    paired: bool = True
    gzip: bool = False
    phred_rule: str | None = None  # None: by `paired`
    compat: str = "intended"
    part_bytes: int = PART_BYTES
    membership: str = "filter"     # or "exact": the solid k-mers themselves

    def __post_init__(self) -> None:
        if not MIN_KMER_LENGTH <= self.k <= MAX_KMER_LENGTH:
            raise ConfigError(
                f"k must be in {MIN_KMER_LENGTH}..{MAX_KMER_LENGTH}, got {self.k}")
        if not self.prefix:
            raise ConfigError("an output prefix is required")
        if self.threshold is not None and not MIN_COUNT <= self.threshold <= MAX_THRESHOLD:
            raise ConfigError(f"count threshold must be in {MIN_COUNT}..{MAX_THRESHOLD}")
        if not 0 < self.fpr <= 1:
            raise ConfigError("the false positive rate must be in (0, 1]")
        if self.max_extension < 1:
            raise ConfigError("the extension must be at least 1")
        if self.compat not in ("intended", "scalar"):
            raise ConfigError("compat must be 'intended' or 'scalar'")
        if self.membership not in ("filter", "exact"):
            raise ConfigError("membership must be 'filter' or 'exact'")
        if self.part_bytes < 1:
            raise ConfigError("a part of the filter has at least one byte")
        if self.rule not in PHRED_LIMITS:
            raise ConfigError(f"unknown phred rule {self.rule}")

    @property
    def rule(self) -> str:
        return self.phred_rule or ("paired" if self.paired else "single")


@dataclass(frozen=True)
class QualityProfile:
    """Scalars derived from the quality histogram."""

    offset: int
    cutoff: int
    extremely_low: int
    total_bases: int
    warnings: tuple[str, ...] = ()
