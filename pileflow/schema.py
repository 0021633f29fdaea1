"""Schemas and run options."""

from __future__ import annotations

from dataclasses import dataclass, field

READS = "rname string, pos int, flag int, mapq int, l_qseq int, mate_rname string, isize int, cigar string"
REGIONS = "chrom string, start int, stop int"
CHROMS = "tid int, name string, length bigint"


@dataclass(frozen=True)
class Options:
    """Defaults are those of the depth tool's command line.

    ``compat`` keeps historical quirks (start clamped to 1, flank not clipped, medians one off);
    ``refskip`` says whether a CIGAR ``N`` moves the position ("advance") or not ("stay").
    """

    flank: int = 200
    mapq: int = 20
    isize_limit: int = 2000
    uncover: int = 5
    cutoffs: tuple[int, ...] = ()
    ratios: tuple[float, ...] = (0.2, 0.5)
    one_based: bool = False
    compat: bool = False
    refskip: str = "stay"
    flank_exclude_target: bool = False
    thresholds: tuple[int, ...] = field(default=(4, 10, 30, 100))

    def __post_init__(self) -> None:
        if self.uncover <= 0:
            raise ValueError("uncover must be positive")
        if len(self.cutoffs) > 10 or len(self.ratios) > 10:
            raise ValueError("at most 10 cutoffs and 10 ratios")
        if any(not 0 < r <= 1 for r in self.ratios):
            raise ValueError("ratios lie in (0, 1]")
        if self.flank < 0 or any(c < 0 for c in self.cutoffs):
            raise ValueError("flank and cutoffs can't be negative")
        if self.refskip not in ("stay", "advance"):
            raise ValueError("refskip is 'stay' or 'advance'")
