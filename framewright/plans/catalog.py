"""All registered queries of the library, and their SQL: importing an operator module registers its queries."""

from ..operators import benchmark, consolidate, evaluate, evidence, findings, frames, jobs, keyframes, pixels, policy, scenes, temporal  # noqa: F401
from ..sources import scans  # noqa: F401
from ..streaming import queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
