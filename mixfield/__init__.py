"""Linear mixed models over many response columns, in Spark."""

from .plans.model import compare, fit, results, statistics
from .spec import Contrast, Factor, ModelSpec

__all__ = ["Contrast", "Factor", "ModelSpec", "compare", "fit", "results", "statistics"]
