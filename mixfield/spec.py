"""Model description: factors, contrasts, filters and solver settings."""

from __future__ import annotations

import ast
import json
from dataclasses import asdict, dataclass, field, replace

import numpy as np

METHODS = ("pSFS", "SFS", "pFS", "FS", "cSFS")


def parse_contrast(text) -> list[list[float]]:
    """Rows of a contrast from a list or from text with commas or spaces; nothing is evaluated."""
    if isinstance(text, str):
        body = text.strip()
        if "," not in body:
            body = body.replace("] [", "],[").replace("]\n[", "],[")
            body = ",".join(body.split())
        if not body.startswith("["):
            body = f"[{body}]"
        text = ast.literal_eval(body)
    rows = np.array(text, dtype=float)
    return np.atleast_2d(rows).tolist()


@dataclass(frozen=True)
class Contrast:
    """One row is a T contrast, more rows an F contrast."""

    name: str
    rows: list[list[float]]
    f: bool | None = None

    @classmethod
    def of(cls, name: str, vector) -> Contrast:
        """From a list or text: one vector is a T contrast, a matrix (of one row too) an F contrast."""
        depth = np.ndim(vector) if not isinstance(vector, str) else 2 if "[" in vector.strip()[1:] else 1
        return cls(name, parse_contrast(vector), depth == 2)

    @property
    def kind(self) -> str:
        return "F" if (self.f if self.f is not None else len(self.rows) > 1) else "T"


@dataclass(frozen=True)
class Factor:
    """A grouping column (level of each observation) and its number of effects."""

    name: str
    effects: int = 1


@dataclass(frozen=True)
class ModelSpec:
    p: int
    factors: list[Factor]
    contrasts: list[Contrast] = field(default_factory=list)
    method: str = "pSFS"
    reml: bool = True
    tol: float = 1e-6
    max_iterations: int = 10_000
    data_mask_thresh: float | None = None
    min_percent: float | None = None
    min_n: int | None = None
    safe_mode: bool = True
    output_cov: bool = True
    min_log: float = -323.3062153431158
    floor: float = 0.0  # least eigenvalue of a covariance
    polish: int = 0  # scoring steps made after convergence
    blocks: int | None = None  # tasks that voxels are dealt to

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"method is one of {METHODS}")
        if self.min_percent is not None and not 0 <= self.min_percent <= 1:
            raise ValueError("min_percent lies in [0, 1]")
        for c in self.contrasts:
            rows = np.array(c.rows)
            if rows.shape[1] != self.p:
                raise ValueError(f"contrast {c.name} has {rows.shape[1]} columns, not {self.p}")
            if c.kind == "F" and np.linalg.matrix_rank(rows) < len(rows):
                raise ValueError(f"F contrast {c.name} is not of full row rank")

    @classmethod
    def of(cls, config: dict) -> ModelSpec:
        """From a plain dict (a parsed YAML or JSON file)."""
        pct = config.get("min_percent")
        if isinstance(pct, str):
            pct = float(pct.strip().rstrip("%")) / (100 if "%" in pct else 1)
        known = {k: v for k, v in config.items() if k in cls.__dataclass_fields__}
        known |= {"factors": [Factor(**f) if isinstance(f, dict) else f for f in config["factors"]], "contrasts": [Contrast.of(c["name"], c["vector"]) for c in config.get("contrasts", [])], "min_percent": pct}
        for k in ("tol", "min_log"):
            if k in known:
                known[k] = float(known[k])
        return cls(**known)

    @classmethod
    def load(cls, path: str) -> ModelSpec:
        return cls.of(read_config(path))

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    def but(self, **changes) -> ModelSpec:
        return replace(self, **changes)

    @property
    def effects(self) -> list[int]:
        return [f.effects for f in self.factors]

    @property
    def n_variance(self) -> int:
        """Distinct elements of all factors' covariances."""
        return sum(q * (q + 1) // 2 for q in self.effects)


def read_config(path: str) -> dict:
    """A YAML or JSON file."""
    with open(path) as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def factor_columns(k: int, levels: list[int], effects: list[int]) -> range:
    """Columns of Z that belong to factor k."""
    start = sum(a * b for a, b in zip(levels[:k], effects[:k], strict=True))
    return range(start, start + levels[k] * effects[k])


def level_columns(k: int, j: int, levels: list[int], effects: list[int]) -> range:
    """Columns of Z that belong to level j of factor k."""
    start = factor_columns(k, levels, effects).start + j * effects[k]
    return range(start, start + effects[k])
