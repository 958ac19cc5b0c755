"""A study of images, described by one file: lists of images and masks, designs, contrasts.

Keys: Y_files (a text file, one image per line), X (a table without names), Z (a list of one-entry
maps, each with name, factor and design files), contrasts (likewise, with name and vector),
outdir; and, if wanted, analysis_mask, data_mask_files, data_mask_thresh, Missingness
(MinPercent or MinN), method, tol, maxnit, safeMode, OutputCovB, minlog, MAXMEM (bytes of the
statistics that one task may hold).  Numbers may be given
as text and are parsed, never evaluated.  Relative paths count from the file's folder.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.masking import block_count
from ..plans import model
from ..spec import Contrast, Factor, ModelSpec, read_config
from . import files


@dataclass
class Study:
    spec: ModelSpec
    images: list[str]
    masks: list[str] | None
    analysis_mask: str | None
    x: str
    factors: list[tuple[str, str]]
    out: str
    max_memory: float = 2.0**32


def _number(value) -> float:
    """A number, or text of one (powers written as a**b too)."""
    if not isinstance(value, str):
        return float(value)
    base, _, power = value.partition("**")
    return float(base) ** float(power) if power else float(base)


def read(path: str) -> Study:
    config, folder = read_config(path), os.path.dirname(os.path.abspath(path))

    def at(p: str) -> str:
        return p if "://" in p or os.path.isabs(p) else os.path.join(folder, p)

    def lines(key: str) -> list[str] | None:
        if not config.get(key):
            return None
        with open(at(config[key])) as f:
            return [at(line.strip()) for line in f if line.strip()]

    images, masks = lines("Y_files"), lines("data_mask_files")
    if not images:
        raise ValueError("Y_files names no image")
    if masks is not None and len(masks) != len(images):
        raise ValueError(f"{len(masks)} data masks for {len(images)} images")
    z = [next(iter(f.values())) for f in config["Z"]]
    x = at(config["X"])
    with open(x) as f:
        p = files.table(f.read())
    p = p.shape[1] if p.ndim == 2 else 1
    widths = []
    for f in z:
        with open(at(f["design"])) as g:
            t = files.table(g.read())
        widths.append(t.shape[1] if t.ndim == 2 else 1)
    least = {k.lower(): v for k, v in (config.get("Missingness") or {}).items()}
    percent = least.get("minpercent")
    if isinstance(percent, str):
        percent = float(percent.strip().rstrip("%")) / (100 if "%" in percent else 1)
    given = {
        "method": config.get("method"), "tol": config.get("tol"), "max_iterations": config.get("maxnit"), "data_mask_thresh": config.get("data_mask_thresh"),
        "min_percent": percent, "min_n": least.get("minn"), "min_log": config.get("minlog"),
    }
    given = {k: v if k == "method" else int(_number(v)) if k in ("max_iterations", "min_n") else _number(v) for k, v in given.items() if v is not None}
    given |= {k: bool(int(config[c])) for k, c in (("safe_mode", "safeMode"), ("output_cov", "OutputCovB")) if c in config}
    contrasts = [Contrast.of(c["name"], c["vector"]) for c in (next(iter(x.values())) for x in config.get("contrasts") or [])]
    spec = ModelSpec(p, [Factor(f["name"], n) for f, n in zip(z, widths, strict=True)], contrasts, **given)
    mask = config.get("analysis_mask")
    return Study(spec, images, masks, at(mask) if mask else None, x, [(at(f["factor"]), at(f["design"])) for f in z], at(config["outdir"]), _number(config.get("MAXMEM", 2**32)))


def _shape(spark: SparkSession, path: str, voxels: int) -> tuple[tuple[int, ...], bytes | None]:
    """Shape and header of an image; other formats are one long row."""
    if not path.lower().endswith((".nii", ".nii.gz")):
        return (voxels,), None
    raw = spark.read.format("binaryFile").load(path).select("content").first()[0]
    image, header = files.decode_nifti(bytes(raw))
    return image.shape, header or None


def fit(spark: SparkSession, study: Study) -> tuple[DataFrame, list[str]]:
    """The fits (written to the study's folder) and the files of their maps."""
    spec = study.spec
    obs = files.images(spark, study.images)
    sizes = obs.groupBy("obs_id").agg(F.count("*").alias("n")).agg(F.min("n"), F.max("n"), F.count("*")).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"images have from {sizes[0]} to {sizes[1]} voxels")
    design = files.design(spark, study.x, study.factors)
    if design.count() != len(study.images):
        raise ValueError(f"{design.count()} design rows for {len(study.images)} images")
    masks = files.images(spark, study.masks).withColumnRenamed("y", "m") if study.masks else None
    inside = files.images(spark, [study.analysis_mask]).where("y <> 0").select("voxel_id") if study.analysis_mask else None
    # voxels are dealt to all tasks, and to more where their statistics take more memory
    levels = design.agg(*[F.countDistinct(f"f_{k}") for k in range(1, len(spec.factors) + 1)]).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spec = spec.but(blocks=max(tasks, block_count(sizes[0], list(levels), spec.effects, spec.p, study.max_memory)))
    stats = model.statistics(obs, design, spec, masks, inside)
    os.makedirs(study.out, exist_ok=True)
    model.fit(stats, spec).write.mode("overwrite").parquet(f"{study.out}/fit")
    fits = spark.read.parquet(f"{study.out}/fit")
    shape, header = _shape(spark, study.images[0], sizes[0])
    if int(np.prod(shape)) != sizes[0]:
        raise ValueError("images of several volumes are not fitted")
    with open(f"{study.out}/spec.json", "w") as f:
        f.write(spec.to_json())
    return fits, files.write_maps(fits, spec, shape, f"{study.out}/maps", header)
