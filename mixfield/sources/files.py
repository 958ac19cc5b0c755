"""Images and design files: NIfTI, NumPy, raw and delimited text, read and written.

Images are read with Spark's binaryFile source, so any store will do, and decoded one file
at a time in Arrow batches.  Row i of the list of images is row i of the designs.
"""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import ModelSpec

#: NIfTI-1 data type codes (fixed values of the format).
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def decode_nifti(raw: bytes) -> tuple[np.ndarray, bytes]:
    """(values in file order reshaped to the image's shape, header) of a NIfTI file, version 1 or 2
    (a header of the latter is given as none: maps are written as version 1)."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    sizes = {o: struct.unpack_from(f"{o}i", raw)[0] for o in "<>"} if len(raw) >= 348 else {}
    for order in (o for o, size in sizes.items() if size == 540):
        dims, code, start = struct.unpack_from(f"{order}8q", raw, 16), struct.unpack_from(f"{order}h", raw, 12)[0], struct.unpack_from(f"{order}q", raw, 168)[0]
        return _scaled(raw, order, dims[1 : 1 + dims[0]], code, start, *struct.unpack_from(f"{order}2d", raw, 176)), b""
    order = next((o for o, size in sizes.items() if size == 348), None)
    if order is None:
        raise ValueError("not a NIfTI file: its header is neither 348 nor 540 bytes long")
    if raw[344:347] == b"ni1":
        raise ValueError("an image whose header is a file of its own is not read; join them into one .nii")
    dims = struct.unpack_from(f"{order}8h", raw, 40)
    code, start = struct.unpack_from(f"{order}h", raw, 70)[0], int(struct.unpack_from(f"{order}f", raw, 108)[0])
    slope, inter = struct.unpack_from(f"{order}2f", raw, 112)
    return _scaled(raw, order, dims[1 : 1 + dims[0]], code, start, slope, inter), raw[:348]


def _scaled(raw: bytes, order: str, shape: tuple, code: int, start: int, slope: float, inter: float) -> np.ndarray:
    data = np.frombuffer(raw, f"{order}{NIFTI_TYPES[code]}", int(np.prod(shape)), start).astype(float)
    if slope not in (0.0, 1.0) or (slope and inter):
        data = data * slope + inter
    return data.reshape(shape, order="F")


def encode_nifti(image: np.ndarray, header: bytes | None = None) -> bytes:
    """A NIfTI-1 file of float64 values; affine and units come from ``header``."""
    head = bytearray(header or struct.pack("<i", 348).ljust(348, b"\0"))
    order = "<" if struct.unpack_from("<i", head)[0] == 348 else ">"
    struct.pack_into(f"{order}8h", head, 40, image.ndim, *image.shape, *[1] * (7 - image.ndim))
    struct.pack_into(f"{order}2h", head, 70, 64, 64)
    struct.pack_into(f"{order}3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    return bytes(head) + b"\0" * 4 + image.astype(f"{order}f8").tobytes(order="F")


def decode(path: str, raw: bytes, dtype: str = "f4") -> np.ndarray:
    """Values of an image in C order, by the kind of file."""
    name = path.lower()
    if name.endswith((".nii", ".nii.gz", ".img")):
        return decode_nifti(raw)[0].ravel()
    if name.endswith(".npy"):
        return np.load(io.BytesIO(raw), allow_pickle=False).astype(float).ravel()
    if name.endswith(".dat"):
        return np.frombuffer(raw, dtype).astype(float)
    if name.endswith((".csv", ".tsv", ".txt")):
        return table(raw.decode(), "\t" if name.endswith(".tsv") and b"\t" in raw else ",").ravel()
    raise ValueError(f"no reader for {path}")


def table(text: str, sep: str = ",") -> np.ndarray:
    """Numbers of a delimited text; a leading header row and label column are left out."""
    rows = [r.split(sep) if sep in r else r.split() for r in text.strip().splitlines() if r.strip()]

    def number(x: str) -> bool:
        try:
            float(x)
        except ValueError:
            return False
        return True

    if rows and not all(number(x) for x in rows[0][1:] or rows[0]):
        rows = rows[1:]
    if rows and len(rows[0]) > 1 and not number(rows[0][0]):
        rows = [r[1:] for r in rows]
    return np.array(rows, dtype=float)


def _qualified(spark: SparkSession, path: str) -> str:
    """The full path by which Spark's readers name a file."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def images(spark: SparkSession, paths: list[str], dtype: str = "f4") -> DataFrame:
    """(obs_id, voxel_id, y) of a list of images; obs_id is the place in the list.  Files are told
    apart by their full paths, so folders of equal names are no trouble; a path that is listed
    twice is two observations."""
    order = spark.createDataFrame([(i, _qualified(spark, p)) for i, p in enumerate(paths)], "obs_id long, name string")
    found = spark.read.format("binaryFile").load(list(dict.fromkeys(paths))).withColumn("name", F.col("path"))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for r in df.itertuples():
                y = decode(r.path, r.content, dtype)
                for i in range(0, len(y), 100_000):
                    yield pd.DataFrame({"obs_id": r.obs_id, "voxel_id": np.arange(i, min(i + 100_000, len(y)), dtype=np.int32), "y": y[i : i + 100_000]})

    return found.join(F.broadcast(order), "name").select("obs_id", "path", "content").mapInPandas(scan, "obs_id long, voxel_id int, y double")


def same_shape(obs: DataFrame) -> None:
    """Raise unless all images have as many voxels."""
    sizes = obs.groupBy("obs_id").agg(F.count("*").alias("n")).agg(F.min("n"), F.max("n")).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"images have from {sizes[0]} to {sizes[1]} voxels")


def design(spark: SparkSession, x: str, factors: list[tuple[str, str]]) -> DataFrame:
    """Design of local files: X, and (levels, effects) for each factor, row by row."""

    def load(path: str) -> np.ndarray:
        with open(path) as f:
            out = table(f.read())
        return out if out.ndim == 2 else out[:, None]

    xs, zs = load(x), [(load(a), load(b)) for a, b in factors]
    rows = [(i, xs[i].tolist(), *(v for f, z in zs for v in (int(f[i, 0]), z[i].tolist()))) for i in range(len(xs))]
    kinds = "".join(f", f_{k} int, z_{k} array<double>" for k in range(1, len(zs) + 1))
    return spark.createDataFrame(rows, f"obs_id long, x array<double>{kinds}")


def _flat(df: DataFrame, column: Column, size: int) -> np.ndarray:
    """One number per voxel, as long as the image; voxels without are 0."""
    table = df.select("voxel_id", column.cast("double").alias("v")).toArrow()
    out = np.zeros(size)
    out[table["voxel_id"].to_numpy()] = np.nan_to_num(table["v"].to_numpy().astype(float))
    return out


def write_map(df: DataFrame, column: str | Column, shape: tuple[int, ...], path: str, header: bytes | None = None) -> None:
    """One statistic as a NIfTI image (an image's worth of numbers goes to the driver, in Arrow
    batches; missing ones are 0)."""
    out = _flat(df, F.col(column) if isinstance(column, str) else column, int(np.prod(shape)))
    body = encode_nifti(out.reshape(shape), header)
    with open(path, "wb") as f:
        f.write(gzip.compress(body, mtime=0) if path.endswith(".gz") else body)


def write_maps(fits: DataFrame, spec: ModelSpec, shape: tuple[int, ...], folder: str, header: bytes | None = None) -> list[str]:
    """All maps of a (written) table of fits: n, mask, beta, sigma2, D, llh, iterations, residual mean
    square, cov(beta), and each contrast's estimate, standard error, statistic, degrees of
    freedom, -log10 p and R2.  Gives the files written."""
    import os

    os.makedirs(folder, exist_ok=True)
    maps: dict[str, Column] = {c: F.col(c) for c in ("n", "sigma2", "llh", "nit", "resms")} | {"mask": F.lit(1.0)}
    maps |= {f"beta_{i}": F.col("beta")[i] for i in range(spec.p)} | {f"vechD_{i}": F.col("vechD")[i] for i in range(spec.n_variance)}
    if spec.output_cov:
        maps |= {f"cov_beta_{i}_{j}": F.col("cov_beta")[i * spec.p + j] for i in range(spec.p) for j in range(i, spec.p)}
    for k, c in enumerate(spec.contrasts):
        for part in ("est", "se", "stat", "df", "neglog10p") if c.kind == "T" else ("stat", "df", "neglog10p", "r2"):
            maps[f"{c.name}_{c.kind}_{part}"] = F.col("contrasts")[k][part]
    out = []
    for name, column in maps.items():
        out.append(os.path.join(folder, f"{name}.nii.gz"))
        write_map(fits, column, shape, out[-1], header)
    return out


def upsert(path: str, values: np.ndarray, at: np.ndarray, size: int, dtype: str = "f4") -> None:
    """Write values at flat places of a raw map file, made of zeros if it is not there."""
    import os

    mode = "r+" if os.path.exists(path) else "w+"
    m = np.memmap(path, dtype=dtype, mode=mode, shape=(size,))
    m[at] = values
    m.flush()
