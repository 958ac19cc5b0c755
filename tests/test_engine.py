"""Plans against SQL, files, filters, chunks and streams."""

import math
import struct

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mixfield import registry
from mixfield.operators import masking, products
from mixfield.plans import model
from mixfield.sources import files
from mixfield.spec import Contrast, Factor, ModelSpec, factor_columns, level_columns, parse_contrast

SF = "/root/testdata/sf0.001"
TABLES = "lineitem embeddings events".split()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    keys = [c for c in cols if not pd.api.types.is_float_dtype(want[c])]
    a, b = (d[cols].sort_values(keys).reset_index(drop=True) for d in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-6, atol=2e-6)


def test_missing_values(spark):
    obs = spark.createDataFrame([(1, 1, 0.0), (2, 1, math.nan), (3, 1, None), (4, 1, 2.0), (5, 1, -1.0), (6, 2, math.inf)], "obs_id long, voxel_id int, y double")
    assert {r.obs_id for r in masking.usable(obs).collect()} == {4, 5}
    assert {r.obs_id for r in masking.usable(obs, 0.0).collect()} == {4}
    mask = spark.createDataFrame([(4, 1, 0.0), (5, 1, 2.0)], "obs_id long, voxel_id int, m double")
    assert [(r.obs_id, r.y) for r in masking.usable(obs, data_mask=mask).collect()] == [(5, -2.0)]
    assert masking.usable(obs, analysis_mask=spark.createDataFrame([(2,)], "voxel_id int")).count() == 0
    assert masking.usable(obs.limit(0)).count() == 0


def test_voxel_blocks_by_id(spark):
    v = spark.range(10).select(F.col("id").cast("int").alias("voxel_id"))
    assert [r.block for r in masking.voxel_blocks(v, 3).orderBy("voxel_id").collect()] == [1, 1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert {r.block for r in masking.voxel_blocks(v, 5, 10).collect()} == {1, 2, 3, 4, 5}


def test_fit_does_not_depend_on_blocks(spark):
    spec = ModelSpec(2, [Factor("label")], [Contrast("t", [[0.0, 1.0]])], tol=1e-10)
    from mixfield.sources import views

    obs, design = views.embeddings(spark, SF)
    stats = model.statistics(obs.where("voxel_id < 6"), design, spec.but(data_mask_thresh=-0.2), only=F.col("voxel_id") % 2 == 0)
    one = model.fit(stats, spec).orderBy("voxel_id").toPandas()
    many = model.fit(stats, spec.but(blocks=7)).orderBy("voxel_id").toPandas()
    assert model.fit(stats, spec.but(blocks=7)).select(F.spark_partition_id()).distinct().count() > 1
    np.testing.assert_allclose(np.stack(one.beta), np.stack(many.beta))
    assert one.converged.all() and set(one.status) == {"fitted"} and one.is_ring.any() and not one.is_ring.all()
    out = model.results(model.fit(stats, spec)).toPandas()
    assert (out.neglog10p >= 0).all() and len(out) == 6


def test_two_factor_products_match_numpy(spark):
    r = np.random.default_rng(1)
    n = 80
    rows = [(i, [1.0, float(r.normal())], int(r.integers(0, 4)), [1.0], int(r.integers(0, 3)), [1.0, float(r.normal())]) for i in range(n)]
    design = spark.createDataFrame(rows, "obs_id long, x array<double>, f_1 int, z_1 array<double>, f_2 int, z_2 array<double>")
    y = r.normal(size=n) + 3
    obs = spark.createDataFrame([(i, 0, float(y[i])) for i in range(n)], "obs_id long, voxel_id int, y double")
    spec = ModelSpec(2, [Factor("a"), Factor("b", 2)])
    s = model.system(model.statistics(obs, design, spec).toPandas().iloc[0], [1, 2], 2)
    z = np.zeros((n, 10))
    for i, row in enumerate(rows):
        z[i, row[2]] = 1
        z[i, 4 + 2 * row[4] : 6 + 2 * row[4]] = row[5]
    np.testing.assert_allclose(s.ztz, z.T @ z, atol=1e-9)
    np.testing.assert_allclose(np.concatenate([v.ravel() for v in s.zty]), z.T @ y)
    assert model.fit(model.statistics(obs, design, spec), spec).first().status == "fitted"


def test_rank_failure_keeps_n(spark):
    design = spark.createDataFrame([(i, [1.0, 1.0], i % 3, [1.0]) for i in range(12)], "obs_id long, x array<double>, f_1 int, z_1 array<double>")
    obs = spark.createDataFrame([(i, 0, i + 1.0) for i in range(12)], "obs_id long, voxel_id int, y double")
    row = model.fit(model.statistics(obs, design, ModelSpec(2, [Factor("f")])), ModelSpec(2, [Factor("f")])).first()
    assert (row.status, row.n, row.beta) == ("rank", 12, None)


def test_compare(spark):
    a = spark.createDataFrame([(1, -10.0), (2, -5.0)], "voxel_id int, llh double")
    b = spark.createDataFrame([(1, -8.0), (2, -6.0), (3, 0.0)], "voxel_id int, llh double")
    got = {r.voxel_id: (r.chi2, r.neglog10p) for r in model.compare(a, b, 0, 1).collect()}
    assert got[1][0] == 4.0 and math.isclose(got[1][1], -math.log10(0.5 * math.erfc(math.sqrt(2))), rel_tol=1e-6)
    assert got[2] == (0.0, pytest.approx(math.log10(2))) and 3 not in got
    assert {r.chi2 for r in model.compare(b, a, 1, 0).collect()} == {4.0, 0.0}
    with pytest.raises(ValueError):
        model.compare(a, b, 1, 3)


def test_files(spark, tmp_path):
    r = np.random.default_rng(0)
    made = [r.normal(size=(2, 3, 4)) for _ in range(3)]
    paths = [str(tmp_path / n) for n in ("a.nii", "b.npy", "c.dat")]
    (tmp_path / "a.nii").write_bytes(files.encode_nifti(made[0]))
    np.save(paths[1], made[1])
    made[2].astype("f4").tofile(paths[2])
    got = files.images(spark, paths).toPandas().sort_values(["obs_id", "voxel_id"])
    files.same_shape(files.images(spark, paths))
    for i in range(3):
        np.testing.assert_allclose(got[got.obs_id == i].y, made[i].ravel(), rtol=1e-6)
    np.testing.assert_allclose(files.table("id,a,b\nr1,1,2\nr2,3,4"), [[1, 2], [3, 4]])
    out = str(tmp_path / "m.nii.gz")
    files.write_map(spark.createDataFrame([(0, 1.5), (23, 2.5)], "voxel_id int, s double"), "s", (2, 3, 4), out)
    back = files.decode(out, open(out, "rb").read())
    assert (back[0], back[23], back.sum()) == (1.5, 2.5, 4.0)
    files.upsert(str(tmp_path / "u.dat"), np.array([7.0]), np.array([3]), 5)
    files.upsert(str(tmp_path / "u.dat"), np.array([8.0]), np.array([1]), 5)
    assert np.fromfile(tmp_path / "u.dat", "f4").tolist() == [0, 8, 0, 7, 0]


def test_spec():
    assert parse_contrast("1 0 -1") == [[1.0, 0.0, -1.0]] and parse_contrast("[[1, 0], [0, 1]]") == [[1.0, 0.0], [0.0, 1.0]]
    with pytest.raises(ValueError):
        ModelSpec(2, [Factor("f")], [Contrast("c", [[1.0, 0.0], [2.0, 0.0]])])
    with pytest.raises(ValueError):
        ModelSpec(3, [Factor("f")], [Contrast("c", [[1.0, 0.0]])])
    with pytest.raises((ValueError, SyntaxError)):
        parse_contrast("__import__('os')")
    spec = ModelSpec.of({"p": 2, "factors": [{"name": "f", "effects": 2}], "contrasts": [{"name": "c", "vector": [0, 1]}], "min_percent": "50%"})
    assert spec.min_percent == 0.5 and spec.n_variance == 3 and spec.contrasts[0].kind == "T"
    assert list(factor_columns(1, [3, 2], [2, 1])) == [6, 7] and list(level_columns(0, 1, [3, 2], [2, 1])) == [2, 3]


def test_stream_equals_batch(spark, tmp_path):
    from mixfield.streaming import incremental

    rows = [(i, i % 2, float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "obs_id long, voxel_id int, y double")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    design = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)], "obs_id long, x array<double>")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.running_products(stream, design, 2).writeStream.outputMode("complete").format("memory").queryName("products").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("products").orderBy("voxel_id").toPandas()
    want = incremental.running_products(df, design, 2).orderBy("voxel_id").toPandas()
    pd.testing.assert_frame_equal(got, want)
    y = products.y_products(masking.usable(df), design, 2).orderBy("voxel_id").toPandas()
    np.testing.assert_allclose(np.stack(y.xty)[:, 1], want.xty_1)


def test_entry_lists_everything():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_study_of_images_from_the_command_line(spark, tmp_path):
    """Three folders of equally named images, with masks, read, fitted and written back."""
    import json

    from mixfield import __main__ as cli
    from mixfield.functions import estimators as E
    from mixfield.sources import files

    r, shape, subjects, scans = np.random.default_rng(5), (3, 4, 2), 3, 8
    n, effect = subjects * scans, r.normal(size=(subjects, *shape))
    x = np.column_stack([np.ones(n), r.normal(size=n)])
    inside = np.ones(shape)
    inside[0, 0, 0] = 0
    y, paths, masks = [], [], []
    for i in range(n):
        folder = tmp_path / f"sub{i // scans}" / f"run{i % scans}"
        folder.mkdir(parents=True)
        y.append(5 + 2 * x[i, 1] + effect[i // scans] + r.normal(size=shape))
        (folder / "scan.nii").write_bytes(files.encode_nifti(y[-1]))
        own = np.ones(shape)
        own[1, 1, 1] = i % 4 > 0
        (folder / "mask.nii.gz").write_bytes(__import__("gzip").compress(files.encode_nifti(own)))
        paths.append(str(folder / "scan.nii"))
        masks.append(str(folder / "mask.nii.gz"))
    (tmp_path / "inside.nii").write_bytes(files.encode_nifti(inside))
    (tmp_path / "y.txt").write_text("\n".join(paths))
    (tmp_path / "m.txt").write_text("\n".join(masks))
    np.savetxt(tmp_path / "x.csv", x, delimiter=",")
    np.savetxt(tmp_path / "f.csv", np.arange(n) // scans, fmt="%d")
    np.savetxt(tmp_path / "z.csv", np.ones(n))
    config = {"Y_files": "y.txt", "data_mask_files": "m.txt", "analysis_mask": "inside.nii", "X": "x.csv", "Z": [{"f1": {"name": "subject", "factor": "f.csv", "design": "z.csv"}}], "outdir": "out", "contrasts": [{"c1": {"name": "slope", "vector": "[0, 1]"}}, {"c2": {"name": "all", "vector": [[1, 0], [0, 1]]}}], "Missingness": {"MinPercent": "50%"}, "tol": "1e-10", "MAXMEM": "2**32"}
    (tmp_path / "study.json").write_text(json.dumps(config))
    assert cli.main(["study", str(tmp_path / "study.json")]) == 0

    def values(name):
        return files.decode_nifti((tmp_path / "out" / "maps" / f"{name}.nii.gz").read_bytes())[0]

    count = values("n")
    assert count.shape == shape and count[0, 0, 0] == 0 and count[1, 1, 1] == 18 and count[2, 2, 1] == n
    assert (values("all_F_stat")[inside > 0] > 0).all() and values("mask").sum() == inside.sum()
    level = np.arange(n) // scans
    for at in ((1, 1, 1), (2, 3, 0)):
        rows = np.flatnonzero([a[at] and (at != (1, 1, 1) or i % 4 > 0) for i, a in enumerate(y)])
        v, w, z = np.array([y[i][at] for i in rows]), x[rows], np.eye(subjects)[level[rows]]
        s = E.System(len(v), w.T @ w, w.T @ v, v @ v, [(z.T @ w)[:, None, :]], [(z.T @ v)[:, None]], (z.T @ z).diagonal()[:, None, None])
        want = E.fit(s, tol=1e-10)
        np.testing.assert_allclose([values("beta_0")[at], values("beta_1")[at], values("sigma2")[at], values("vechD_0")[at]], [*want.beta, want.sigma2, want.d[0][0, 0]], rtol=1e-5)


def test_image_headers():
    from mixfield.sources import files

    image = np.arange(24.0).reshape(2, 3, 4)
    for order in "<>":
        head = bytearray(540)
        struct.pack_into(f"{order}i", head, 0, 540)
        struct.pack_into(f"{order}h", head, 12, 64)
        struct.pack_into(f"{order}8q", head, 16, 3, 2, 3, 4, 1, 1, 1, 1)
        struct.pack_into(f"{order}q", head, 168, 544)
        struct.pack_into(f"{order}2d", head, 176, 2.0, 1.0)
        got = files.decode_nifti(bytes(head) + b"\0" * 4 + image.astype(f"{order}f8").tobytes(order="F"))[0]
        assert (got == image * 2 + 1).all()
    pair = bytearray(files.encode_nifti(image))
    pair[344:348] = b"ni1\0"
    for raw in (bytes(pair), b"\0" * 400):
        with pytest.raises(ValueError):
            files.decode_nifti(raw)


def test_contrast_kinds():
    assert [Contrast.of("c", v).kind for v in ([0, 1], "[0, 1]", "0 1", [[0, 1]], "[[0, 1]]", [[1, 0], [0, 1]], "[1 0] [0 1]")] == ["T", "T", "T", "F", "F", "F", "F"]


def test_ranks_and_blocks(spark):
    from mixfield.operators import masking

    ids = [0, 3, 70_000, 70_001, 140_000, 65_536, 9]
    df = spark.createDataFrame([(i,) for i in ids], "voxel_id int")
    got = {r.voxel_id: (r.rank, r.total) for r in masking.ranked(df, "voxel_id").collect()}
    assert got == {i: (k, 7) for k, i in enumerate(sorted(ids))}
    for n in (1, 2, 3, 7, 10):
        want = [b + 1 for b, part in enumerate(np.array_split(np.arange(7), n)) for _ in part]
        assert [r.block for r in masking.voxel_blocks(df, n).orderBy("voxel_id").collect()] == want
    assert masking.block_count(1000, [10], [1], 2, 1e9) == 1 and masking.block_count(1000, [100], [2], 2, 1e5) == 81 and masking.block_count(1000, [100, 20], [1, 1], 2, 1e4, 60) == 60
