import os

import numpy as np

from skinnyqr.plans.jobs import qr_text_job, recommend_job, recommend_saved_job, ssvd_job, ssvd_text_job


def test_qr_text_job(spark, tmpdir_path):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(60, 4))
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    with open(os.path.join(src, "m.txt"), "w") as f:
        f.write("\n".join(f"{i} " + " ".join(repr(float(x)) for x in row) for i, row in enumerate(a)))
    out = os.path.join(tmpdir_path, "q")
    res = qr_text_job(spark, src, out, block_rows=16, schedule=[2, 1], id_mode="first_field")
    q = {r["row_id"]: r["q"] for r in spark.read.parquet(out).collect()}
    qm = np.array([q[i] for i in range(60)])
    assert np.allclose(qm @ res.r_matrix(), a)


def test_recommend_jobs_round_trip(spark, tmpdir_path):
    rng = np.random.default_rng(1)
    src = os.path.join(tmpdir_path, "ratings")
    os.makedirs(src)
    lines = [f"{u} {100 + i} {int(rng.integers(1, 6))}" for u in range(40) for i in range(6) if rng.random() < 0.6]
    with open(os.path.join(src, "r.txt"), "w") as f:
        f.write("\n".join(lines))
    factors = os.path.join(tmpdir_path, "factors")
    out1 = os.path.join(tmpdir_path, "rec1")
    recommend_job(spark, src, out1, k=6, p=0, n=2, factors_path=factors)
    out2 = os.path.join(tmpdir_path, "rec2")
    recommend_saved_job(spark, factors, out2, n=2)
    a = sorted(r["value"].split("\t")[1].count(":") for r in spark.read.text(out1).collect())
    b = sorted(r["value"].split("\t")[1].count(":") for r in spark.read.text(out2).collect())
    assert a == b and len(a) == 40
    out4 = os.path.join(tmpdir_path, "rec4")
    recommend_job(spark, src, out4, k=6, p=0, n=10, exclude_seen=True)
    rated = {}
    for line in lines:
        uu, it, _ = line.split()
        rated.setdefault(int(uu), set()).add(int(it))
    for r in spark.read.text(out4).collect():
        uu, body = r["value"].split("\t")
        got = {int(e.split(":")[0]) for e in body.strip("[]").split(",") if e}
        assert not (got & rated.get(int(uu), set()))
    out3 = os.path.join(tmpdir_path, "rec3")
    recommend_job(spark, src, out3, k=6, p=0, n=2, n_splits=2, threshold=1e12)
    assert all(r["value"].endswith("\t[]") for r in spark.read.text(out3).collect())
    svd_out = os.path.join(tmpdir_path, "svd")
    res = ssvd_job(spark, src, svd_out, k=3, p=2)
    assert spark.read.parquet(os.path.join(svd_out, "sigma")).count() == 5
    assert np.all(np.diff(res.sigma) <= 1e-9)


def test_svd_of_a_text_matrix(spark, tmpdir_path):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(50, 6))
    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "svd")
    os.makedirs(src)
    with open(os.path.join(src, "m.txt"), "w") as f:
        f.write("\n".join(" ".join(repr(float(x)) for x in row) for row in a))
    res = ssvd_text_job(spark, src, out, k=6, p=0)
    u = np.array([r["u"] for r in res.u.orderBy("row_id").collect()])
    v = np.array([r["v"] for r in res.v.orderBy("item_id").collect()])
    assert np.allclose(u * res.sigma @ v.T, a) and np.allclose(res.sigma, np.linalg.svd(a)[1])
    only_v = ssvd_text_job(spark, src, out, k=2, p=3, compute_u=False, v_half_sigma=True, seed=3)
    assert only_v.u is None and np.allclose(only_v.sigma[:1], res.sigma[:1], rtol=0.2)


def test_dropped_lines_are_counted(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "ratings")
    os.makedirs(src)
    with open(os.path.join(src, "r.txt"), "w") as f:
        f.write("1 10 5\nno rating here\n2 10 3\n2 11\n1 11 2\n")
    out = ssvd_job(spark, src, os.path.join(tmpdir_path, "svd"), k=1, p=1, on_bad="drop")
    assert out.bad_lines == 2 and out.u.count() == 2
