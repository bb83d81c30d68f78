import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from lectern.llm.covertree import build, leaf_cells, near_vectors, traverse
from lectern.plans.stage import Workspace


def brute(rows, cosine=0.95):
    good = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
    n = len(rows)
    label = list(range(n))
    links = [0] * n
    vecs = [np.array(v, float) if good(v) and i is not None else None for i, v in rows]

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = vecs[i], vecs[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)) >= cosine:
                links[i] += 1
                links[j] += 1
                label[root(i)] = root(j)
    parts = {}
    for i in range(n):
        parts.setdefault(root(i), []).append(rows[i][0])
    out = []
    for i, (v, _) in enumerate(rows):
        c = v if len(parts[root(i)]) == 1 else min(parts[root(i)])
        out.append((v, links[i], c, c == v if v is not None else True))
    return sorted(out, key=str)


def corpus(dim=12):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(30):
        c = rng.normal(size=dim)
        for _ in range(rng.integers(1, 12)):
            rows.append((c * rng.uniform(0.5, 3) + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.2, 0.3])).astype(np.float32).tolist())
    hub = rng.normal(size=dim).astype(np.float32).tolist()
    rows += [hub] * 60
    ids = rng.permutation(len(rows)).tolist()
    out = list(zip(ids, rows, strict=True))
    out += [(9001, None), (9002, []), (9003, [0.0] * dim), (9004, [1.0, None] + [0.0] * (dim - 2)), (9005, [float("nan")] * dim), (9006, [float("inf")] * dim), (9007, [1.0, 0.0]), (9008, [2.0, 0.0]), (None, hub), (9009, [-x for x in hub]), out[0]]
    return out


@pytest.mark.parametrize("block,fan", [(4096, 48), (16, 4), (7, 30)])
def test_links_by_brute_force(spark, block, fan):
    rows = corpus()
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cell int").repartition(3)
    assert sorted(map(tuple, near_vectors(df, block=block, fan=fan, sample=64).collect()), key=str) == brute(rows)


def test_traversal_prunes_and_covers():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(40, 16))
    x = np.repeat(centers, 50, 0) + rng.normal(size=(2000, 16)) * 0.02
    x /= np.sqrt((x * x).sum(1))[:, None]
    tree = build(x, np.arange(len(x)))
    met = np.zeros((len(x), len(x)), bool)
    for p, q in traverse(tree, tree, 0.3):
        met[np.ix_(p, q)] = met[np.ix_(q, p)] = True
    near = x @ x.T >= 1 - 0.3**2 / 2
    assert (met | ~near).all() and met.mean() < 0.5


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pairs_of_cells_grow_with_the_clusters(spark):
    """On clustered data a cell has a few partners, whatever the number of clusters."""
    def pairs_of(clusters):
        rng = np.random.default_rng(9)
        centres = rng.normal(size=(clusters, 24))
        rows = [(i, 1, (c + rng.normal(size=24) * 0.02).tolist()) for i, c in enumerate(np.repeat(centres, 25, 0))]
        df = spark.createDataFrame(rows, "id long, c long, v array<double>").repartition(3)
        with Workspace(spark) as space:
            found, cells, pairs = leaf_cells(space, df, np.float64, 0.95, 30, 64, 8)
            assert found.count() == len(rows) and cells.agg({"n": "sum"}).first()[0] == len(rows)
            assert cells.where("n > 30 and radius > 0.16").count() == 0
            return pairs.count(), cells.count()

    (few, some), (many, more) = pairs_of(24), pairs_of(96)
    assert few <= 6 * some and many <= 6 * more, (few, some, many, more)


def test_dense_cells_and_long_vectors(spark):
    """Cells closer together than a link is long need no comparison; vectors of any length are a tree of their own."""
    rng = np.random.default_rng(2)
    rows = [(i, (np.ones(5) + rng.normal(size=5) * 0.005).tolist()) for i in range(60)] + [(100 + i, rng.normal(size=3000).tolist()) for i in range(12)]
    rows += [(200, [x * 2 for x in rows[60][1]]), (201, [1.0]), (202, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert sorted(map(tuple, near_vectors(df, block=8, fan=4, sample=16).collect()), key=str) == brute(rows)


DISK = """
import os, sys, threading, time
import numpy as np
repo, top, n, more = sys.argv[1], sys.argv[2], int(sys.argv[3]), eval(sys.argv[4])
sys.path.insert(0, repo)
from pyspark.sql import SparkSession
from lectern.llm import covertree
conf = {"spark.master": "local[4]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "3g", "spark.local.dir": top + "/own", "spark.checkpoint.dir": "file://" + top + "/shared"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
x = np.random.default_rng(3).normal(size=(n, 64)).astype(np.float32)
x[1] = x[0] * 2 + 0.01
import pyarrow as pa, pyarrow.parquet as pq
pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float32()))}), top + "/in.parquet")
seen, done = [0], threading.Event()
def watch():
    while not done.wait(0.05):
        now = 0
        for k in ("own", "shared"):
            for d, _, names in os.walk(top + "/" + k):
                for f in names:
                    try:
                        now += os.lstat(d + "/" + f).st_size
                    except OSError:
                        pass
        seen.append(now)
t = threading.Thread(target=watch)
t.start()
began = time.time()
out = covertree.near_vectors(spark.read.parquet(top + "/in.parquet"), **more)
done.set()
t.join()
print("RESULT", max(seen) / (n * 256), out.where("n_links > 0").count(), out.count(), round(time.time() - began))
"""


def test_disk_follows_the_vectors(tmp_path):
    """Vectors without clusters: what lies on disk at once, shuffles included, stays within 4 times their bytes."""
    repo = str(Path(__file__).parents[2])
    said = subprocess.run([sys.executable, "-c", DISK, repo, str(tmp_path), "40000", "dict(block=512, turn=1 << 20)"], capture_output=True, text=True, timeout=900, cwd=repo)
    found = [x.split() for x in said.stdout.splitlines() if x.startswith("RESULT")]
    assert found, said.stderr[-2000:]
    times, linked, rows = found[0][1:4]
    assert float(times) < 4 and (linked, rows) == ("2", "40000"), found
