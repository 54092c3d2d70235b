"""The subspace join against all pairs."""

import math

import numpy as np
import pytest

from graphloom.llm import embedding_blocks
from graphloom.llm.embedding_blocks import grouped

SCHEMA = "vec_id long, embedding array<double>, label int, id string, same int, links long, members int, component string"


def brute(rows, least=0.9):
    usable = [i for i, r in enumerate(rows) if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links = {i: set() for i in range(len(rows))}
    for n, i in enumerate(usable):
        for j in usable[:n]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(a) == len(b):
                a, b = a / abs(a).max(), b / abs(b).max()
                if (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()) >= least or (a == b).all():
                    links[i].add(j)
                    links[j].add(i)
    out, seen = [], {}
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                new = links[todo.pop()] - group
                group |= new
                todo += new
            seen |= dict.fromkeys(group, min((rows[j][0] for j in group if rows[j][0] is not None), default=None))
        out.append((rows[i][0], len(links[i]), seen[i], rows[i][0] == seen[i]))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def table(spark, rows, n=3):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, "c") for r in rows], SCHEMA).repartition(n)


def clusters(size, seed, noise):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(size) for _ in range(150)]
    for k, width in enumerate(noise):
        out += [(out[k] + width * rng.standard_normal(size)) * rng.uniform(0.1, 9) for _ in range(25)]
    return [(i, [float(x) for x in v]) for i, v in enumerate(out)]


@pytest.mark.parametrize(("size", "tile"), [(24, 1 << 20), (24, 1), (64, 1), (3, 1), (1, 1 << 20)])
def test_links(spark, size, tile, monkeypatch):
    monkeypatch.setattr(embedding_blocks, "CHUNK", 32)
    rows = clusters(size, 3, (0.05, 0.2, 0.35, 0.45, 0.5))[: 275 if size > 3 else 120]
    assert got(grouped(table(spark, rows), tile=tile)) == brute(rows)


@pytest.mark.parametrize("tile", [1, 1 << 20])
def test_other_thresholds(spark, tile):
    rows = clusters(16, 8, (0.01, 0.3, 0.6))
    for least in (0.6, 0.999, 1.0 - 1e-12):
        assert got(grouped(table(spark, rows), least, tile=tile)) == brute(rows, least)


def test_chains_along_one_axis(spark):
    # Neighbours are linked, and what is two steps apart isn't: one component of many cells.
    rows = [(i, [math.cos(i * 0.3), math.sin(i * 0.3), 0.0, 0.0]) for i in range(20)]
    assert got(grouped(table(spark, rows))) == brute(rows)


def test_awkward_vectors(spark):
    one, nan = [1.0, 2.0, 3.0], float("nan")
    rows = [(1, one), (2, one), (2, one), (None, one), (None, None), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [nan, 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (9, [1.0, 2.0]), (10, [2.0, 4.0, 6.0])]
    rows += [(11, [1e200, 2e200, 3e200]), (12, [1e-300, 2e-300, 3e-300]), (13, [-1.0, -2.0, -3.0]), (14, [0.0, 1.0, 0.0]), (15, [-0.0, 1.0, -0.0]), (16, [1.0]), (17, [2.0]), (18, [-2.0])]
    assert got(grouped(table(spark, rows))) == brute(rows)


def test_a_third_is_one_vector(spark, monkeypatch):
    from graphloom.llm import common

    monkeypatch.setattr(common, "MOST_OF_A_KEY", 8)
    rows = clusters(12, 5, (0.1, 0.3))
    rows += [(1000 + i, rows[0][1]) for i in range(90)]
    assert got(grouped(table(spark, rows))) == brute(rows)


def test_single_precision(spark):
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in clusters(20, 9, (0.1, 0.4))]
    df = table(spark, rows)
    assert got(grouped(df.withColumn("embedding", df["embedding"].cast("array<float>")))) == brute(rows)


@pytest.mark.parametrize("size", [1, 5, 64, 1500])
def test_single_precision_lets_no_near_pair_go(size):
    """The comparison that all pairs of a tile go through is one product in single precision, with what it rounds allowed for."""
    rng = np.random.default_rng(size)
    x = embedding_blocks.unit_of(rng.standard_normal((300, size)))
    x[150:] = embedding_blocks.unit_of(x[:150] + 10.0 ** rng.uniform(-9, 0, (150, 1)) * x[150:])
    a, b = embedding_blocks.rows_and_columns(x)
    assert a.dtype == b.dtype == np.float32
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert (abs(a @ b.T - far) <= embedding_blocks.ROUGH * (a.shape[1] + 2)).all()


def test_a_coordinate_is_the_same_alone():
    """Tiles turn only what they need of a vector, so parts must be equal to the whole in every bit."""
    x = embedding_blocks.unit_of(np.random.default_rng(1).standard_normal((70, 24)))
    whole = embedding_blocks.rotated(x, {})
    for cut in embedding_blocks.cuts(24):
        assert (embedding_blocks.rotated(x[3:50:7], {}, cut) == whole[3:50:7, cut]).all()


def test_an_empty_table(spark):
    assert grouped(spark.createDataFrame([], SCHEMA)).count() == 0
