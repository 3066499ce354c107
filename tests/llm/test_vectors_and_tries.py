"""Whitening, tiled vector comparison and the prefix trie against plain Python."""

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from twins import Union  # noqa: E402

from feedloom.llm import near_vectors, prefix_trie, whitening  # noqa: E402
from feedloom.llm.common import ready  # noqa: E402

VECTORS = "vec_id bigint, embedding array<float>, label int"
TURNS = "conv_id bigint, turn bigint, role string, text string"


def odd_vectors(width=12, seed=3):
    """Clusters of near copies, exact copies, a graded spread, nulls, zeros, non-finite entries, short and repeated rows."""
    rng = np.random.default_rng(seed)
    rows, spread = [], np.linspace(1, 0.2, width)
    for i in range(260):
        rows.append((i, rng.normal(size=width) * spread, i % 3))
    for c in range(4):
        base = rng.normal(size=width)
        for j in range(30):
            rows.append((1000 + 50 * c + j, base + rng.normal(size=width) * 0.03 * np.linalg.norm(base), c % 3))
    rows += [(2000 + i, rows[5][1], 2) for i in range(5)] + [(2010, rows[5][1] * 3.0, 2), (2011, -rows[5][1], 2)]
    out = [(k, [float(np.float32(c)) for c in v], w) for k, v, w in rows]
    nan, inf = float("nan"), float("inf")
    for k, v in enumerate([None, [], [None] * width, [nan] + [1.0] * (width - 1), [inf] * width, [0.0] * width, [1.0] * (width - 1)]):
        out.append((3000 + k, v, 0))
    return [*out, (3100, out[0][1], None), (None, out[0][1], 0), out[7], out[7], (4000, [-0.0] * width, 1)]


def frame(spark, rows, schema, *clash):
    df = ready(spark).createDataFrame(rows, schema).repartition(3)
    return df.withColumns({name: F.lit(name) for name in clash}) if clash else df


def usable(v, width):
    return v is not None and len(v) == width and all(c is not None and np.isfinite(c) for c in v)


def whitened_twin(rows, width, most=8):
    good = [(k, np.floor(1024 * np.array(v, dtype=float)).astype(object) + 100000) for k, v, _ in rows if usable(v, width)]
    x = np.array([[int(c) for c in v] for _, v in good], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = [int(sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s))) for row in x]
    c = np.array([[(n * int(a) - int(t)) / n for a, t in zip(row, s)] for row in x])
    e, z = np.linalg.eigh(c.T @ c / n)
    order = [i for i in np.argsort(-e) if e[i] > 1e-9 * e.max()][:most]
    w = c @ z[:, order] / np.sqrt(e[order])
    return [k for k, _ in good], n, deviation, w, e[order] / e.sum()


@pytest.mark.parametrize("rank", [None, 3, 1])
def test_whitening_equals_eigenvectors(spark, rank):
    rows = odd_vectors()
    if rank:
        rows = [(k, [v[i % rank] if v and len(v) == 12 else 1.0 for i in range(12)] if v else v, w) for k, v, w in rows]
    keys, n, deviation, w, explained = whitened_twin(rows, 12)
    got = whitening.whiten(frame(spark, rows, VECTORS, "k", "v", "n", "block", "dim", "component")).collect()
    assert {r["component"] for r in got} == set(range(1, w.shape[1] + 1)) and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9
    seen, want = defaultdict(list), defaultdict(list)
    for r in got:
        seen[r["component"]].append((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"], abs(r["whitened"])))
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
    for i in range(w.shape[1]):
        want[i + 1] = sorted((k is None, k or 0, d, abs(x)) for k, d, x in zip(keys, deviation, w[:, i]))
        mine = sorted(seen[i + 1])
        assert [m[:3] for m in mine] == [m[:3] for m in want[i + 1]]
        assert np.allclose([m[3] for m in mine], [m[3] for m in want[i + 1]], rtol=1e-6, atol=1e-6)


def test_whitening_without_spread(spark):
    assert whitening.whiten(frame(spark, [], VECTORS)).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECTORS)).collect() == []
    assert whitening.whiten(frame(spark, [(1, None, 0), (2, [], 0), (3, [None], 0)], VECTORS)).collect() == []


def test_whitening_of_huge_entries(spark):
    rows = [(i, [float(i) * 1e30, 1.0], 0) for i in range(-2, 3)]
    got = whitening.whiten(frame(spark, rows, VECTORS)).collect()
    assert len(got) == 5 and all(r["deviation"] is None for r in got if r["vec_id"]) and got[0]["identity_error"] < 1e-6


@pytest.mark.parametrize("kind", ["plain", "equal", "twins", "graded", "low"])
def test_bidiagonal_solver(kind):
    rng, d = np.random.default_rng(5), 33
    a = rng.normal(size=(200, d))
    if kind in ("equal", "twins"):
        a = np.linalg.qr(a)[0] * np.array([5.0] * (d if kind == "equal" else 3) + [2.0] * (0 if kind == "equal" else d - 3))
    if kind == "graded":
        a = a * np.logspace(0, -10, d)
    if kind == "low":
        a = rng.normal(size=(200, 4)) @ rng.normal(size=(4, d))
    values, z, trace = whitening.directions(np.linalg.qr(a, mode="r"), 8)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    assert len(values) == (4 if kind == "low" else 8) and np.allclose(values, want[: len(values)], rtol=1e-12)
    assert np.allclose(z.T @ z, np.eye(len(values)), atol=1e-11) and abs(trace / want.sum() - 1) < 1e-12
    assert np.abs(a.T @ (a @ z) - values * z).max() < 1e-11 * want[0]
    if kind == "graded":  # high relative accuracy, not only beside the largest
        a, b, _ = whitening.bidiagonal(np.linalg.qr(a, mode="r"))
        assert np.allclose(whitening.squared_singular_values(a, b), np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False) ** 2, rtol=1e-9)


def linked_twin(rows, width, cosine=0.98):
    ok = [w is not None and usable(v, width) and any(c != 0 for c in v) for _, v, w in rows]
    unit = [np.array(v) / np.linalg.norm(v) if o else None for (_, v, _), o in zip(rows, ok)]
    groups, links = Union(len(rows)), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= cosine:
                groups.join(i, j)
                links[i] += 1
                links[j] += 1
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[groups.find(i)].append(r[0])
    comp = [min(least[groups.find(i)], default=None) for i in range(len(rows))]
    return Counter((r[0], n, c, r[0] == c) for r, n, c in zip(rows, links, comp))


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("tile", [4096, 16])
def test_tiled_vectors_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(near_vectors, "TILE", tile)
    monkeypatch.setattr(near_vectors, "SLAB", 7)
    rows = odd_vectors()
    got = near_vectors.near_duplicates(frame(spark, rows, VECTORS, "k", "v", "class", "tile", "many", "a", "b"))
    assert rows_of(got) == linked_twin(rows, 12)


def test_tiled_vectors_of_one_hot_group(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "TILE", 64)
    rng = np.random.default_rng(1)
    base = rng.normal(size=24)
    rows = [(i, (base + rng.normal(size=24) * 0.05 * (i % 4)).tolist(), 1) for i in range(500)]
    rows = [(k, [float(np.float32(c)) for c in v], w) for k, v, w in rows]
    assert rows_of(near_vectors.near_duplicates(frame(spark, rows, VECTORS))) == linked_twin(rows, 24)


def test_tiled_vectors_without_links(spark):
    assert near_vectors.near_duplicates(frame(spark, [], VECTORS)).collect() == []
    rows = [(1, None, 0), (2, [0.0, 0.0], 0), (None, None, None)]
    assert rows_of(near_vectors.near_duplicates(frame(spark, rows, VECTORS))) == Counter([(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)])


def odd_conversations(seed=9):
    """Shared beginnings, copies, one long conversation, null roles, texts and turns, numbers with gaps."""
    rng, rows = random.Random(seed), []
    words = ["a", "b", "", None, "é", "long " * 50]
    for c in range(60):
        for t in range(rng.choice([1, 2, 5, 12, 30])):
            rows.append((c, None if t == 0 and c % 7 == 0 else t * 2, ["user", "assistant"][t % 2], "start" if t < 10 and c % 2 else rng.choice(words)))
    rows += [(100 + c, t, "user", f"turn {t}") for c in range(40) for t in range(25)]  # copies
    rows += [(200, t, None if t % 3 else "user", f"{t % 5}") for t in range(700)] + [(203, t, None if t % 3 else "user", f"{t % 5}") for t in range(650)]
    return [*rows, (None, 1, "user", "nobody"), (-7, 0, "user", "a"), (77, 5, None, None)]


def trie_twin(rows, rebuild):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - int(np.fmod(c, 5))
        whole[c] = own.get(donor, [])[:h] + v[h:] if rebuild else v
    nodes = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids, saved, leaves = Counter(p[:-1] for p in nodes if p), Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not kids[p]
    out = Counter()
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(p))
        up = min(nodes[p[:-1]]) if p else None
        out[min(members), len(p), up, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("rebuild", [False, True])
def test_prefix_trie_equals_brute_force(spark, rebuild):
    rows = odd_conversations()
    turns = frame(spark, rows, TURNS, "c", "pos", "b", "h", "low", "depth", "x0", "bytes")
    assert rows_of(prefix_trie.prefix_trie(turns, rebuild=rebuild)) == trie_twin(rows, rebuild)


def test_prefix_trie_of_a_long_chain(spark):
    """Every conversation hangs on the one before it, so totals take several rounds."""
    rows = [(c, t, "user", f"{t}" if t < c else f"end {c}") for c in range(40) for t in range(c + 1)]
    assert rows_of(prefix_trie.prefix_trie(frame(spark, rows, TURNS))) == trie_twin(rows, False)


def test_prefix_trie_ties_and_empty(spark):
    assert prefix_trie.prefix_trie(frame(spark, [], TURNS)).collect() == []
    assert prefix_trie.prefix_trie(frame(spark, [(None, 0, "user", "x")], TURNS)).collect() == []
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "b"), (2, 0, "user", "a")]
    got = prefix_trie.prefix_trie(frame(spark, rows, TURNS)).collect()
    assert sorted((r["depth"], r["n_convs"], r["n_leaves"]) for r in got) == [(0, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1)]
