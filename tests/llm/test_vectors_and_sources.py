"""Operators 11 to 13 against plain loops and their SQL, on small tables with nulls, odd vectors, ties, repeats and clashing columns."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from readmill.llm import balls, collisions, divergence

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<float>, label int, node bigint, cluster int, links bigint, root bigint, distance bigint"


def duck(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(sql).df()


def same(got, want, keys):
    a, b = (x.sort_values(keys).reset_index(drop=True) for x in (got, want[got.columns]))
    assert len(a) == len(b)
    for c in a.columns:
        assert a[c].tolist() == b[c].tolist(), c


def some_vectors(n=260, width=64, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, width))
    out = []
    for i in range(n):
        v = base[i % len(base)] + rng.standard_normal(width) * rng.choice([0.0, 0.2, 0.3, 0.45])
        out.append((i, [float(x) for x in v.astype(np.float32)], i % 2))
    out += [(n + i, out[7][1], 1) for i in range(40)]  # copies
    out += [(n + 40 + i, [float(x) for x in (base[0] + rng.standard_normal(width) * 0.05).astype(np.float32)], 0) for i in range(60)]  # near copies
    return out


ODD = [
    (9000, None, 1), (9001, [0.0] * 64, 1), (9002, [float("nan")] + [1.0] * 63, 1), (9003, [float("inf")] + [1.0] * 63, 0), (9004, [None] + [1.0] * 63, 0), (9005, [], 0),
    (9006, [1.0] * 64, None), (9007, [1.0] * 64, None), (9008, [1.0, 2.0], 1), (9009, [2.0, 4.0], 1), (9010, [1e30] * 64, 1), (9011, [2e30] * 64, 1), (9012, [1e-30] * 64, 1), (9013, [-0.0, 1.0], 0), (9014, [0.0, 1.0], 0),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, 1, 1) for r in rows], VECTORS).repartition(3)


def plain_links(rows, least):
    n = len(rows)
    ok = [r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                    links[i].add(j)
                    links[j].add(i)
    return links


def reach(links, ids):
    out = []
    for i in range(len(links)):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out.append(min(ids[k] for k in seen))
    return out


# -- 11


@pytest.mark.parametrize("rows,most", [(512, 16_384), (16, 32)])
def test_near_vectors_are_those_of_all_pairs(spark, monkeypatch, rows, most):
    monkeypatch.setattr(collisions, "BLOCK_ROWS", rows)
    monkeypatch.setattr(collisions, "MOST_ROWS", most)
    data = some_vectors() + ODD
    links = plain_links(data, 0.93)
    want = {r[0]: (len(x), c, r[0] == c) for r, x, c in zip(data, links, reach(links, [r[0] for r in data]), strict=True)}
    got = collisions.near_duplicates(frame(spark, data)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == want and len(got) == len(data)
    assert want[9008][0] == want[9013][0] == 1 and max(x[0] for x in want.values()) >= 60


def test_near_vectors_repeated_and_absent(spark):
    v = [1.0] * 8
    got = collisions.near_duplicates(frame(spark, [(1, v, 0), (1, v, 0), (2, v, 0), (None, v, 0), (3, v, 1)])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
    assert collisions.near_duplicates(frame(spark, [])).count() == 0
    assert collisions.near_duplicates(frame(spark, ODD[:6])).where("n_links = 0 and kept").count() == 6


@pytest.mark.parametrize("width", [8, 64, 300])
def test_collision_counts_keep_the_recall(width):
    """Pairs just above the least similarity: far fewer than one in a thousand is lost, and unrelated pairs rarely pass."""
    rng = np.random.default_rng(width)
    x = collisions.units(rng.standard_normal((2000, width)))
    side = rng.standard_normal((2000, width))
    side = collisions.units(side - (side * x).sum(axis=1, keepdims=True) * x)
    y = 0.9301 * x + math.sqrt(1 - 0.9301**2) * side
    half, count = collisions.calibrated(0.93)
    along = collisions.directions(width)
    got = collisions.Windows(y, along).collisions(x @ along, half)
    plain = (np.abs((x @ along)[:, None, :] - (y @ along)[None, :50, :]) <= half).sum(axis=2)
    assert (got[:, :50] == plain).all()
    assert (np.diag(got) >= count).mean() > 0.998
    if width > 8:
        assert (got >= count).mean() < 0.01


def test_near_vectors_match_sql(spark):
    rows = [r for r in some_vectors(80) if r[0] is not None]
    con = pa.table({"vec_id": pa.array([r[0] for r in rows]), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())})
    same(collisions.near_duplicates(frame(spark, rows)).toPandas(), duck(collisions.ORACLE, embeddings=con), ["vec_id"])


# -- 12


def plain_clusters(rows):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted((r for r in kept if r[0] is not None), key=key)[:16]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    place = lambda: [min(range(len(centroids)), key=lambda k: (away(v, centroids[k]), k)) for _, v in kept]
    for _ in range(3):
        where = place()
        for k in range(len(centroids)):
            own = [v for (_, v), w in zip(kept, where, strict=True) if w == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    where = place()
    far = [away(v, centroids[k]) for (_, v), k in zip(kept, where, strict=True)]
    inertia = [sum(d for d, w in zip(far, where, strict=True) if w == k) for k in range(len(centroids))]
    return sorted(((i if i is not None else -1), k, d, inertia[k], sum(far), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for (i, _), k, d in zip(kept, where, far, strict=True))


@pytest.mark.parametrize("rows,leaf,scale", [(8192, 32, 1), (40, 4, 1), (64, 8, 0.02)])
def test_clusters_are_those_of_plain_rounds(spark, monkeypatch, rows, leaf, scale):
    monkeypatch.setattr(balls, "ROWS", rows)
    monkeypatch.setattr(balls, "LEAF", leaf)
    data = [(i, [x * scale for x in v], k) for i, v, k in some_vectors()] + [r for r in ODD if not r[1] or abs(r[1][0] or 0) < 1e6] + [(None, [0.5] * 64, 0), (5, [0.25] * 64, 0)]
    got = [tuple(r) for r in balls.clusters(frame(spark, data)).na.fill(-1, ["vec_id"]).collect()]
    assert sorted(got) == plain_clusters(data)


def test_few_or_odd_vectors_have_clusters(spark):
    assert balls.clusters(frame(spark, [])).count() == balls.clusters(frame(spark, ODD[:6])).where("vec_id <> 9001").count() == 0
    got = balls.clusters(frame(spark, [(1, [0.0] * 64, 0), (2, [1e30] * 64, 0), (3, [0.0] * 64, 0)])).collect()
    assert sorted(r["distance"] for r in got) == [0, 0, 0] and len({r["cluster"] for r in got}) == 2


def test_balls_give_whole_nodes_and_few_leaves():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 64))
    points = (centres[rng.integers(0, 16, 3000)] + rng.integers(-20, 20, (3000, 64))).astype(np.int32)
    tree = balls.Tree.of(pa.array(np.arange(3000)), points)
    whole, leaves = tree.reached(centres)
    assert sum(tree.nodes[n, 1] - tree.nodes[n, 0] for n, _ in whole) > 2500 and len(whole) < 200
    counts, sums = tree.gathered(centres)
    number = np.square(points[:, None].astype(np.int64) - centres[None]).sum(axis=2).argmin(axis=1)
    assert counts.tolist() == np.bincount(number, minlength=16).tolist()
    assert (sums == np.stack([points[number == k].sum(axis=0) for k in range(16)])).all()
    assert sorted(tree.ids.to_pylist()) == list(range(3000)) and len(leaves) < 40


def test_clusters_match_sql(spark):
    rows = some_vectors(120)
    con = pa.table({"vec_id": pa.array([r[0] for r in rows]), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())})
    same(balls.clusters(frame(spark, rows)).toPandas(), duck(balls.ORACLE, embeddings=con), ["vec_id"])


# -- 13

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, term string, count bigint, docs bigint, value bigint, rank int"


def some_documents():
    rng = np.random.default_rng(8)
    words = "mill Stone river WATER straße don't x1y été 中文 a grain 'loom' slow-wheel".split() + [f"rare{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 25)), p=[0.06] * 13 + [0.011] * 20)), ["en", "de", None][i % 3], f"s{rng.integers(0, 4)}") for i in range(120)]
    rows += [(200, None, "en", "s9"), (201, "", "en", None), (202, "1 2 3", "fr", "s0"), (203, "alone", "it", "s0"), (204, "x", "it", "s1"), (205, "A" * 50_000 + " mill" * 9000, "en", "s1"), (None, "mill", None, None)]
    return rows + rows[:5]


def plain_divergence(rows):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = [t for t, n in Counter(t for d in own for t in set(d[2])).items() if n >= 3]

        def shares(which, own=own, kept=kept):
            c = Counter(t for d in own if which(d) for t in d[2])
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}, c

        f = lambda p, q: (p - q) ** 2 // q
        whole, _ = shares(lambda d: True)
        parts = {s: shares(lambda d, s=s: d[1] == s) for s in {d[1] for d in own}}
        for s, (p, c) in parts.items():
            pair = [(o, sum(f(p[t], q[t]) for t in kept)) for o, (q, _) in parts.items() if o != s]
            term = [(t, f(p[t], whole[t])) for t in kept if c[t] and p[t] > whole[t]]
            for part, items, most in (("pair", pair, None), ("term", term, 200)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(items, 1)]
    return sorted(out)


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 1, 1, 1, 1) for r in rows], DOCS).repartition(3)


@pytest.mark.parametrize("sources,entries,piece", [(1024, 500_000, 4_000_000), (2, 10, 100)])
def test_divergence_is_that_of_a_plain_loop(spark, monkeypatch, sources, entries, piece):
    for name, value in (("SOURCE_ROWS", sources), ("ENTRIES", entries), ("SLICE", piece)):
        monkeypatch.setattr(divergence, name, value)
    rows = some_documents()
    got = sorted(tuple(r) for r in divergence.divergence(documents(spark, rows)).collect())
    assert got == plain_divergence(rows)
    assert divergence.divergence(documents(spark, [])).count() == 0


def test_divergence_ranks_of_terms_end(spark):
    words = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(400)]
    rows = [(i, " ".join(words), "en", "a") for i in range(3)] + [(9, "aa aa aa zz", "en", "b")]
    got = divergence.divergence(documents(spark, rows)).toPandas()
    counts = defaultdict(int, got.groupby(["source", "part"]).size().to_dict())
    assert counts["a", "term"] == 200 and counts["b", "term"] == 1 and counts["a", "pair"] == 1
    assert sorted(map(tuple, got.itertuples(index=False))) == plain_divergence(rows)


def test_divergence_matches_sql(spark):
    got = divergence.query(spark, DATA).toPandas()
    want = duck(divergence.ORACLE, documents=pd.read_parquet(f"{DATA}/documents.parquet"))
    same(got, want, ["lang", "source", "part", "rank"])
