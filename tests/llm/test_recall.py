"""Links of op8 and op7 against every pair of a table, computed without their candidates."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

from tessera.llm import embedding, near_dup

SF = "/root/testdata/sf0.001"


def distance(a: list[str], b: list[str]) -> int:
    """The plain edit distance in words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def similar(a: list[str], b: list[str]) -> bool:
    longer = max(len(a), len(b))
    if not a or not b or min(len(a), len(b)) < 0.8 * longer - 1e-9:
        return False
    apart = longer - sum(min(a.count(w), b.count(w)) for w in set(a))
    return apart <= 0.2 * longer + 1e-9 and distance(a, b) <= 0.2 * longer + 1e-9


def groups(pairs, ids):
    """The least id of each id's component."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        one, two = root(a), root(b)
        parent[max(one, two)] = min(one, two)
    return {i: root(i) for i in ids}


def test_groups_of_a_table_equal_those_of_all_pairs(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    words = {i: (t or "").lower().split() for i, t in zip(docs.doc_id, docs.text, strict=True)}
    ids = sorted(words)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if similar(words[a], words[b])]
    found = {r.doc_id: r.component_id for r in near_dup.op8_order_minhash(spark, SF).collect()}
    assert pairs and found == groups(pairs, ids)


def test_pairs_near_the_threshold_are_found(spark):
    pick = random.Random(8)
    rows, ids = [], []
    for n, size in enumerate([12, 20, 30, 40, 60, 90, 150] * 12):
        text = [f"w{pick.randrange(5000)}" for _ in range(size)]
        other = list(text)
        for at in pick.sample(range(size), int(0.2 * size)):
            other[at] = f"x{n}q{at}"
        rows += [(2 * n, " ".join(text)), (2 * n + 1, " ".join(other))]
        ids.append((2 * n, 2 * n + 1))
    found = {r.id: r.component_id for r in near_dup.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[a] == found[b] for a, b in ids) >= 0.95 * len(ids)
    assert len(set(found.values())) >= len(ids)


def test_vector_links_with_production_parameters_reach_recall(spark, tmp_path):
    made = np.random.default_rng(7)
    centres = made.normal(size=(150, 48))
    vectors, labels = [], []
    for n, c in enumerate(centres):
        for _ in range(3):
            # Noise that leaves pairs of a centre a little above or below the threshold.
            vectors.append(c + made.normal(size=48) * 0.24)
            labels.append(f"l{n % 3}")
    rows = [(i, [float(x) for x in v], labels[i]) for i, v in enumerate(vectors)]
    source = pd.read_parquet(f"{SF}/embeddings.parquet").columns
    vector = next(c for c in source if c not in ("vec_id", "label"))
    os.makedirs(tmp_path / "t", exist_ok=True)
    spark.createDataFrame(rows, f"vec_id long, {vector} array<double>, label string").write.parquet(f"{tmp_path}/t/embeddings.parquet")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    same = np.array(labels)[:, None] == np.array(labels)[None, :]
    linked = (x @ x.T >= 0.93) & same & ~np.eye(len(x), dtype=bool)
    found = {r.vec_id: r.n_links for r in embedding.op7_p_stable_vectors(spark, f"{tmp_path}/t").collect()}
    assert linked.sum() > 100
    assert all(found[i] <= int(linked[i].sum()) for i in found)
    assert sum(found.values()) >= 0.98 * linked.sum()


def test_blocks_of_one_large_component_meet_the_other_rows_only(spark):
    """F-pipeline: copies joined already are not dealt to each other, and every pair of two components meets once."""
    size = 8
    for sizes in ([400, 1, 2], [30, 30, 25, 1], [5, 2], [1] * 40):
        placed = [(7, 3, node, c) for c, n in enumerate(sizes) for node in range(1000 * c, 1000 * c + n)]
        got = near_dup._dealt(spark.createDataFrame([*placed, (8, 3, 5, 5), (8, 3, 6, 5)], "bucket long, part int, node long, component long"), size).collect()
        assert {r.bucket for r in got} == {7}
        rest = sum(sizes) - max(sizes)
        assert len(got) <= 2 * sum(sizes) * -(-max(rest, 1) // size)
        tasks = defaultdict(list)
        for r in got:
            tasks[min(r.block, r.other), max(r.block, r.other)].append(r)
        met = Counter()
        for (low, high), held in tasks.items():
            left, right = [r for r in held if r.block == low], [r for r in held if r.block == high]
            met.update({frozenset((a.node, b.node)) for a in left for b in right if a.component != b.component})
        wanted = {frozenset((a[2], b[2])) for a in placed for b in placed if a[3] < b[3]}
        assert met == Counter(wanted)
