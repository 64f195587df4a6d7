import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeworks.llm import neardup as N

WORD = re.compile(r"[^\W_]+")
FINDING = "id bigint, findings array<struct<finding_id:bigint,summary:string,extra:string>>, finding_id string"


def brute(texts, num=N.NUM, den=N.DEN):
    sets = [(i, frozenset(WORD.findall(t.lower()))) for i, t in texts if t and WORD.search(t)]
    out = set()
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i != j and len(a & b) * den >= num * len(a | b):
                out.add((min(i, j), max(i, j)))
    return out


def corpus(seed, n, vocab, size):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocab)]
    out = []
    for i in range(n):
        if out and rnd.random() < 0.4:
            base = rnd.choice(out)[1].split()
            for _ in range(rnd.randint(0, 4)):
                op = rnd.random()
                if op < 0.4 and base:
                    base[rnd.randrange(len(base))] = rnd.choice(words)
                elif op < 0.7:
                    base.insert(rnd.randrange(len(base) + 1), rnd.choice(words))
                elif len(base) > 1:
                    base.pop(rnd.randrange(len(base)))
            rnd.shuffle(base)
            out.append((i, " ".join(base)))
        else:
            out.append((i, " ".join(rnd.choice(words) for _ in range(rnd.randint(*size)))))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, [(i, t, "x")], "clash") for i, t in texts], FINDING)


def test_equal_to_brute_force_on_a_crowded_vocabulary(spark, monkeypatch):
    # few words, so that many signatures are dense and the tree descends several levels
    monkeypatch.setattr(N, "LEAST_DENSE", 4)
    texts = corpus(3, 700, 60, (3, 25))
    got = {tuple(r) for r in N.finding_pairs(frame(spark, texts)).collect()}
    assert got == brute(texts)


def test_edges_of_the_input(spark):
    texts = [(1, "Alpha beta"), (2, "beta ALPHA!"), (3, None), (4, ""), (5, "..."), (6, "solo"), (7, "solo"), (8, "a b c d e f g h i j"), (9, "a b c d e f g x y z"), (10, "x" * 20000)]
    df = frame(spark, texts).unionByName(frame(spark, [(1, "Alpha beta")]))
    got = sorted(tuple(r) for r in N.finding_pairs(df).collect())
    assert got == [(1, 2), (6, 7)]
    assert N.finding_pairs(frame(spark, []).limit(0)).count() == 0
    null = spark.createDataFrame([(1, None, "c"), (2, [None], "c"), (3, [(None, "a b", "x")], "c")], FINDING)
    assert N.finding_pairs(null).count() == 0


def test_groups_give_one_row_a_finding(spark):
    base = "one two three four five six seven eight nine ten"
    texts = [(1, base), (2, base.replace("ten", "eleven")), (3, base), (4, "quite other words here"), (5, base.replace("one", "uno"))]
    got = {r.finding_id: (r.class_id, r.links, r.group_id) for r in N.finding_groups(frame(spark, texts)).collect()}
    assert got == {1: (1, 2, 1), 3: (1, 2, 1), 2: (2, 1, 1), 5: (5, 1, 1), 4: (4, 0, 4)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.group for r in N.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 12), min_size=1, max_size=9), min_size=2, max_size=40), st.integers(1, 3))
def test_filters_never_lose_a_pair(sets, blocks):
    import pyarrow as pa

    lists = pa.array([[int(x) * 7919 for x in s] for s in sets], pa.list_(pa.int32()))
    values, counts = np.unique(np.array([x * 7919 for s in sets for x in s], dtype=np.int32).view(np.uint32), return_counts=True)
    often = counts > 3
    own = N.Ordered(lists, values[often], counts[often], N.NUM, N.DEN)
    dense = [N.hash_filter(N.level_one(values[often]))]
    giant = [N.hash_filter(N.level_one(values[counts > 6]))]
    for level in (2, 3):
        _, sig, _ = own.signatures(dense, level)
        s, k = np.unique(sig, return_counts=True)
        dense.append(N.hash_filter(s[k > 3]))
        giant.append(N.hash_filter(s[k > 6]))
    record, sig, cap = own.signatures(dense, giant=giant, blocks=blocks)
    order = np.argsort(sig, kind="stable")
    a, b = N.group_pairs(sig[order], record[order], own.size[record][order], cap[order], own.bitmaps()[record][order])
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) * N.DEN >= N.NUM * len(sets[i] | sets[j])}
    assert want <= found


def similar_bits(seed, n):
    rnd = np.random.default_rng(seed)
    bits = rnd.integers(0, 2**63, (n, 2), dtype=np.uint64) & rnd.integers(0, 2**63, (n, 2), dtype=np.uint64)
    bits[n // 2 :] = bits[: n - n // 2] ^ (np.uint64(1) << rnd.integers(0, 60, (n - n // 2, 1), dtype=np.uint64))
    size = np.bitwise_count(bits).sum(1).astype(np.int64)
    return np.tile(rnd.integers(0, 3, n // 2), 2).astype(np.uint64), size, size - rnd.integers(0, 9, n), bits


def test_forest_equals_flat_comparison():
    sig, size, cap, bits = similar_bits(5, 900)
    i, j = N.SignatureForest(sig, size, cap, bits).pairs()
    shared = np.bitwise_count(bits[:, None] & bits[None]).sum(-1)
    shared = np.minimum(shared, np.minimum(cap[:, None], cap[None]))
    flat = np.nonzero(np.triu((shared * 17 >= 7 * (size[:, None] + size[None])) & (sig[:, None] == sig[None]), 1))
    key = lambda a, b: sorted(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))
    assert key(i, j) == key(*flat) and len(i) > 50
    assert not len(N.SignatureForest(sig[:0], size[:0], cap[:0], bits[:0]).pairs()[0])
    assert not len(N.SignatureForest(sig[:1], size[:1], cap[:1], bits[:1]).pairs()[0])


def test_the_traversal_prunes_nodes_and_decides_the_candidates(monkeypatch):
    """Without the pruning of node pairs every pair of a node's records is a candidate; with it few are left."""
    import pyarrow as pa

    texts = corpus(11, 3000, 400, (12, 40))
    sets = [sorted(set(t.split())) for _, t in texts]
    lists = pa.array([[int(w[1:]) * 7919 + 1 for w in s] for s in sets], pa.list_(pa.int32()))
    own = N.Ordered(lists, np.zeros(0, np.uint32), np.zeros(0, np.int64), N.NUM, N.DEN)
    record, sig, cap = own.signatures([])
    order = np.argsort(sig, kind="stable")
    args = sig[order], own.size[record][order], cap[order], own.bitmaps()[record][order]
    tree = N.SignatureForest(*args)
    found = len(tree.pairs()[0])
    flat = sum(k * (k - 1) // 2 for k in np.unique(sig, return_counts=True)[1].tolist())
    assert sum(tree.kept[1:]) < 0.7 * sum(tree.tested[1:])  # pairs of inner nodes that are left
    assert tree.tested[0] < 0.6 * flat and found < 0.05 * flat
    monkeypatch.setattr(N.SignatureForest, "possible", lambda self, level, a, b: np.arange(len(a)))
    blind = N.SignatureForest(*args)
    assert len(blind.pairs()[0]) == blind.tested[0] == flat


def test_words_ignore_case_and_marks(spark):
    df = spark.createDataFrame([("Größe_größe 12µm, É-é",)], "t string")
    assert df.select(N.words(F.col("t"))).first()[0] == ["größe", "12µm", "é"]


def test_components_of_a_chain_with_a_far_smaller_label(spark):
    edges = spark.createDataFrame([(0, 150)] + [(i, i + 1) for i in range(1, 150)], "a bigint, b bigint")
    assert {(r.node, r.group) for r in N.components(edges, rounds=20).collect()} == {(i, 0) for i in range(151)}
    with pytest.raises(RuntimeError):
        N.components(edges, rounds=1)


def test_one_id_with_two_texts_counts_with_each(spark):
    one, two = "a b c d e f g h i j", "k l m n o p q r s t"
    texts = [(1, one), (1, two), (2, one), (3, two), (4, one + " x"), (5, two + " y"), (6, "quite other words")]
    got = {tuple(r) for r in N.finding_pairs(frame(spark, texts)).collect()}
    assert got == brute(texts) == {(1, 2), (1, 3), (1, 4), (1, 5), (2, 4), (3, 5)}
    rows = {r.finding_id: (r.class_id, r.links, r.group_id) for r in N.finding_groups(frame(spark, texts)).collect()}
    assert rows == {1: (1, 1, 1), 2: (1, 1, 1), 3: (3, 1, 1), 4: (4, 1, 1), 5: (5, 1, 1), 6: (6, 0, 6)}


def shuffled_chain(seed, n, start=0):
    names = list(range(start, start + n))
    random.Random(seed).shuffle(names)
    return list(zip(names, names[1:]))


def test_components_of_shuffled_chains(spark):
    edges = spark.createDataFrame(shuffled_chain(1, 1000) + shuffled_chain(2, 1500, 5000), "a bigint, b bigint")
    got = {r.node: r.group for r in N.components(edges, rounds=20).collect()}
    assert got == {**{i: 0 for i in range(1000)}, **{i: 5000 for i in range(5000, 6500)}}


def test_hot_class_and_groups_against_union_find(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAST_DENSE", 4)
    monkeypatch.setattr(N, "MOST_NODE", 8)
    texts = corpus(7, 250, 40, (2, 14)) + [(1000 + i, "same few words") for i in range(120)]
    got = {tuple(r) for r in N.finding_pairs(frame(spark, texts)).collect()}
    assert got == brute(texts)
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in got:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {r.finding_id: r.group_id for r in N.finding_groups(frame(spark, texts)).collect()}
    assert groups == {i: find(i) for i, t in texts}
    members = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 7)], "rid bigint, id bigint")
    assert sorted(tuple(r) for r in N.within_classes(members, block=6).collect()) == [(i, j) for i in range(50) for j in range(i + 1, 50)]
