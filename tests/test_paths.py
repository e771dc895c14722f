"""The best paths equal those of a full enumeration, without making it."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from spoorline.operators import attack, graph, graphalgo, paths


def brute(edges, ranks, cutoff, per_pair):
    out = {}

    def walk(path, scores):
        if scores and path[-1] in ranks and ranks[path[-1]] > ranks[path[0]]:
            score = (0.7 * max(scores) + 0.3 * sum(scores) / len(scores)) / math.log2(len(scores) + 2)
            out.setdefault((path[0], path[-1]), []).append((-round(score, 9), path))
        if len(scores) < cutoff:
            for s, d, w in edges:
                if s == path[-1] and d not in path:
                    walk((*path, d), (*scores, w))

    for key in ranks:
        walk((key,), ())
    return {(pair, path) for pair, found in out.items() for _, path in sorted(found)[:per_pair]}


@pytest.mark.parametrize("seed,levels,per_pair", [(0, None, 3), (1, 2, 3), (2, 1, 2), (3, 3, 1)])
def test_equal_to_enumeration(spark, seed, levels, per_pair):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(11)]
    pairs = rng.sample(list(itertools.permutations(names, 2)), 42)
    edges = [(s, d, rng.choice(range(levels)) / 4 if levels else rng.uniform(-1, 3)) for s, d in pairs]
    ranks = {name: i + 1 for i, name in enumerate(rng.sample(names, 4))}
    got = paths.best_paths(
        spark.createDataFrame([*edges, ("n00", "n00", 9.0), ("n00", "n01", None)], "src_key string, dst_key string, score double"),
        spark.createDataFrame(list(ranks.items()), "entity_key string, rank int"), cutoff=6, per_pair=per_pair, places=9)
    assert {((r["first"], r["last"]), tuple(r["path"])) for r in got.collect()} == brute(edges, ranks, 6, per_pair)


@pytest.mark.parametrize("equal", [True, False])
def test_layers_are_not_enumerated(spark, monkeypatch, equal):
    """Five layers of eight nodes between two keys have 8^5 = 32,768 paths; a round keeps some hundred beginnings."""
    rng = random.Random(4)
    layers = [["a"], *[[f"{c}{i}" for i in range(8)] for c in "bcdef"], ["z"]]
    rows = [(s, d, 1.0 if equal else rng.random()) for x, y in itertools.pairwise(layers) for s in x for d in y]
    rows += [(f"g{i}", "a", 1.0) for i in range(14)]
    stored = []
    monkeypatch.setattr(paths, "cut", lambda df: (stored.append((kept := graphalgo.cut(df)).count()), kept)[1])
    edges = spark.createDataFrame(rows, "src_key string, dst_key string, score double")
    keys = spark.createDataFrame([("a", 1), ("z", 2)], "entity_key string, rank int")
    got = [tuple(r["path"]) for r in paths.best_paths(edges, keys, places=9).orderBy(F.round("score", 9).desc(), "path").collect()]
    weight = {(s, d): w for s, d, w in rows}
    score = lambda p: round((0.7 * max(weight[e] for e in itertools.pairwise(p)) + 0.3 * sum(weight[e] for e in itertools.pairwise(p)) / 6) / 3, 9)
    assert got == sorted(itertools.product(*layers), key=lambda p: (-score(p), p))[:3]
    assert max(stored) < 1500


def test_hub_groups_are_read_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("a", f"m{i}", rng.random()) for i in range(700)] + [(f"m{i}", "h", rng.random()) for i in range(700)] + [("h", "z", 0.5), ("h", "m3", 0.9), ("m3", "z", 0.8)]
    edges = spark.createDataFrame(rows, "src_key string, dst_key string, score double")
    keys = spark.createDataFrame([("a", 1), ("z", 2)], "entity_key string, rank int")
    got = paths.best_paths(edges, keys, cutoff=4)
    assert {(("a", "z"), tuple(r["path"])) for r in got.collect()} == brute(rows, {"a": 1, "z": 2}, 4, 3)


def test_least_score_and_no_edges(spark, events):
    edges = graph.simple_digraph(events([("a", "b", 0, "t", 1), ("b", "c", 1, "t", 0.1), ("a", "c", 2, "t", 0.2)]))
    keys = spark.createDataFrame([("a", 1), ("c", 2)], "entity_key string, rank int")
    assert [tuple(r["path"]) for r in attack.attack_paths(edges, keys, min_score=0.3).collect()] == [("a", "b", "c")]
    assert attack.attack_paths(edges.limit(0), keys).count() == 0
