"""Near copies of the pipeline's stage against brute force over all pairs."""

import collections
import itertools
import random

import corpus_pipeline
from opinionlake.llm import near_copies
from opinionlake.llm.queries import prepare


def plain_groups(texts, n=5):
    """Smallest id of each row's component, from all pairs of shingle sets."""
    sets = {}
    for d, t in texts.items():
        w = (t or "").lower().split()
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    label = {d: d for d in texts}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    pairs = 0
    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            pairs += x != y
            i, j = find(a), find(b)
            label[max(i, j)] = min(i, j)
    return {d: find(d) for d in texts}, pairs


def corpus():
    rng, texts = random.Random(8), {}
    for g in range(60):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.randint(30, 300))]
        texts[len(texts)] = " ".join(base)
        for _ in range(rng.randint(1, 4)):  # edited copies on both sides of the threshold
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(copy)
    return texts | {1000: None, 1001: "", 1002: "one", 1003: "One"}


def test_stage_links_similar_texts(spark):
    prepare(spark)
    texts = corpus()
    want, pairs = plain_groups(texts)
    assert pairs > 50
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    got = collections.Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect())
    assert got == collections.Counter(set(want.values()))
    assert near_copies.dedup(frame.limit(0)).count() == 0


def test_cells_and_chains(spark, monkeypatch):
    """A chain in which neighbours are alike, but few are alike to the leader, over many small cells."""
    prepare(spark)
    words = [f"w{i}" for i in range(1000)]
    texts = {i: " ".join(words[4 * i : 4 * i + 100]) for i in range(60)} | {100 + i: " ".join(words[600 + 30 * i : 660 + 30 * i]) for i in range(8)}
    want, _ = plain_groups(texts)
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    got = [r.doc_id for r in near_copies.dedup(frame, cell=4).collect()]
    assert sorted(got) == sorted(set(want.values()))


def test_one_stray_in_a_large_bucket(spark, monkeypatch):
    """Hundreds of near copies and a few texts that only share buckets with them: cells grow with the strays, and the groups are exact."""
    prepare(spark)
    monkeypatch.setattr(near_copies, "CELL", 16)
    words = [f"w{i}" for i in range(300)]
    texts = {i: " ".join([*words, f"x{i}"]) for i in range(300)}
    texts |= {1000 + i: " ".join([*words[: 230 + i], *[f"y{k}" for k in range(40)]]) for i in range(3)}
    want, _ = plain_groups(texts)
    assert len(set(want.values())) == 2
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    got = [r.doc_id for r in near_copies.dedup(frame, cell=16).collect()]
    assert sorted(got) == sorted(set(want.values()))
