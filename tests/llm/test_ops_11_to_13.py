"""Prefix trie, streaming encoding and ranked search against brute force, libraries and edge cases."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opinionlake.llm import bpe_stream, prefix_trie, ranked_search
from opinionlake.llm.queries import QUERIES, prepare, rebuilt, tokenizer_path

DIR = "/root/testdata/sf0.001"
WORDS = tokenizer_path("word_bpe_49k.json")


def plain_rebuilt(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + turns[c][h:]
    return out


def plain_trie(convs):
    """Every prefix of every conversation, and sums over all longer prefixes that begin with it."""
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1].encode()) if p else 0
    rows = set()
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(p))
        rows.add((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return rows


NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rows_of(df, names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_op11(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{DIR}/conversations.parquet'").fetchall()
    assert rows_of(QUERIES["op11_prefix_trie"](spark, DIR), NAMES) == sorted(plain_trie(plain_rebuilt(rows)), key=repr)


@pytest.mark.parametrize("limit", [4096, 3, 1])
def test_trie_edges_and_spark_rounds(spark, limit):
    """Nulls, ties, gaps, repeated rows, turnless conversations, negative ids; with a small limit the components are split in Spark."""
    prepare(spark)
    rng = random.Random(limit)
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, None, "user", None), (7, 3, "user", "x"), (7, 3, "user", "x"), (7, 3, "assistant", "a"), (-8, 2, "user", "é" * 9)]
    rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice("ab")) for c in range(20, 60) for t in rng.sample(range(90_000), rng.randint(1, 6))]
    rows += [(c, t, "user", "same") for c in range(100, 130) for t in range(12)]
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, owner int")
    want = plain_rebuilt(rows)
    assert any(not t for t in want.values())
    seen, convs = rebuilt(turns)
    assert rows_of(prefix_trie.trie(seen, convs, limit), NAMES) == sorted(plain_trie(want), key=repr)


def test_trie_of_a_long_conversation(spark):
    """One conversation holds most turns: a chain, split over blocks and rounds."""
    prepare(spark)
    rows = [(0, t, "user", str(t)) for t in range(9000)] + [(c, t, "user", str(t)) for c in (1, 2) for t in range(c * 3)]
    turns = prefix_trie.ordered(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {(r["conv_id"], r["depth"]): r for r in prefix_trie.trie(turns, turns.select("conv"), 2000).collect()}
    assert len(got) == 9001 and got[0, 0]["n_convs"] == 3 and got[0, 3]["n_convs"] == 3 and got[0, 6]["n_convs"] == 2
    assert {r["n_leaves"] for r in got.values()} == {1}
    assert [got[0, d]["saved_tokens"] for d in (0, 3, 4, 6, 7)] == [9, 5, 3, 1, 0]


def test_trie_of_nothing(spark):
    prepare(spark)
    turns, convs = rebuilt(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))
    assert prefix_trie.trie(turns, convs).collect() == []


@given(st.lists(st.integers(0, 10**6), max_size=40))
@settings(max_examples=60, deadline=None)
def test_centroid_sums(picks):
    parent = [-1] + [p % (i + 1) for i, p in enumerate(picks)]
    weights = [(i * i + 1, 1) for i in range(len(parent))]
    want = [list(w) for w in weights]
    for v in range(len(parent) - 1, 0, -1):
        want[parent[v]] = [a + b for a, b in zip(want[parent[v]], want[v], strict=True)]
    assert prefix_trie.centroid_sums(parent, weights) == want


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def test_op12(spark):
    tokenizer = library()
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall()
    want = set()
    for d, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.add((d, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in QUERIES["op12_bpe_round_trip"](spark, DIR).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def ids_of(parts):
    return np.frombuffer(b"".join(parts), np.int32).tolist()


def test_long_words_and_parts():
    tokenizer, encoder = library(), bpe_stream.Encoder(WORDS)
    rng = random.Random(4)
    known = [t.removesuffix("</w>") for t in tokenizer.get_vocab() if t.isascii() and t.removesuffix("</w>").isalpha()]
    texts = ["".join(rng.choice(known) for _ in range(3000)), "a" * 10_001, "".join(rng.choice("thean") for _ in range(9000))]
    texts += ["".join(rng.choice("aeht'srellvé́가中国Σİ٣9!…՘\x85　\x1c") for _ in range(6000)) for _ in range(4)]
    texts += ["", "'", "x'", "<|endoftext|>A<|startoftext|>", "a <|endoftext", "It'S\n'RE\tdon't \r é́"]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.ids(text) == np.array(want, np.int32).tobytes()
        if "<|" not in text:
            for size in (1, 3, 7, 1000):
                assert ids_of(encoder._long(text, size)) == want, (text[:40], size)


@st.composite
def merge_lists(draw):
    """Lists whose merges use what earlier ones make."""
    known, merges = ["a", "b", "c"], []
    for _ in range(draw(st.integers(1, 12))):
        pair = draw(st.sampled_from(known)), draw(st.sampled_from(known))
        if pair not in merges and len(pair[0] + pair[1]) < 9:
            merges.append(pair)
            known = [*known, "".join(pair)] if "".join(pair) not in known else known
    return known, merges


@given(merge_lists(), st.text("abc", min_size=1, max_size=200), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_lookahead_is_sufficient(made, text, step):
    """What the transducer emits early is what the whole word's merging gives, for any merge list and any cut of the input."""
    known, merges = made
    vocab = {t: i for i, t in enumerate(known)}
    table = bpe_stream.Merges(vocab, merges)
    run = bpe_stream.Transducer(table, {i: len(t) for t, i in vocab.items()}, window=1)
    got = [i for at in range(0, len(text), step) for i in run.feed(text[at : at + step])]
    held = len(run.held)
    got += run.end()
    word = [vocab[c] for c in text]
    assert got == table._apply_long(word) == table.apply(list(word))
    assert held <= run.window + step


def test_unordered_merges_are_refused():
    with pytest.raises(ValueError, match="no earlier"):
        bpe_stream.Merges({"a": 0, "b": 1, "ab": 2, "aab": 3}, [("a", "ab"), ("a", "b")])


def test_detokenizer_holds_back():
    encoder, machine = bpe_stream.Encoder(WORDS), bpe_stream.detokenizer(WORDS, "text")
    ids = ids_of([encoder.ids("Grüße 😀ﷺ, <|endoftext|> bye")])
    assert "".join(machine.feed([i]) for i in ids) + machine.end() == "grüße 😀 ﷺ , <|endoftext|>bye "
    letters = bpe_stream.detokenizer(WORDS, "letters")
    assert "".join(letters.feed([i]) for i in ids) + letters.end() == library().decode(ids, skip_special_tokens=False)


def test_encode_edges(spark):
    prepare(spark)
    docs = spark.createDataFrame([(None, None, 1), (None, "", 2), (2, "Hi hi", 3), (2, "Hi hi", 3)], "doc_id bigint, text string, ids int")
    got = bpe_stream.decode(bpe_stream.encode(docs, WORDS), WORDS).collect()
    assert collections.Counter((r["doc_id"], len(r["ids"]), r["decoded"]) for r in got) == {(None, 0, ""): 2, (2, 2, "hi</w> hi</w>"): 2}
    assert bpe_stream.encode(docs.limit(0), WORDS).collect() == []


def plain_ranked(docs, items, k=20):
    fold = lambda t: ranked_search.TERM.findall((t or "").translate(ranked_search._FOLD))
    counts = [(d, collections.Counter(fold(t))) for d, t in docs]
    sizes = [c.total() for _, c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for _, c in counts for t in c)
    out = set()
    for item, text in items:
        scores = []
        for (d, c), n in zip(counts, sizes, strict=True):
            score = 0
            for t, times in collections.Counter(fold(text)).items():
                if c[t]:
                    m = 75 + (25 * n * n_docs) // n_terms
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, d is None, d if d is not None else 0))
        out |= {(item, i + 1, None if missing else d, -s) for i, (s, missing, d) in enumerate(sorted(scores)[:k])}
    return out


RANKED = ("item_id", "rank", "doc_id", "score")


def test_op13(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{DIR}/benchmark.parquet'").fetchall()
    assert rows_of(QUERIES["op13_ranked_search"](spark, DIR), RANKED) == sorted(plain_ranked(docs, items), key=repr)


def test_ranked_edges(spark):
    """Nulls, texts without terms, repeated rows, ties, clashing columns, items without terms and with equal ids."""
    prepare(spark)
    docs = [(None, "tie word"), (5, "tie word"), (3, "tie word"), (3, "tie word"), (9, None), (8, " .,! "), (1, "Éa ÉA x" + " word" * 50), (4, "ÀÉ lone"), (6, "x_y WORD")]
    items = [(1, "Word word x"), (1, "lone"), (2, None), (3, "none of these"), (4, "ÉA"), (4, "ÉA"), (None, "tie")]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id bigint, text string, block int, n int")
    i = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id bigint, text string, place int, term int")
    for k in (20, 2, 1):
        assert rows_of(ranked_search.search(d, i, k=k), RANKED) == sorted(plain_ranked(docs, sorted(set(items), key=repr), k), key=repr)
    assert ranked_search.search(d.limit(0), i).collect() == [] == ranked_search.search(d, i.limit(0)).collect()
    # Ids of any ordered type.
    s = d.selectExpr("cast(doc_id as string) as doc_id", "text")
    assert {(r["item_id"], r["doc_id"]) for r in ranked_search.search(s, i, k=1).collect()} == {(1, "6"), (1, "4"), (4, "1"), (None, "3")}


@pytest.mark.parametrize("most", [10**6, 10**12])
def test_dual_tree_skips_and_is_exact(most):
    """Alike documents stand together: most batches are skipped, and the best are those of all products. Beyond 2**53 whole numbers are used."""
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(range(g * 40, g * 40 + 40), 6, replace=False)), rng.integers(1, 30_000, 6)) for g in range(10) for _ in range(12)]
    matrix = np.zeros((1024, 400), np.int64)
    for d in range(1024):
        g = d * 10 // 1024
        matrix[d, g * 40 : g * 40 + 40] = rng.integers(0, 10**6, 40) * (rng.random(40) < 0.3)
    search = ranked_search.Search(rows, np.zeros(len(rows), np.int64), 20, most)
    search.add(matrix.astype(search.kind), list(range(1024)))
    for (columns, weights), best in zip(rows, search.best, strict=True):
        scores = matrix[:, columns] @ weights
        assert [(-s, i) for s, _, i in best] == sorted(((s, i) for i, s in enumerate(scores.tolist()) if s > 0), key=lambda x: (-x[0], x[1]))[:20]
    assert search.skipped > search.opened


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(ranked_search, "_PART", 10)
    text = "ab Cd-ef ÉÉ " * 40 + "x" * 50
    assert ranked_search.term_counts(text) == collections.Counter(ranked_search.TERM.findall(text))
