"""Registered queries of the operators against brute force and SQL, over whole small tables."""

import collections
import hashlib
import zlib

import duckdb
import pytest
import xxhash

from opinionlake.llm import license_scan, mixing, simhash
from opinionlake.llm.queries import ORACLE, QUERIES, tokenizer_path

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


def rows_of(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, DIR).collect()]


def norm(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, con, name):
    got = rows_of(spark, name)
    cur = con.execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    want = [tuple(map(norm, r)) for r in cur.fetchall()]
    assert sorted(map(repr, [tuple(norm(r[c]) for c in cols) for r in got])) == sorted(map(repr, want))


def texts(con):
    return con.execute("SELECT doc_id, text, source FROM documents").fetchall()


def test_op1(spark, con):
    docs = texts(con)
    size = {d: len((t or "").encode().split()) for d, t, _ in docs}
    got = {r["doc_id"]: r for r in rows_of(spark, "op1_entropy_balanced_mixing")}
    assert {d: r["size"] for d, r in got.items()} == size
    by = collections.Counter()
    for d, _, s in docs:
        by[s] += size[d]
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(by.values()), set()
    while True:
        left = total - sum(3 * by[s] for s in capped)
        level = left / sum(w for s, w in weight.items() if s not in capped)
        new = {s for s in order if s not in capped and weight[s] * level > 3 * by[s]}
        if not new:
            break
        capped |= new
    target = {s: 3 * by[s] if s in capped else weight[s] * level for s in order}
    taken = collections.Counter()
    for d, _, s in docs:
        assert got[d]["source_size"] == by[s]
        assert got[d]["target"] == pytest.approx(target[s])
        assert 0 <= got[d]["taken"] <= 3 * size[d]
        assert got[d]["taken"] == got[d]["copies"] * size[d]
        taken[s] += got[d]["taken"]
    for s in order:
        # A source of ten documents can only be met up to a small document.
        assert abs(taken[s] - target[s]) <= max(0.01 * target[s], 50), s
    again = {r["doc_id"]: r for r in rows_of(spark, "op1_entropy_balanced_mixing")}
    assert again == got


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=3):
    """Brute force over all pairs: component by smallest id."""
    ids, parent = list(prints), {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_op3(spark, con):
    prints = {d: plain_print(t) for d, t, _ in texts(con)}
    want = classes(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows_of(spark, "op3_simhash_near_dedup")}
    assert got == {d: (f"{p:016x}", want[d]) for d, p in prints.items()}
    assert len(set(want.values())) < len(want)


def test_op4(spark, con):
    import re

    got = {r["doc_id"]: r for r in rows_of(spark, "op4_license_scans")}
    hits = 0
    for d, t, _ in texts(con):
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, labels = [], set()
        for n in license_scan.BASE:
            w = n.text.split()
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    places.append(i)
                    labels.add(n.label)
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(labels))
        assert labels <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1
        hits += bool(places)
    assert hits


def test_op5(spark, con):
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(tokenizer_path()), 0
    got = {r["doc_id"]: r for r in rows_of(spark, "op5_token_id_output")}
    for d, t, _ in sorted(texts(con)):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert got[d] == {"doc_id": d, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        start += len(ids)


def test_op6(spark, con):
    chats = collections.defaultdict(list)
    for c, turn, role, text in con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall():
        chats[c].append((turn, role, text or ""))
    chats[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in rows_of(spark, "op6_chat_formatting")}
    assert set(got) == set(chats)
    for c, turns in chats.items():
        turns.sort(key=lambda t: t[0])
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r["formatted_chars"] >= sum(len(t) for _, _, t in turns)


def test_op7(spark, con):
    import base64

    pages = {p: (h or "").encode() for p, h in con.execute("SELECT page_id, html FROM pages").fetchall()}
    top = collections.defaultdict(int)
    for p, h in pages.items():
        top[h] = max(top[h], p)
    got = {r["page_id"]: r for r in rows_of(spark, "op7_warc")}
    assert len(got) == len(pages)
    for p, h in pages.items():
        first = top[h] == p
        assert got[p] == {
            "page_id": p, "payload_bytes": len(h), "payload_digest": base64.b32encode(hashlib.sha1(h).digest()).decode(),
            "record_type": "response" if first else "revisit", "refers_to": None if first else top[h],
        }


def test_pipeline(spark, con):
    """Stage by stage against plain versions of what each keeps."""
    import corpus_pipeline
    from test_near_copies import plain_groups

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = docs.columns
    kept = dict.fromkeys(r[0] for r in con.execute("SELECT doc_id FROM (" + ORACLE["op10_quality_rules"] + ") WHERE kept").fetchall())
    text = {d: t for d, t, _ in texts(con)}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        out[name] = [r.asDict() for r in docs.collect()]
        docs = spark.createDataFrame([tuple(r[c] for c in names) for r in out[name]], spark.read.parquet(f"{DIR}/documents.parquet").schema) if name != corpus_pipeline.STAGES[-1][0] else docs
    ids = lambda name: [r["doc_id"] for r in out[name]]
    assert set(ids("quality rules")) == set(kept) and len(ids("quality rules")) == len(kept)
    groups, _ = plain_groups({d: text[d] for d in kept})
    assert sorted(ids("SimHash near-dedup")) == sorted(set(groups.values()))
    leaks = {r[0] for r in con.execute("SELECT doc_id FROM (" + ORACLE["op8_benchmark_decontamination"] + ")").fetchall()}
    clean = sorted(set(groups.values()) - leaks)
    assert sorted(ids("benchmark decontamination")) == clean and leaks
    copies = collections.Counter(ids("mixing sources to target weights"))
    assert set(copies) <= set(clean) and max(copies.values()) <= mixing.CAP
    tokens = out["token-ID output"]
    assert collections.Counter(r["doc_id"] for r in tokens) == copies
    ordered = sorted(tokens, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted(copies.elements())
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ordered, ordered[1:], strict=False))


def test_fingerprint_of_no_words():
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n\t") == 0
