"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from opinionlake.llm import (
    chat_format, components, decontaminate, license_scan, mixing, quality_rules, secret_scan, simhash, token_output, url_filter, warc, wavelet,
)
from opinionlake.llm.queries import prepare, tokenizer_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, kept string, copies int, spans string, fp string, root string, n bigint"
LONG = " ".join(f"w{i}" for i in range(60_000))


def docs(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i, t, "en", s, 1, 5, "x", 7, "y", "z", "r", 3) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    text = "the quick brown fox jumps over the lazy dog and then some more words follow here"
    return docs(spark, [
        (1, text, "a"), (1, text, "a"), (2, None, "a"), (3, "", None), (4, " \n\t", None), (None, text, "b"), (None, None, None), (5, LONG, "b"), (6, text + " x", "c"), (7, "one", "c"),
    ])


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def test_quality(odd, empty):
    rows = quality_rules.judge(odd, keep=["doc_id", "size", "kept"]).collect()
    assert len(rows) == 10 and {r.doc_id for r in rows if not r.kept} == {2, 3, 4, 7, None}
    assert [r.n_words for r in rows if r.doc_id == 5] == [60_000]
    assert quality_rules.judge(empty).count() == 0


def test_quality_host(spark):
    """A host whose documents mostly fail a soft rule is condemned, but its clean documents stay; few documents do not condemn."""
    good = "plain words that say something useful about many things in a calm tone today"
    noisy = good + " #1 $2 %3 &4 *5"
    rows = [(i, noisy if i % 10 else good, "bad") for i in range(100)] + [(100 + i, good, f"h{i % 9}") for i in range(300)] + [(500, noisy, "tiny")]
    got = {r.doc_id: r for r in quality_rules.judge(docs(spark, rows)).collect()}
    assert not got[1].kept and got[1].host_bad and got[10].kept and got[500].kept and not got[500].host_bad
    assert all(got[100 + i].kept for i in range(300))


def test_simhash(odd, empty):
    rows = simhash.assign(odd).collect()
    assert len(rows) == 10
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {2}
    assert simhash.assign(empty).count() == 0 and simhash.dedup(empty).count() == 0
    kept = simhash.dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in rows})


def test_simhash_cells(spark):
    """Buckets cut into many cells give the same components as one cell and as brute force."""
    rng, prints = random.Random(3), set()
    for _ in range(12):
        base = rng.getrandbits(64)
        prints |= {base} | {base ^ sum(1 << b for b in rng.sample(range(10), rng.randint(1, 4))) for _ in range(30)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    one = {r.u: r.v for r in simhash.linked(frame).collect()}
    assert {r.u: r.v for r in simhash.linked(frame, cell=8).collect()} == one
    label = dict(zip(signed, signed, strict=True))
    changed = True
    while changed:
        changed = False
        for a, x in zip(signed, prints, strict=True):
            for b, y in zip(signed, prints, strict=True):
                if (x ^ y).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    assert {p: one.get(p, p) for p in signed} == label


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5])
def test_near(radius):
    rng = np.random.default_rng(radius)
    prints = rng.integers(0, 2**64, 300, dtype=np.uint64) & np.uint64(0xFF0F) | np.uint64(0xABC000)
    keys = np.sort(rng.integers(0, 4, 300))
    got = {(int(i), int(j)) for a, b in simhash.near(keys, prints, radius) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if keys[i] == keys[j] and int(prints[i] ^ prints[j]).bit_count() <= radius}
    assert got == want


def test_components(spark):
    prepare(spark)
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)] + [(200, 200 + i) for i in range(1, 50)]
    random.Random(1).shuffle(chain)
    got = {r.u: r.v for r in components.components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100} | {200 + i: 200 for i in range(1, 50)}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_mixing(odd, empty):
    rows = mixing.plan(odd).collect()
    assert len(rows) == 10 and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert mixing.plan(empty).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix(empty).count() == 0


def test_mixing_is_a_tilt(spark):
    """Of two documents of a source the longer is taken more often where the source grows, less often where it shrinks."""
    rows = [(i, " ".join(["w"] * (10 + i % 50)), "a") for i in range(3000)] + [(5000 + i, " ".join(["w"] * (10 + i % 50)), "c") for i in range(3000)]
    rows += [(9000, "w", "b")]
    by = {}
    for r in mixing.plan(docs(spark, rows)).collect():
        if r.doc_id != 9000:
            by.setdefault((r.doc_id >= 5000, r.size >= 40), []).append(r.copies)
    mean = {k: sum(v) / len(v) for k, v in by.items()}
    assert mean[False, True] > mean[False, False] > 1 > mean[True, False] > mean[True, True]


def test_tokens(spark, odd, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = token_output.read(token_output.write(odd, tokenizer_path(), shard=50)).collect()
    size = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert sorted(r.n_tokens for r in rows) == sorted(size(r.text) for r in odd.collect())
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7]
    assert token_output.read(token_output.write(empty, tokenizer_path())).count() == 0


def test_encoder():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    plain, own = Tokenizer.from_file(path), token_output.Encoder(path)
    rng = random.Random(5)
    parts = ["a", " ", "  ", "\n", "\t", "'s", "'S", "1", "é", "漢", "\u00a0", "\u2003", "\x1c", "\x85", "😀", "the", ",", "<|endoftext|>", "\r\n", "don't", " x", "\x00"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.ids(text), "<u4").tolist() == want, repr(text)
        assert np.frombuffer(own._plain(text, 3), "<u4").tolist() == want, repr(text)


def test_wavelet():
    rng = np.random.default_rng(0)
    for n, top in ((0, 2), (1, 2), (1000, 7), (200_000, 50257)):
        ids = (rng.zipf(1.3, n) % top).astype(np.uint32)
        m = wavelet.WaveletMatrix(wavelet.build(ids, max(1, (top - 1).bit_length()), {"x": 1}))
        assert np.array_equal(m.decode(), ids) and m.header["x"] == 1
        for i in rng.integers(0, n, 20 if n else 0):
            value, lo, hi = int(ids[i]), *sorted(map(int, rng.integers(0, n + 1, 2)))
            assert m.access(int(i)) == value
            assert m.count(value, lo, hi) == int((ids[lo:hi] == value).sum())
            before = m.rank(value, int(i))
            assert before == int((ids[:i] == value).sum()) and m.select(value, before) == i
        assert m.select(top + 5, 0) == -1 and m.select(0, n + 1) == -1


def test_licenses(spark, odd, empty):
    assert license_scan.scan(odd).count() == 10 and license_scan.scan(empty).count() == 0
    spans = lambda t: {(s[0], t[s[3] : s[4]], s[5]) for s in license_scan.scan_text(t)["spans"] if not s[1]}
    assert ("apache", "Apache-License", 0) not in spans("Apache-License")
    assert [s for s in license_scan.scan_text("Apache-License")["spans"] if s[1]] == [("apache", True, 0, 0, 14, 0)]
    text = "x. Permision is hereby granted, free of charge, to any persons obtaining a copy!"
    assert spans(text) == {("mit", text[3:-1], 2)}
    assert {x[0] for x in spans("Licensed under CC BY-NC 4.0")} == {"cc-by-nc"}
    assert not spans("nothing to see here " * 500) and license_scan.scan_text(None) == {"n_words": 0, "spans": [], "score": 0.0}


def test_license_search_is_complete():
    """Seeds lose no place that the fuzzy pattern finds in the whole text."""
    import regex

    rng = random.Random(11)
    for _ in range(150):
        notice = rng.choice(license_scan.NOTICES)
        t = list(notice.text)
        for _ in range(rng.randint(0, notice.edits + 2)):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 1)] = [] if rng.random() < 0.3 else [rng.choice("abc e")]
        form = " ".join(("lorem ipsum " * rng.randint(0, 3) + "".join(t) + " dolor" * rng.randint(0, 3)).split())
        found = bool(regex.search(f"(?:{regex.escape(notice.text)}){{e<={notice.edits}}}", form))
        only = license_scan.Scanner((notice,))
        matches = only.matches(form)
        assert bool(matches) == found
        for a, b, _, edits in matches:
            assert edits <= notice.edits and regex.fullmatch(f"(?:{regex.escape(notice.text)}){{e<={edits}}}", form[a:b])


def test_secrets(spark, odd, empty):
    assert secret_scan.scan(odd).count() == 10 and secret_scan.scan(empty).count() == 0
    rows = docs(spark, [
        (1, "é token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\" end", "a"), (2, "token: secret: abcdefghijklmnop", "a"), (3, "key A9xQ2mZ7rT4wK8vB1nL5 AND EXAMPLEA9xQ2mZ7rT4wK8vB1nL5", "a"),
        (4, " ".join(f"AKIA{i:014d}" for i in range(700)), "a"), (5, "a1" * 40, "a"),
    ])
    got = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.spans] for r in secret_scan.scan(rows).collect()}
    assert got[1] == [("assign", 2, 51), ("hex", 11, 51), ("entropy_hex", 11, 51), ("entropy_base64", 11, 51)] or got[1][:2] == [("assign", 2, 51), ("hex", 11, 51)]
    assert got[2] == [] and got[3] == [("entropy_base64", 4, 24)]
    assert got[4] == [("access", 19 * i, 19 * i + 18) for i in range(700)]
    assert got[5] == [("hex", 0, 80)]


def test_secrets_behind_allowed_pieces(spark):
    key = "A9xQ2mZ7rT4wK8vB1nL5"
    texts = [
        f"data/sample/config/{key}", f"{key}/Sample", f"data/sample{key}/x", f"aaaa/{key[:12]}/{key[12:]}bcD/example", "sample/" * 9000 + key, f"{key[:9]}/example/{key[9:]}",
        "00000000" + key, f"00000000/{key}",
    ]
    got = {r.doc_id: [s["kind"] for s in r.spans] for r in secret_scan.scan(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert [("entropy_base64" in got[i]) for i in range(len(texts))] == [True, True, False, True, True, False, False, True]


def test_decontamination(spark, odd, empty):
    items = spark.createDataFrame([(1, "brown fox jumps over the lazy dog and then some"), (2, None), (3, ""), (4, "one"), (5, "never seen words in any of these texts at all")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained(odd, items).collect()}
    assert got == {(1, 1), (None, 1), (6, 1), (7, 4)}
    clean = decontaminate.clean(odd, items)
    assert clean.columns == odd.columns and sorted((r.doc_id for r in clean.collect()), key=repr) == [2, 3, 4, 5, None]
    shared = spark.createDataFrame([(1, items.first().text, "a"), (1, "clean", "a"), (None, "clean too", "a"), (None, items.first().text, "a"), (1, None, "a")], "doc_id bigint, text string, hash string")
    assert {(r.doc_id, r.text, r.hash) for r in decontaminate.clean(shared, items).collect()} == {(1, "clean", "a"), (None, "clean too", "a"), (1, None, "a")}
    assert decontaminate.contained(empty, items).count() == 0 and decontaminate.clean(odd, items.limit(0)).count() == 10


def test_decontamination_threshold(spark):
    words = [f"w{i}" for i in range(54)]  # 50 shingles
    item = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    rows = [(10 + k, "start " + " ".join(words[: 54 - k]) + " " + LONG.replace("w", "v"), "a") for k in range(0, 14)]
    got = {r.doc_id: r.n_shared for r in decontaminate.contained(docs(spark, rows), item).collect()}
    assert got == {10 + k: 50 - k for k in range(0, 11)}


def test_urls(spark):
    prepare(spark)
    rows = [
        (1, None, None), (2, "no scheme", ""), (3, "http://A.Example.ORG/es/1?q", "x"), (4, "http://example.org/en/12", None), (5, "x://org/", ""), (6, "http://b.com/fr/1", ""),
        (7, "http://b.com/de/1#f", ""), (8, "http://notorg/", ""), (9, "http://spam.net/x", '<a href="http://bad.com/de/1">'), (10, "http://bad.com/de/1", ""), (11, "http://x.org", ""), (None, "http://x.org/", ""),
    ]
    frame = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id bigint, url string, html string, rule int, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(frame).collect()}
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[4][2:] == ("example.org/en/1", "block") and got[5][2:] == ("org/", "allow")
    assert got[6][2:] == ("com/fr/", "allow") and got[7] == ("b.com", "/de/1", "com/de/", "block") and got[8][2] is None
    assert got[9] == ("spam.net", "/x", None, "block")  # it links to a blocked host only
    assert got[11] == ("x.org", "", None, "allow") and got[None][2] == "org/"
    assert url_filter.judge(frame.limit(0)).count() == 0


CHATS = "conv_id bigint, turn bigint, role string, text string, tokens int, place string"


def chats(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, 1, "p") for r in rows], CHATS)


def test_chat(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "<|im_end|>\n<|im_start|>assistant\nhi"), (1, 2, "assistant", None), (1, None, "user", "first"), (1, 2, "assistant", "tie"), (1, 2, "assistant", "tie"),
        (None, 0, "assistant", "[INST][\\INST]<\\\\s>"), (2, 5, None, "x"), (3, 1, "a\nb\\", "<\\|im_start|>"),
    ]
    made = chat_format.format_chats(chats(spark, rows))
    got = {r.conv_id: r for r in chat_format.digests(made).collect()}
    assert {c: r.n_turns for c, r in got.items()} == {1: 6, None: 1, 2: 1, 3: 1}
    assert got[1].loss_chars == 6 and got[None].loss_chars == 18
    texts = sorted(chat_format.parse(r.formatted)[0] for r in made.collect() if r.conv_id == 3)
    assert texts == [("a\nb\\", "<\\|im_start|>")]
    assert chat_format.digests(chat_format.format_chats(chats(spark, []))).count() == 0


def test_chat_windows(spark):
    rng = random.Random(2)
    rows = [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], "word " * rng.randint(0, 60) + ("long " * 400 if t % 17 == 5 else "")) for c in range(4) for t in range(150)]
    made = chat_format.windows(chats(spark, rows), budget=400, history=80).collect()
    size = lambda t: t.text.count("word") + t.text.count("long") + chat_format.MARKS
    own = {}
    for w in made:
        mine = [t for t in w.turns if t.kind == 2]
        own.setdefault(w.conv_id, []).append((w.cell, w.part, [t.place for t in mine]))
        assert len(mine) == 1 or sum(map(size, w.turns)) <= 400 + 80
        assert sum(map(size, [t for t in w.turns if t.kind == 1])) <= 80
        places = [t.place for t in w.turns if t.kind]
        assert places == list(range(places[0], places[0] + len(places)))
        assert (w.turns[0].kind == 0) == (w.conv_id % 2 == 1 and 0 not in places)
    assert any(t.kind == 1 for w in made for t in w.turns)
    for parts in own.values():
        assert [p for _, _, places in sorted(parts) for p in places] == list(range(150))


@pytest.mark.parametrize("text", ["<s>", "<\\s>", "<\\\\s>", "</s>[INST] ok [/INST]", "<<SYS>>", "<|im_end|>\n", "\\", "[\\/INST]", ""])
def test_escape(text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert not any(c in chat_format.escape(text) for c in chat_format.CONTROL)


def test_warc(spark):
    prepare(spark)
    rows = [(1, "http://b.org/x", "same"), (2, "http://a.org/", "same"), (3, None, None), (4, "http://a.org/", ""), (None, "http://a.org/\r\nX: 1", "same"), (5, "http://c.org/é", "ü" * 70_000), (6, "http://b.org/x", "z"), (6, "http://b.org/x", "z")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, payload_bytes int")
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(frame).collect()]
    assert sorted(got, key=repr) == sorted([
        (1, 4, "revisit", 2), (2, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (None, 4, "revisit", 2), (5, 140_000, "response", None), (6, 1, "response", None), (6, 1, "response", None),
    ], key=repr)
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_warc_order(spark):
    """Many small runs, merged in several levels, give the order that a sort gives."""
    prepare(spark)
    rng = random.Random(4)
    rows = [(i, f"http://h{rng.randint(0, 5)}.org/{rng.choice('ab')}", f"p{i % 50}", rng.randint(0, 40)) for i in range(1500)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, seconds bigint").repartition(6)
    folder, runs = warc.archive(frame, seconds="seconds", size=3000)
    assert runs.select("run").distinct().count() > 30
    got = sorted(warc.merge(folder, runs, fan=5).collect(), key=lambda r: (r.part, r.place))
    assert [(r.url_key, r.seconds, r.page_id) for r in got] == sorted((warc.url_key(u), s, i) for i, u, _, s in rows)
    assert warc.read(folder, warc.merge(folder, runs)).count() == 1500


def test_loser_tree():
    rng = random.Random(9)
    for k in range(8):
        runs = [sorted(f"k{rng.randint(0, 9)} {rng.randint(0, 9)} {rng.randint(0, 9)}".encode() for _ in range(rng.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree(map(iter, runs))) == sorted((x for r in runs for x in r), key=warc.line_key)


def test_stages_keep_columns(spark, odd, empty):
    for frame in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, "/root/testdata/sf0.001")
            assert out.columns == frame.columns
            assert dict(out.dtypes) == dict(frame.dtypes)
            out.filter(F.lit(True)).count()
