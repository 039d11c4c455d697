"""Import files in byte ranges: the rows of a sequential reader, whatever the cuts."""

import csv
import io
import random

from opinionlake import constants as C
from opinionlake.sources import imports, splitcsv

ODD = ["", "plain", 'a "quoted" one', "two\nlines", "crlf\r\nin it", ",", '"', '""', "服務員", "é,\n\"x\"", "5\" pipe", "long " * 40]


def sequential(data):
    return [r for r in csv.reader(io.StringIO(data.decode("utf-8"), newline="")) if r]


def in_ranges(data, size):
    parts = [data[i : i + size] for i in range(0, len(data), size)]
    maps = [splitcsv.outcomes(p, data[(i + 1) * size :][:1]) for i, p in enumerate(parts)]
    rows = []
    for i, (first, before) in enumerate(splitcsv.compose(maps)):
        assert before == len(rows)
        if first >= 0:
            begin = i * size + first
            end = min((i + 1) * size, len(data))
            state = splitcsv.end_state(data[begin:end])
            if state != splitcsv.RECORD:
                end += splitcsv.record_end(data[end:], state)[1]
            rows += splitcsv.records(data[begin:end])
    return rows


def sample(rng, rows, line_end):
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=line_end, quoting=rng.choice([csv.QUOTE_ALL, csv.QUOTE_MINIMAL]))
    for _ in range(rows):
        writer.writerow([rng.choice(ODD) or "x" for _ in range(3)])
        if rng.random() < 0.1:
            out.write(line_end)  # a blank line
    return out.getvalue().encode()


def test_any_cut_gives_the_rows_of_a_sequential_reader():
    rng = random.Random(5)
    for trial in range(60):
        data = sample(rng, 25, rng.choice(["\n", "\r\n"]))
        data += rng.choice([b"", b'last,"open', b"5\" x,a\"b,c", b"no end"])
        for size in (1, 2, 3, 7, 64, 1000, len(data) + 1):
            assert in_ranges(data, size) == sequential(data), (trial, size)


def test_characters_are_judged_by_the_range_they_begin_in():
    good, bad = "aé服務𝄞z".encode(), b"ab\xe6\x9c\x00d"
    for size in range(1, len(good) + 1):
        assert all(splitcsv.valid_utf8(good[i : i + size], good[i + size :][:3], i == 0) for i in range(0, len(good), size))
    for size in range(4, 7):
        assert not all(splitcsv.valid_utf8(bad[i : i + size], bad[i + size :][:3], i == 0) for i in range(0, len(bad), size))
    assert not splitcsv.valid_utf8(b"\x80a", b"", True) and splitcsv.valid_utf8(b"\x80a", b"")


def test_import_files_in_many_ranges(spark, tmp_path):
    rng, want = random.Random(7), {}
    header = list(C.IMPORT_FIELDS)
    for name, mark in (("a.csv", "﻿"), ("b.csv", "")):
        rng.shuffle(header)
        rows = [[rng.choice(ODD) or f"n{i}" for _ in header] for i in range(60)]
        out = io.StringIO(newline="")
        csv.writer(out).writerows([header, *rows])
        (tmp_path / name).write_bytes((mark + out.getvalue()).encode())
        want |= {(name, i): dict(zip(header, r)) for i, r in enumerate(rows, 2)}
    line = ",".join(header)
    (tmp_path / "short.csv").write_text(line + "\nonly,two\n")
    want["short.csv", 2] = dict(zip(header, ["only", "two", *[None] * 9]))
    faults = {"head.csv": "x,y\n1,2\n", "none.csv": line + "\n\n", "wide.csv": line + "\n" + "a,b,c\n" * 40 + "v," * 12 + "\n", "t.txt": "x"}
    for name, body in faults.items():
        (tmp_path / name).write_text(body)
    (tmp_path / "bytes.csv").write_bytes(line.encode() + b"\n" + b"good,row\n" * 40 + b"\xff\xfe\n")
    (tmp_path / "d.json").write_text('{"items": []}')
    for size in (50, 1 << 20):
        got = imports.read_files(spark, str(tmp_path), range_bytes=size).collect()
        rows = {(r["file"].rsplit("/", 1)[1], r["row_no"]): {f: r[f] for f in header} for r in got if r["file_error"] is None}
        assert rows == want
        errors = {r["file"].rsplit("/", 1)[1]: r["file_error"] for r in got if r["file_error"]}
        assert errors == {"head.csv": "bad_header", "none.csv": "empty", "wide.csv": "bad_fields", "t.txt": "unknown_type", "bytes.csv": "not_utf8", "d.json": "empty"} and len(got) == len(rows) + len(errors)
