"""JSON import files in byte ranges: the rows and faults of a sequential reader, whatever the cuts."""

import json
import random

import pytest

from opinionlake import constants as C
from opinionlake.sources import imports, splitjson

ODD = ["", "plain", 'a "quoted" one', "back\\slash", "\\\\", '\\"', "[{", "}],", "two\nlines", "服務員", "﻿", "long " * 30, None]


def element(rng):
    return {f: rng.choice(ODD) for f in rng.sample(C.IMPORT_FIELDS, len(C.IMPORT_FIELDS))}


def dumped(value, rng):
    return json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))


def contents(rng):
    good = [element(rng) for _ in range(12)]
    nested = [good[0] | {"text": {"a": [1, {"b": "]"}]}}, good[1] | {"reaction_count": 7}]
    lists = dumped(good, rng)
    out = {
        "list": lists, "mark": "﻿" + lists, "wrapped": dumped({"meta": {"items": [1, 2]}, "items": good, "more": [{"x": "}"}]}, rng),
        "twice": '{"items": [{"a": 1}], "n": 1, "items" \n : \n\n  ' + lists + ', "z": [[], {}]}', "escaped": '{"\\u0069tems":' + lists + "}",
        "replaced": '{"items": ' + lists + ', "items": 5}', "no list": '{"other": ' + lists + "}", "scalar": "12", "blank": "  \n", "nested": json.dumps(nested),
        "empty": " [ \n ] ", "empty wrapped": '{"a": 1, "items": []}', "comma": lists[:-1] + ",]", "two commas": lists[:-1] + ",," + lists[1:], "cut": lists[:-30],
        "brace": lists[:-1] + "}", "behind": lists + " x", "second": lists + lists, "number": lists[:-1] + ", 3]", "fields": lists[:-1] + ', {"a": 1}]',
        "worst": lists[:-1] + ', {"a": 1}, 3, {"b": }]', "unquoted": lists[:-1] + ', {"a": "x]', "single": json.dumps(good[:1]), "deep": "[" * 300 + "]" * 300,
        "string": '"items"', "half": '[{"a": "\\', "lone": json.dumps([good[0] | {"title": "\ud83d"}]), "member name only": '{"items"', "closed first": "]" + lists,
        "mixed": '{"a": [}, "items": ' + lists + "}",
    }
    return {k: v.encode("utf-8") for k, v in out.items()} | {"bytes": lists.encode()[:-1] + b', "\xff"]'}


def sequential(data):
    try:
        value = json.loads(data.decode("utf-8-sig"))
    except UnicodeDecodeError:
        return "not_utf8", []
    except ValueError:
        return "bad_json", []
    rows = value.get("items") if isinstance(value, dict) else value
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        return "not_a_list", []
    if not rows:
        return "empty", []
    if any(set(r) != set(C.IMPORT_FIELDS) for r in rows):
        return "bad_fields", []
    return None, [[imports._cell(r[f], f) for f in C.IMPORT_FIELDS] for r in rows]


@pytest.mark.parametrize("size", [3, 41, 700, 1 << 20])
def test_read_json_ranges(spark, tmp_path, size):
    files = contents(random.Random(size))
    if size == 3:  # a range every three bytes: the short files only
        files = {k: v for k, v in files.items() if len(v) < 700} | {"short": b'{"n": "\\\\", "items": [ {"a": "[\\""} , {"b": {}} ] , "m": [1]}'}
    for name, data in files.items():
        (tmp_path / f"{name}.json").write_bytes(data)
    got = {}
    for r in imports.read_files(spark, str(tmp_path), range_bytes=size).collect():
        got.setdefault(r.file.rsplit("/", 1)[1].replace("%20", " ")[:-5], []).append(r)
    assert set(got) == set(files)
    for name, data in files.items():
        error, rows = sequential(data)
        part = sorted(got[name], key=lambda r: r.row_no)
        assert [r.file_error for r in part] == ([error] if error else [None] * len(rows)), name
        if not error:
            assert [r.row_no for r in part] == list(range(1, len(rows) + 1)), name
            assert [[r[f] for f in C.IMPORT_FIELDS] for r in part] == rows, name


def test_maps_compose():
    """The composed state and depth of each range are those of a walk from the file's start."""
    rng = random.Random(5)
    for _ in range(60):
        data = json.dumps([element(rng) for _ in range(3)], ensure_ascii=rng.random() < 0.5).encode()
        size = rng.choice([1, 2, 3, 5, 8, 50])
        parts = [data[i : i + size] for i in range(0, len(data), size)]
        for i, (state, depth, _) in enumerate(splitjson.compose([splitjson.outcomes(p) for p in parts])):
            assert (state, depth) == splitjson.outcomes(data[: i * size])[0][:2] if i else (state, depth) == (splitjson.OUTSIDE, 0)


def test_range_reads_only_what_begins_in_it():
    data = b'[{"a":1},{"a":[2,3]},{"a":"x"}]'
    found, begin, close = splitjson.elements(data[:12], splitjson.OUTSIDE, 0, 1, 0)
    assert [data[a:b] for a, b in found] == [b'{"a":1}'] and data[begin:20] == b'{"a":[2,3]}' and close == -1
    found, begin, close = splitjson.elements(data[12:], splitjson.STRING, 2, 1)
    assert [data[12:][a:b] for a, b in found] == [b'{"a":"x"}'] and begin == -1 and data[12:][close:] == b"]"
