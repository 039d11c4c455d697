from opinionlake.operators import hygiene


def test_boundary_reaches_maps_arrays_and_structs(spark):
    schema = "author string, note string, tags array<string>, extra map<string,string>, deep array<struct<board:string,lines:map<string,array<string>>,n:int>>, counts map<string,int>"
    rows = [
        ("Bob", "a\uff20b.com", ["a\uff20b.com", None, "call 0912345678", "plain"], {"author": "Bob", "note": "mail x@y.org"}, [("b", {"address": ["z"], "k": ["\uff20 q@r.net"]}, 3), None], {"author": 1, "n": 2}),
        ("Eve", None, None, None, None, None),
    ]
    out = hygiene.model_boundary(spark.createDataFrame(rows, schema))
    assert out.columns == ["note", "tags", "extra", "deep", "counts"] and out.schema["deep"].dataType.elementType.names == ["lines", "n"]
    full, empty = sorted(out.collect(), key=lambda r: r.note is None)
    assert empty.asDict() == dict.fromkeys(out.columns)
    text = str(full)
    assert not any(x in text for x in ("Bob", "b.com", "0912345678", "y.org", "r.net", "'address'", "author"))
    assert full.tags[1] is None and full.tags[3] == "plain" and set(full.extra) == {"note"} and full.deep[1] is None and full.deep[0].n == 3
    assert full.counts["n"] == 2
