import json

from pyspark.sql import functions as F

from opinionlake import constants as C
from opinionlake.sources import imports


def test_many_small_files_are_read_by_many_tasks(spark, tmp_path):
    names = list(C.IMPORT_FIELDS)
    for i in range(40):
        row = {f: f"{f} {i}" for f in names}
        (tmp_path / f"j{i}.json").write_text(json.dumps([row]), encoding="utf-8")
        (tmp_path / f"c{i}.csv").write_text(",".join(names) + "\n" + ",".join(row.values()) + "\n", encoding="utf-8")
    seen = []
    kept = imports.stored

    def stored(df, name):
        out = kept(df, name)
        if name in ("json-rows", "csv-rows"):
            seen.append((name, out.select(F.input_file_name()).distinct().count()))
        return out

    imports.stored = stored
    try:
        rows = imports.read_files(spark, str(tmp_path))
        assert sorted(r["text"] for r in rows.collect()) == sorted(2 * [f"text {i}" for i in range(40)])
    finally:
        imports.stored = kept
    assert all(n > 1 for _, n in seen) and len(seen) == 2, seen
