"""Records of mixed shapes read as variants."""

from procwatch.sources import files

LINES = ['{"kind": "a", "id": 1, "x": {"y": [1, 2]}}', '{"kind": "a", "id": "7", "x": 2.5}', '{"kind": "b", "id": null}',
         '[1, 2]', '"text"', '{"kind": "a", "id": ', "", "   ", "{}", '{"it\'s": 1, "kind": "b", "id": 9999999999}']


def test_mixed_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join(LINES))
    got = files.variant_records(spark, str(tmp_path), {"kind": "string", "id": "int"})
    rows = sorted(map(repr, (tuple(r) for r in got.select("kind", "id", "n_fields", "bad_line").collect())))
    want = [("a", 1, 3, None), ("a", 7, 3, None), ("b", None, 2, None), (None, None, None, None), (None, None, None, None),
            (None, None, None, '{"kind": "a", "id": '), (None, None, 0, None), ("b", None, 3, None)]
    assert rows == sorted(map(repr, want))


def test_shapes_by_kind(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("\n".join(LINES))
    got = files.variant_records(spark, str(tmp_path), {"kind": "string"})
    shapes = {r["kind"]: (r["shape"], r["n"]) for r in files.variant_shapes(got.where("kind IS NOT NULL"), "kind").collect()}
    assert shapes["a"][1] == 2 and shapes["b"][1] == 2
    assert "x: VARIANT" in shapes["a"][0] and "id: BIGINT" in shapes["b"][0]


def test_an_empty_folder_has_no_rows(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("")
    assert files.variant_records(spark, str(tmp_path), {"id": "int"}).count() == 0
