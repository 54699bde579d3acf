"""API pages of drifting shapes."""

from plaudit.sources import io


def test_odd_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text("\n".join([
        '{"success":1,"app_id":"7","reviews":[{"author":{"a":1,"b":[1,2],"it\'s":true}},{"author":{"a":"x","c":null}},{}]}',
        '{"success":1,"reviews":[]}', '{"success":1}', '{"success":"no"}', '{"success":0,"reviews":[{"author":{"z":1}}]}']))
    got = io.read_variant_pages(spark, str(tmp_path))
    flat = got.select("app_id", io.F.try_variant_get("review", "$.author", "variant").alias("author"))
    assert io.variant_fields(flat, "author") == {"a": "mixed", "b": "json", "c": "string", "it's": "boolean"}
    rows = sorted(map(tuple, io.lift_fields(flat, "author", "u_").collect()), key=repr)
    assert rows == sorted([("7", "1", "[1,2]", None, True), ("7", "x", None, None, None), ("7", None, None, None, None)], key=repr)
    assert io.lift_fields(flat.where("false"), "author", "u_").columns == ["app_id"]
