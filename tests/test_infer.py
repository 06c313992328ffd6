"""A1: types inferred from every row of a CSV."""

from churnscope.sources.infer import infer_types, read_inferred_csv, read_text_csv


def test_each_kind_and_their_joins(spark, tmp_path):
    head = "whole,gaps,real,flag,mixed,blank,none,huge,late,a.b"
    rows = ["1,1,1.5,True,true,x,NA,99999999999999999999,1,1", "-2,,2,FALSE,0, ,nan,1,2,inf",
            " +3 ,3,1e3,,1,y,,2,3,-.5"]
    # what decides a type may be in the last of many rows
    (tmp_path / "a.csv").write_text("\n".join([head, *rows * 500, "4,4,4,true,1,z,null,3,many,2"]) + "\n")
    table = infer_types(read_text_csv(spark, str(tmp_path / "a.csv")))
    found = {r.column_name: r for r in table.collect()}
    assert {c: r.type for c, r in found.items()} == {
        "whole": "bigint", "gaps": "bigint", "real": "double", "flag": "boolean", "mixed": "string",
        "blank": "string", "none": "double", "huge": "double", "late": "string", "a.b": "double"}
    assert all(sum(r[f"n_{k}"] for k in ("missing", "boolean", "whole", "number", "text")) == 1501
               for r in found.values())
    assert found["gaps"].n_missing == 500 and found["huge"].n_number == 500 and found["late"].n_text == 1
    back = read_inferred_csv(spark, str(tmp_path / "a.csv"))
    assert [f.dataType.simpleString() for f in back.schema] == [found[c].type for c in head.split(",")]
    got = [tuple(r) for r in back.limit(3).collect()]
    assert got == [(1, 1, 1.5, True, "true", "x", None, 1e20, "1", 1.0),
                   (-2, None, 2.0, False, "0", " ", None, 1.0, "2", float("inf")),
                   (3, 3, 1000.0, None, "1", "y", None, 2.0, "3", -0.5)]


def test_a_file_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n")
    back = read_inferred_csv(spark, str(tmp_path / "a.csv"))
    assert back.dtypes == [("x", "double"), ("y", "double")] and back.count() == 0
