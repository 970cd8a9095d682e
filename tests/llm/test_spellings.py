import pytest
from pyspark.sql import functions as F

from geoloom.llm import spellings
from geoloom.llm.spellings import collapse_spellings, digits_text, json_text, shape_text

FORMS = {"hash": "digits", "wkb": "hex", "fixed_shape": "shape", "props": "json"}
SCHEMA = "rec_id long, hash string, wkb string, fixed_shape string, props string, keep_id int"


def column(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    return [r.c for r in df.select(f(F.col("t")).alias("c")).collect()]


def test_digits(spark):
    texts = ("-5", " '-5,' ", "7_204 299", "5,626", "12.5", "73.", "5", "", None, "-7'2'3 \xa0", "1.2.3")
    assert column(spark, digits_text, *texts) == ["-5", "-5", "7204299", "5626", "12.5", "73", "5", "", None, "-723", "1.2.3"]


def test_shapes(spark):
    texts = ("POINT (-1.5 2)", " point[-1.5\t2];", "POINT (1.52)", "POINT (1.5 2)", "MULTIPOINT ((1 2), (3 4E-5)).", None, "")
    got = column(spark, shape_text, *texts)
    assert got == ["point -1.5 2", "point -1.5 2", "point 1.52", "point 1.5 2", "multipoint 1 2 3 4e-5", None, ""]


def test_json():
    a = json_text('{"b": [1, "A-b", null, true], "a": {"z": 1.50, "y": "x"}}')
    assert a == json_text('{"A":{"y":"“X”","Z":1.50}, "B":[1,"a b",null,true]}') == "{a:{y:x,z:1.50},b:[1,ab,null,true]}"
    assert json_text('{"a": 1.5}') != json_text('{"a": 1.50}') != json_text('{"a": -1.50}')
    assert json_text('["a", "b"]') != json_text('["b", "a"]') and json_text('["a", "b"]') != json_text('["ab"]')
    assert json_text("Not: JSON, 5.") == "not json 5" and json_text(None) is None and json_text('""') == ""
    assert json_text('{"a": 1, "a": 2}') == json_text('{"a": 2, "A": 1}')
    assert json_text("[" * 100_000) is not None


@pytest.mark.parametrize("most_sent", [0, 100_000])
def test_groups_and_members(spark, monkeypatch, most_sent):
    monkeypatch.setattr(spellings, "MOST_SENT", most_sent)
    rows = [
        (3, "-12", "0A", "POINT (1 2)", '{"a": 1, "b": "x y"}', 0),
        (1, "'-12'", "0a", "point(1 2)", '{"B":"X-Y","A":1}', 0),
        (2, "-12", "0A", "POINT (1 2)", '{"a": 1, "b": "x y"}', 0),
        (4, "12", "0A", "POINT (1 2)", '{"a": 1, "b": "x y"}', 0),
        (5, None, "0A", "POINT (1 2)", '{"a": 1, "b": "x y"}', 0),
        (6, None, "0 a", "POINT (1 2)", '{"a": 1, "b": "x y"}', 0),
        (7, "", "0A", "POINT (1 2)", '{"a": 1, "b": "x y"}', 0),
        (8, None, None, None, None, 0),
        (9, None, None, None, None, 0),
    ]
    # a third of all rows are byte-identical
    rows += [(100 + i, "9", "ff", "POINT (9 9)", "{}", 0) for i in range(30)]
    rows += [(200 + i, "9", "f" * (i % 7) + "-", "x" * 20_000, "[]", 0) for i in range(21)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    records, members = collapse_spellings(df, "rec_id", FORMS)
    copies = {r.keep_id: r.copies for r in records.collect()}
    assert copies == {1: 3, 4: 1, 5: 2, 7: 1, 8: 2, 100: 30} | {200 + i: 3 for i in range(7)}
    own = {r.id: r.keep_id for r in members.collect()}
    assert len(own) == len(rows) and (own[3], own[2], own[6], own[9], own[129], own[207]) == (1, 1, 5, 8, 100, 200)
    assert collapse_spellings(df, "rec_id", FORMS, with_members=False)[1] is None
    alone = df.dropDuplicates(["hash", "wkb", "fixed_shape", "props"])  # no spelling of several rows
    assert collapse_spellings(alone, "rec_id", FORMS)[1].count() == alone.count()
    _, repeated = collapse_spellings(df, "rec_id", FORMS, only_repeated=True)
    assert {r.id for r in repeated.collect()} == set(own) - {4, 7}


def test_empty_and_bad(spark):
    df = spark.createDataFrame([], SCHEMA)
    records, members = collapse_spellings(df, "rec_id", FORMS)
    assert records.count() == 0 and members.count() == 0
    with pytest.raises(ValueError):
        collapse_spellings(df, "rec_id", {"hash": "roman"})
