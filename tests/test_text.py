from pyspark.sql import functions as F

from corvigraph.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_assertion_rules(spark):
    a = lambda text, entity, **k: value(spark, T.assertion(F.lit(text), F.lit(entity), **k))
    assert a("no mass", "mass") == "absent"
    assert a("no possible mass", "mass") == "absent"
    assert a("possible mass", "mass") == "possible"
    assert a("history of mass", "mass") == "past"
    assert a("mass, no doubt", "mass") == "present"  # nothing stands before offset 0
    assert a("nothing here", "mass") == "present"
    assert a("no " + "x" * 120 + " mass", "mass") == "present"  # beyond the window
    assert a("piano mass", "mass") == "absent" and a("piano mass", "mass", word_boundary=True) == "present"
    assert a("mass seen. no mass", "mass") == "present"  # only the first occurrence counts


def test_section_modes(spark):
    text = "History: cough\nFindings: mass\nConclusions: effusion"
    s = lambda p, m: value(spark, T.section_of(F.lit(text), F.lit(p), m))
    assert s(text.index("mass"), "nearest_header") == "findings" and s(text.index("effusion"), "nearest_header") == "conclusions"
    assert s(text.index("effusion"), "first_header") == "history" and s(0, "nearest_header") == "findings"


def test_labels(spark):
    df = spark.createDataFrame([("disease definitely absent",), ("mass present",), ("odd",)], "l string")
    b, p = T.parse_label(F.col("l"))
    assert [tuple(r) for r in df.select(b, p).collect()] == [("disease", "absent"), ("mass", "present"), ("odd", "unknown")]
    assert value(spark, T.certainty(F.lit("Observation::definitely_present"))) == "present"
    assert value(spark, T.certainty(F.lit("x"))) == "unknown"


def test_critical_and_null(spark):
    assert value(spark, T.is_critical(F.lit("Rib FRACTURE"))) and not value(spark, T.is_critical(F.lit(None).cast("string")))


def test_json_repair(spark):
    for raw in ("```json\n{'a': 1,}\n```", '{"a": 1, }', " {'a': 1} ", 'Here: {"a": 1} done'):
        assert value(spark, F.from_json(T.repair_json(F.lit(raw)), "a int"))["a"] == 1
    assert value(spark, F.from_json(T.repair_json(F.lit('{"a": ')), "a int"))["a"] is None


def test_string_likeness(spark):
    assert round(T.jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611 and round(T.jaro_winkler("DIXON", "DICKSONX"), 4) == 0.8133
    assert T.jaro_winkler("", "a") == 0 and T.jaro_winkler(None, "a") is None and T.jaro_winkler("", "") == 1
    assert value(spark, T.dice(F.lit("night"), F.lit("nacht"))) == 0.25 and value(spark, T.dice(F.lit("a"), F.lit("b"))) == 0
    assert value(spark, T.hamming(F.lit("karolin"), F.lit("kathrin"))) == 3 and value(spark, T.hamming(F.lit("a"), F.lit("ab"))) is None
    assert value(spark, T.likeness(F.lit(""), F.lit(""))) == 1


def test_assembly_and_clean(spark):
    assert value(spark, T.assemble({"History": F.lit(None).cast("string"), "Findings": F.lit("x")})) == "History: \nFindings: x"
    assert value(spark, T.clean(F.lit("  Dog \n"))) == "dog"
    assert value(spark, T.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
