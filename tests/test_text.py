from pyspark.sql import functions as F

from facetry.functions import text
from facetry.operators import augment as aug


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", fn(F.col("t"))).orderBy("i").collect()]


SAMPLES = ["a\nb ", None, "", " \t\n ", "\xa0x\x1f", "plain"]


def test_cleaning_modes(spark):
    python = lambda t: (t or "").replace("\n", " ").strip() or " "
    assert apply(spark, text.clean_for_service, SAMPLES) == [python(t) for t in SAMPLES]
    local = lambda t: t.replace("\n", " ") if t and t.strip() else ""
    assert apply(spark, text.clean_for_local, SAMPLES) == [local(t) for t in SAMPLES]


def test_labels(spark):
    found = apply(spark, text.normalise_label, ["France#####Bordeaux", "#####", None, " a   b ", "x#####"])
    assert found == ["France Bordeaux", "", "", "a b", "x"]


def test_response_check_agrees_with_attempt_loop(spark):
    samples = ["", None, "123456789", "1234567890", "  123456789  ", "well, i CANNOT do that", "As an ai model I", "Fine words, truly", "can't ASSIST you here"]
    found = apply(spark, text.usable_response, samples)
    assert found == [False, False, False, True, False, False, False, True, False]
    assert found == [aug.is_usable(s) for s in samples]


def test_prompt_without_attributes(spark):
    built = apply(spark, lambda c: text.prompt(c, F.lit("short")), ["Base"])[0]
    assert built == ('Create a new product description based on this original:\n\n"Base"\n\nGenerate a variation that is: short'
                     "\n\nReturn ONLY the new description, with no additional commentary.")
