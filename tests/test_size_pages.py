from pyspark.sql import functions as F

from lexweave.functions import text as T


def test_a_text_is_worked_out_once(spark):
    d = spark.createDataFrame([("<b>&#65;&#x42;&amp;lt;</b>",)], "html string").select(T.replace_entities(F.regexp_replace("html", "<[^>]*>", "")).alias("t"))
    assert d.first()[0] == "AB&lt;"
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<[^>]*>") == 1
