"""Laws of text cleaning and character references, case by case."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import texts

CLEAN = {
    "a\u00a0\u200b b": "a b", " \t\n": None, "": None, None: None, "\u00adx\ufeff": "x", "a\x00\x1f\x7fb": "a b", "\u2003é\u3000日本\u2028": "é 日本", "x\U000e0041y": "x y",
    "n" * 199 + " more": "n" * 199, "n" * 198 + " more": "n" * 198 + " m", "n" * 250: "n" * 200, "\U0001f600" * 201: "\U0001f600" * 200,
}
REFERENCES = {
    "&#65;&amp;&#x42;": "A&B", "&amp;lt;": "&lt;", "&amp;#65;": "&#65;", "&lt;a b=&quot;c&apos;&gt;": "<a b=\"c'>", "&#x1F600;": "\U0001f600", "&#X41;&#+66;": "AB", "&#0;&#xD800;&#x110000;": "&#0;&#xD800;&#x110000;", "&nbsp;&x": "&nbsp;&x",
    "a & b &lt; c": "a & b &lt; c", "no reference": "no reference", "": "", None: None, "&#99999999999999999999;": "&#99999999999999999999;", "line\n&#10;&\n;": "line\n\n&\n;", "&": "&", "&;": "&;", "&#x85;&#127;&#9;&#xFFFE;": "&#x85;&#127;\t&#xFFFE;", "&#;&#x;": "&#;&#x;",
}


@pytest.mark.parametrize("law,cases", [(texts.sanitize, CLEAN), (texts.xml_unescape, REFERENCES)])
def test_cases(spark, law, cases):
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.out for r in df.select("t", law(F.col("t")).alias("out")).collect()} == cases
