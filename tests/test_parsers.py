"""Answer parsers and prompts (fixture F-C)."""

from factlane.operators import parsing as P
from factlane.operators import prompts as R

# answer, lenient, structured, confidence  (FIXTURES F-C)
F_C = [
    (" True", 1, 1, "Unknown"),
    ("false.", 0, 0, "Unknown"),
    ("true or false", 1, None, "Unknown"),
    ("False, not true", 0, None, "Unknown"),
    ("untrue", 1, 1, "Unknown"),
    ("it is true, not false", None, None, "Unknown"),
    ("", None, None, "Unknown"),
    (None, None, None, "Unknown"),
    ("Classification: True\nConfidence: High", 1, 1, "High"),
    ("classification:false\nconfidence:low", 0, 0, "Low"),
    ("Classification: unsure\nClassification:True", 1, 1, "Unknown"),
    ("Classification: False. Or classification: true", None, 1, "Unknown"),
    ("Confidence: Low\nConfidence: High", None, None, "High"),
    ("CONFIDENCE: medium", None, None, "Medium"),
    ("Confidence:  high", None, None, "High"),
]


def test_fixture_f_c(spark):
    df = spark.createDataFrame([(i, a) for i, (a, *_r) in enumerate(F_C)], "id int, answer string")
    out = df.select("id", P.lenient_label().alias("l"), P.structured_label().alias("s"),
                    P.confidence_level().alias("c")).orderBy("id").collect()
    for row, (answer, lenient, structured, conf) in zip(out, F_C):
        assert (row["l"], row["s"], row["c"]) == (lenient, structured, conf), answer


def test_verifiability_labels(spark):
    df = spark.createDataFrame([("Verifiable",), ("Not Verifiable",), (" verifiable. ",), ("Error",), ("maybe",)],
                               "answer string")
    rows = df.select(P.verifiable_answer().alias("a"), P.verifiable_class().alias("c")).collect()
    assert [r["a"] for r in rows] == ["Verifiable", "Not Verifiable", "verifiable.", "Error", "maybe"]
    assert [r["c"] for r in rows] == ["Verifiable", "Not Verifiable", "Verifiable", "Error", "Other"]


def test_prompts(spark):
    df = spark.createDataFrame([("The sky is blue", "Health"), (None, None)], "claim string, domain string")
    rows = df.select(R.short_prompt().alias("p"), R.verifiability_prompt("claim").alias("v")).collect()
    assert rows[0]["p"] == 'Classify the following Health claim as true of false: "The sky is blue"  \nAnswer:'
    assert rows[1]["p"] == 'Classify the following None claim as true of false: "None"  \nAnswer:'
    assert 'Tweet: "nan"' in rows[1]["v"]
    assert rows[0]["v"].startswith("\n    Determine if the following tweet")
    s = df.select(R.structured_prompt().alias("s")).first()["s"]
    assert "Context: This claim appeared in Health content.\nClaim: \"The sky is blue\"" in s
    assert s.endswith("Justification: [Brief explanation]")
