"""Claim rules, domain tags, keyword baseline (fixture F-B) and the JSONL reader."""

import json

import pytest
from pyspark.sql import functions as F

from factlane.operators import baselines as B
from factlane.operators import claims as C
from factlane.sources import posts

# text, claim-like, domain, keyword baseline  (FIXTURES F-B)
F_B = [
    ("The vaccine is safe", True, "Health", 1),
    ("Maybe the vaccine is safe", False, "Health", 1),
    ("Simon is here", False, None, 1),
    ("This works", False, None, 1),
    ("Trump was in Ukraine", True, "Politics", 1),
    ("Health policy will change", True, "Health", 1),
    ("The award was big", True, "War", 1),
    ("BREAKING: it is over", True, None, 0),
    ("You won't believe what they can do", True, None, 0),
    ("line one is\nline two", True, None, 1),
]


def test_fixture_f_b(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_rest) in enumerate(F_B)], "id int, text string")
    out = df.select("id", C.is_claim_like("text").alias("claim"), C.detect_domain("text").alias("domain"),
                    B.keyword_baseline("text").alias("kw")).orderBy("id").collect()
    for row, (_, claim, domain, kw) in zip(out, F_B):
        assert (row["claim"], row["domain"], row["kw"]) == (claim, domain, kw)


def test_word_match_option(spark):
    df = spark.createDataFrame([("The award was big",), ("war is here",)], "text string")
    got = [r[0] for r in df.select(C.detect_domain("text", match="word")).collect()]
    assert got == [None, "War"]


def test_unicode_word_boundary(spark):
    # "éis": no whole-word "is" (Unicode-aware boundary)
    df = spark.createDataFrame([("éis here",), ("it is",)], "text string")
    assert [r[0] for r in df.select(C.has_aux_verb("text")).collect()] == [False, True]


def test_language_filter(spark):
    df = spark.createDataFrame([("a is", ["eng"]), ("a is", ["jpn", "eng"]), ("a is", None), ("", ["eng"]),
                                ("a is", [])], "text string, langs array<string>")
    assert [r[0] for r in df.select(C.has_text_in_language()).collect()] == [True, True, False, False, False]


def _write_jsonl(tmp_path):
    lines_a = [
        json.dumps({"post_id": 1, "text": "The vaccine is safe", "langs": ["eng"]}),
        "nonsense",
        "",
        '{"text":"a"',
        "null",
        "[1]",
        json.dumps({"post_id": 2, "langs": "eng", "text": "x is"}),
        json.dumps({"post_id": 3, "langs": ["eng"], "text": ""}),
        json.dumps({"post_id": 4, "langs": ["jpn", "eng"], "text": "Trump was here\nand there"}),
    ]
    lines_b = [json.dumps({"post_id": 5, "text": "maybe it is", "langs": ["eng"]}),
               json.dumps({"post_id": 6, "text": "nothing here", "langs": ["eng"]})]
    (tmp_path / "10.jsonl").write_text("\n".join(lines_a) + "\n", encoding="utf-8")
    (tmp_path / "11.jsonl").write_text("\n".join(lines_b) + "\n", encoding="utf-8")
    (tmp_path / "notes.txt").write_text("not read\n", encoding="utf-8")
    return str(tmp_path)


def test_jsonl_reader_and_bad_lines(spark, tmp_path):
    folder = _write_jsonl(tmp_path)
    lines = posts.read_lines(spark, folder)
    assert lines.count() == 11  # notes.txt skipped
    report = {(r["filename"], r["reason"]): r["n_lines"] for r in posts.bad_line_report(lines).collect()}
    assert report == {("10.jsonl", "invalid_json"): 3, ("10.jsonl", "not_object"): 2}
    parsed = posts.parse_posts(lines)
    assert parsed.count() == 6
    claims = C.extract_claims(parsed).select("post_id", "filename").orderBy("post_id").collect()
    assert [(r[0], r[1]) for r in claims] == [(1, "10.jsonl"), (4, "10.jsonl")]
    funnel = {r["stage"]: r["n"] for r in C.claim_funnel(parsed).collect()}
    assert funnel == {"read": 6, "with_text_in_language": 4, "hedged": 1, "no_verb": 1, "claims": 2}


def test_newline_kept_and_escaped(spark, tmp_path):
    from factlane.sources.sinks import write_claim_lines
    df = spark.createDataFrame([("line one is\nline two",), ("back\\slash is",)], "text string")
    write_claim_lines(df, str(tmp_path / "out"))
    back = sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert back == ["back\\\\slash is", "line one is\\nline two"]


@pytest.mark.parametrize("text,expected", [("  \t  ", ""), ("  ab \n", "ab"), ("a", "a")])
def test_python_strip(spark, text, expected):
    from factlane.functions.text import ustrip
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(ustrip("t")).first()[0] == expected
    assert text.strip() == expected
