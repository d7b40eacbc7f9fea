"""The extraction chain on a file stream gives the batch chain's rows."""

import json

from pyspark.sql import functions as F

from factlane.operators import claims as C
from factlane.sources import posts
from factlane.streaming import claim_stream, domain_counts, write_claims


def _drop(folder, name, objs):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(o if isinstance(o, str) else json.dumps(o) for o in objs) + "\n",
                               encoding="utf-8")


def test_stream_matches_batch(spark, tmp_path):
    src = tmp_path / "in"
    _drop(src, "1.jsonl", [{"post_id": 1, "text": "The vaccine is safe", "langs": ["eng"]},
                           {"post_id": 2, "text": "maybe it is", "langs": ["eng"]}, "broken {"])
    _drop(src, "2.jsonl", [{"post_id": 3, "text": "Trump was here", "langs": ["eng"]},
                           {"post_id": 4, "text": "war is over", "langs": ["fra"]}])
    out = str(tmp_path / "out")
    q = write_claims(claim_stream(spark, str(src)), out, name=f"t-{tmp_path.name}")
    q.awaitTermination(120)
    got = sorted((r["post_id"], r["domain"]) for r in spark.read.parquet(out).collect())
    batch = C.tag_domains(C.extract_claims(posts.read_posts(spark, str(src))), keep_untagged=True)
    expect = sorted((r["post_id"], r["domain"]) for r in batch.collect())
    assert got == expect == [(1, "Health"), (3, "Politics")]


def test_stream_domain_counts(spark, tmp_path):
    src = tmp_path / "in2"
    _drop(src, "a.jsonl", [{"post_id": i, "text": "the army is here", "langs": ["eng"]} for i in range(3)])
    q = (domain_counts(claim_stream(spark, str(src))).writeStream.format("memory").queryName("dc_test")
         .outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination(120)
    rows = {r["domain"]: r["n"] for r in spark.sql("SELECT * FROM dc_test").collect()}
    assert rows == {"War": 3}
