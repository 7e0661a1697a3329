"""op5's scan reads a text once: its candidates aren't made again in a condition."""

from voxelweave.llm import secrets


def test_scan_reads_texts_once(spark):
    docs = spark.createDataFrame([(1, 'x token = "0123456789abcdef0123456789abcdef01234567" y', "src0"), (2, "nothing here", "src0"), (3, "", "src0"), (4, None, "src0")], "doc_id long, text string, source string")
    got = secrets.scan(docs, secrets.train(spark))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(text") == 1 and plan.count("split(text") == 1
    assert [(r.doc_id, r.secret) for r in got.collect()] == [(1, "0123456789abcdef0123456789abcdef01234567")]
