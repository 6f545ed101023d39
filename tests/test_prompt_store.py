"""Repeated prompts are asked once; reruns and repeated batches add nothing."""

from pyspark.sql import functions as F

from pagelake.operators.prompt_store import answered, distinct_prompts, store_replies, stored_replies, to_ask

PROMPTS = [(k, kind, f"prompt {k % 5}") for k in range(200) for kind in ("intent", "page_type")] + [(900, "intent", None), (901, None, "x"), (902, "a", "1\nb"), (903, "a\n1", "b")]


def asked(spark):
    return spark.createDataFrame(PROMPTS, "row long, prompt_kind string, content string")


def model(work):
    return work.select("prompt_key", "attempt", F.concat(F.lit("reply to "), "prompt_kind", F.lit(" "), "content").alias("content"))


def test_each_prompt_is_asked_once_and_never_again(spark, tmp_path):
    path, prompts = str(tmp_path / "replies"), asked(spark)
    work = to_ask(prompts, stored_replies(spark, path))
    assert work.count() == distinct_prompts(prompts).count() == 12
    # Half of them answered, a quarter answered with nothing.
    some = work.withColumn("n", F.conv(F.substring("prompt_key", 1, 4), 16, 10).cast("int") % 4)
    for _ in range(2):
        store_replies(model(some.where("n < 2")).unionByName(some.where("n = 2").select("prompt_key", "attempt", F.lit(" ").alias("content"))), path, "b1")
    again = to_ask(prompts, stored_replies(spark, path))
    assert {(r.prompt_key, r.attempt) for r in again.collect()} == {(r.prompt_key, 2 if r.n == 2 else 1) for r in some.where("n >= 2").collect()}
    store_replies(model(again), path, "b2")
    assert to_ask(prompts, stored_replies(spark, path)).count() == 0
    rows = answered(prompts, stored_replies(spark, path)).collect()
    assert len(rows) == len(PROMPTS) - 2
    text = {(r, k): c for r, k, c in PROMPTS}
    assert all(r.reply == f"reply to {r.prompt_kind} {text[r.row, r.prompt_kind]}" for r in rows)


def test_the_first_usable_attempt_counts(spark, tmp_path):
    path = str(tmp_path / "replies")
    key = distinct_prompts(asked(spark).where("row = 3 and prompt_kind = 'intent'")).first().prompt_key
    for batch, rows in (("z", [(key, 2, "second")]), ("a", [(key, 3, "third"), (key, 1, None)]), ("b", [(key, 2, "second")])):
        store_replies(spark.createDataFrame(rows, "prompt_key string, attempt int, content string"), path, batch)
    got = {r.reply for r in answered(asked(spark).where("row = 3 and prompt_kind = 'intent'"), stored_replies(spark, path)).collect()}
    assert got == {"second"}
