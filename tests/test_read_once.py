"""Plans that read their rows once, and rules on rows of a small file that use all cores."""

import pytest

from lethe.plans import flows, registry, rules  # noqa: F401  (flows and rules register their queries)

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["chat_texts", "chat_request_parts"])
def test_requests_are_read_once(spark, capsys, name):
    # Branches of a union share out the cores, so that few tasks read a whole branch.
    registry.QUERIES[name].run(spark, SF).explain()
    assert "Union" not in capsys.readouterr().out


@pytest.mark.parametrize("name", ["escape_phrases", "admitted_usage"])
def test_rules_on_small_files_use_all_cores(spark, name):
    assert registry.QUERIES[name].run(spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_message_is_built_once(spark, capsys):
    # Its JSON went into each of a hundred places of the plan.
    registry.QUERIES["admitted_usage"].run(spark, SF).explain()
    assert capsys.readouterr().out.count("to_json") < 50


def test_held_back_chunks_are_read_once(spark, capsys):
    from lethe.streaming import holdback

    chunks = spark.read.parquet(f"{SF}/conversations.parquet").selectExpr("cast(conv_id as string) as stream_key", "turn as seq", "text as delta", "false as is_end")
    holdback.hold_back(chunks).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and "Union" not in plan
