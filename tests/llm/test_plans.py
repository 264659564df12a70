"""What the plans of the queries must and must not hold."""

import os
import re

import pytest

pytest.importorskip("framewright.llm")

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op1_divergence", "op2_mixing"])
def test_native_queries_run_no_python(spark, name):
    from framewright.llm import queries

    plan = plan_of(queries.queries()[name](spark, SF))
    assert not re.search("Python|Pandas|Arrow", plan) and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["op4_toxicity", "op6_packing", "op8_main_text", "op10_mpeg_audio"])
def test_rows_are_not_shuffled(spark, name):
    from framewright.llm import queries

    plan = plan_of(queries.queries()[name](spark, SF))
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_scans_read_only_what_is_used(spark):
    from framewright.llm import queries

    for name in ("op4_toxicity", "op6_packing", "op10_mpeg_audio"):
        plan = plan_of(queries.queries()[name](spark, SF))
        assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan), plan


def test_lookups_reach_the_files(spark):
    import public_tokenizers

    from framewright.llm.common import new_path, table
    from framewright.llm.tokenfiles import lookup, write_orc

    write_orc(table(spark, SF, "documents"), path := new_path(spark, "orc"), public_tokenizers.path("byte_bpe_50k.json"))
    plan = plan_of(lookup(spark, path, [3, 99]))
    assert re.search(r"PushedFilters: \[.*In\(doc_id", plan)
