"""Plans that must hold at any size: narrow shuffles, no nested loops, early top-n."""

import os
import re

import pytest

from fleetscope.operators import commits, dependencies, facts, risks, rollups, smells
from fleetscope.plans import ordering
from workload import queries as work

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def node_details(text, name):
    """The detail blocks of one kind of plan node."""
    return [block for block in text.split("\n\n") if re.match(rf"\(\d+\) {name}\b", block.strip())]


def test_wide_text_is_never_shuffled(spark):
    found = work.file_facts(spark, SF)
    tables = [
        risks.regression_risks(work.changes(spark, SF)),
        rollups.service_rollup(found),
        dependencies.endpoint_dependencies(facts.endpoints(found), found),
        commits.change_set_summary(work.changes(spark, SF)),
    ]
    for table in tables:
        exchanges = node_details(plan(table), "Exchange")
        assert exchanges
        for block in exchanges:
            shipped = block.split("Arguments")[0]
            assert not re.search(r"\b(content|diff|removed_text|added_text)#", shipped), shipped


def test_no_nested_loops(spark):
    found = work.file_facts(spark, SF)
    steps = work.steps(spark, SF)
    for table in [
        dependencies.endpoint_dependencies(facts.endpoints(found), found),
        dependencies.shared_tables(rollups.service_tables(found)),
        ordering.resolved_dependencies(steps),
        commits.commit_records(work.commit_steps(spark, SF), work.changes(spark, SF), work.found_risks(spark, SF)),
    ]:
        assert not re.search("NestedLoop|CartesianProduct", plan(table))


def test_change_rules_read_the_table_once(spark):
    text = plan(risks.change_risks(work.changes(spark, SF)))
    assert len(node_details(text, "Scan parquet")) == 1


def test_top_n_is_cut_before_the_shuffle(spark):
    found = work.file_facts(spark, SF)
    for table in [
        smells.first_unversioned(facts.endpoints(found)),
        risks.first_changed_files(work.changes(spark, SF)),
        commits.first_semantic_changes(work.changes(spark, SF)),
        commits.release_risks(work.commit_steps(spark, SF), work.found_risks(spark, SF)),
    ]:
        text = plan(table)
        assert len(node_details(text, "WindowGroupLimit")) == 2 * len(node_details(text, "Window")) > 0


def test_discovery_reads_no_text(spark, tmp_path):
    from fleetscope.sources.files import discover_services

    files = spark.createDataFrame([("r", "services/a/x.py", "text")], "repo_id string, path string, content string")
    files.write.parquet(str(tmp_path / "files"))
    scan = node_details(plan(discover_services(spark.read.parquet(str(tmp_path / "files")))), "Scan parquet")[0]
    assert "ReadSchema: struct<repo_id:string,path:string>" in scan
