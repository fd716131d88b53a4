from helpers import rows
from pyspark.sql import functions as F

from fleetscope.operators.facts import file_facts
from fleetscope.sources import fact_store

FILES = "repo_id string, path string, content string"
FIRST = [("r", "a.py", "import os"), ("r", "b.py", "if x:\n    pass"), ("s", "c.py", "import os"), ("s", "bad.py", "def ("), ("s", "none.py", None), (None, "d.py", "y = 1")]


def test_a_second_run_parses_new_contents_only(spark, tmp_path):
    store = str(tmp_path / "facts")
    first = spark.createDataFrame(FIRST, FILES)
    assert fact_store.refresh(first, store) == 5  # one text stands in two files
    assert fact_store.refresh(first, store) == 0
    changed = spark.createDataFrame([*FIRST[:1], ("r", "b.py", "if x or y:\n    pass"), ("t", "new.py", "y = 1")], FILES)
    assert fact_store.refresh(changed, store) == 1
    assert spark.read.parquet(store).count() == 6
    assert fact_store.refresh(first, store, version=2) == 5


def test_stored_facts_are_those_of_the_files(spark, tmp_path):
    files = spark.createDataFrame(FIRST, FILES).withColumn("digest", F.lit("clash")).withColumn("version", F.lit(7))
    for bound in (10, 0):
        store = str(tmp_path / f"facts-{bound}")
        assert fact_store.refresh(files, store, broadcast_paths=bound) == 5
        columns = ["repo_id", "path", "error", "complexity", "endpoints", "db_queries", "mentioned_paths"]
        assert rows(fact_store.stored_file_facts(files, store), *columns) == rows(file_facts(files), *columns)


def test_empty_and_repeated(spark, tmp_path):
    store = str(tmp_path / "facts")
    assert fact_store.refresh(spark.createDataFrame([], FILES), store) == 0
    assert fact_store.known_facts(spark, store) is None
    assert fact_store.stored_file_facts(spark.createDataFrame(FIRST[:1] * 3, FILES), store).count() == 3
    assert fact_store.stored_file_facts(spark.createDataFrame([], FILES), store).count() == 0
