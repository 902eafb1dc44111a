import pytest

from basalt.functions.text import blocks, plain, split_recursive
from basalt.operators.storage import scratch
from basalt.streaming.ingest import RESCUE, SchemaMismatch, assert_schema, read_csv, stream_to_table

DDL = "id long, ts timestamp, x double"


@pytest.fixture
def landing(spark, tmp_path):
    from pyspark.sql.types import StructType

    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "a.csv").write_text("id,ts,x\n1,2024-01-01 00:00:00,1.5\nbad,2024-01-01 00:00:00,2\n3,2024-01-01 00:00:00,3,extra\n")
    (folder / "b.csv").write_text("id,ts,x\n4,2024-01-02 00:00:00,4.0\n")
    return str(folder), StructType.fromDDL(DDL)


def test_rescue(spark, landing):
    rows = {r.id: r for r in read_csv(spark, *landing).collect()}
    assert rows[1].x == 1.5 and rows[1][RESCUE] is None and rows[1].source_file.endswith("a.csv")
    assert sum(r[RESCUE] is not None for r in rows.values()) == 2


def test_stream_takes_each_file_once(spark, landing):
    target, offsets = scratch(spark, "s"), scratch(spark, "o")
    assert stream_to_table(spark, *landing, target, offsets, "L1") == 4
    assert stream_to_table(spark, *landing, target, offsets, "L2") == 0
    assert spark.read.parquet(target).select("batch_id").distinct().count() == 1


def test_schema_assertion(spark):
    from pyspark.sql.types import StructType

    df = spark.createDataFrame([], DDL)
    assert_schema(df.select("x", "ts", "id"), StructType.fromDDL(DDL))
    with pytest.raises(SchemaMismatch):
        assert_schema(df.drop("x"), StructType.fromDDL(DDL))


def test_splitter():
    text = ". ".join(f"Sentence number {i} goes on for a while" for i in range(60))
    chunks = split_recursive(text, 300, 60)
    assert all(len(c) <= 300 for c in chunks) and len(chunks) > 5
    assert all(f"number {i} " in " ".join(chunks) for i in range(60))
    assert split_recursive("x" * 1000, 300, 60)[1] == "x" * 300 and split_recursive(" ", 10, 2) == []


def test_blocks_and_accents():
    assert blocks("<h1>A&amp;B</h1><script>no</script><p>one <b>two</b></p>") == [{"kind": "heading", "text": "A&B"}, {"kind": "prose", "text": "one two"}]
    assert plain("Ñandú É") == "nandu e"
