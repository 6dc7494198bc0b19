import pytest

from tarnflow.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("parts", [0, 3])
def test_streams_read_a_file_and_a_folder_of_parts(spark, tmp_path, parts):
    base = SF
    if parts:
        base = str(tmp_path)
        for name in ("events", "conversations"):
            catalog.table(spark, SF, name).repartition(parts).write.parquet(f"{base}/{name}.parquet")
    assert catalog.audit_stream(spark, base).count() == catalog.table(spark, SF, "events").count()
    wanted = sorted(map(tuple, catalog.fact_latest(spark, SF).collect()))
    assert wanted and sorted(map(tuple, catalog.facts_stream(spark, base).collect())) == wanted
