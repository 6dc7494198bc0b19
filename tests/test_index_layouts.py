from pyspark.sql import functions as F

from tarnflow.functions import text
from tarnflow.operators import blockmax, index
from tarnflow.operators.segments import SegmentedIndex

ROWS = [(i, f"w{i % 7} some wörds of {i} {'漢字 ' * (i % 3)}") for i in range(90)] + [(3, "another text"), (90, None)]


def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, content string").repartition(3)


def test_a_file_of_postings_has_all_terms_of_its_blocks(spark, tmp_path):
    """So a query's documents are added up where they are read; before, files went by terms and each posting was shuffled."""
    blockmax.write(docs(spark), str(tmp_path), per_block=8, files=3)
    files = spark.read.parquet(f"{tmp_path}/postings").select("block", F.input_file_name()).distinct().groupBy("block").agg(F.count("*").alias("n"))
    assert files.count() == 12 and files.where("n > 1").count() == 0


def test_a_segment_keeps_counts_beside_terms(spark, tmp_path):
    """Postings are read off the forward table; before, texts were counted a second time to deal postings out."""
    held = SegmentedIndex.create(spark, str(tmp_path))
    assert held.insert(docs(spark)) == 91
    _, (segment,) = held.state()
    forward = spark.read.parquet(f"{tmp_path}/{segment.name}/forward")
    assert forward.where("coalesce(aggregate(tf, 0L, (a, x) -> a + x), 0) <> doc_len OR size(tf) <> size(terms)").count() == 0
    rows = spark.read.parquet(f"{tmp_path}/{segment.name}/postings")
    assert rows.count() == index.postings(docs(spark)).count() == segment.width


def test_lengths_come_with_the_counts(spark, tmp_path):
    """Before, saving joined all postings to the documents' lengths."""
    found = index.counted(docs(spark))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    want = docs(spark).groupBy("doc_id").agg(F.sum(text.doc_len(F.col("content"))).alias("n"))
    assert found.join(want, "doc_id").where("doc_len = n").count() == found.count() == 91
