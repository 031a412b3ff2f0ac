"""File readers, intake, the corpus lineage and the streaming jobs on small inputs."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from loomwright.operators import building as B
from loomwright.sources import corpus as CO
from loomwright.sources import stores as ST
from loomwright.streaming import jobs as J
from loomwright.streaming.runner import run_updates


def test_text_files(spark, tmp_path):
    long = "a line about pancreatitis that stays\nanother line of the body that stays"
    (tmp_path / "a.txt").write_text(long)
    (tmp_path / "b.json").write_text(json.dumps({"text": "", "content": long}))
    (tmp_path / "c.json").write_text("{broken " + long)
    (tmp_path / "d.json").write_text(json.dumps({"other": long}))
    rows = {r["path"].rsplit("/", 1)[1][0]: r for r in CO.read_text_files(spark, str(tmp_path)).collect()}
    assert rows["a"]["source_type"] == "txt" and rows["a"]["text"] == long
    assert rows["b"]["text"] == long and rows["b"]["source_type"] == "json"
    assert rows["c"]["text"].startswith("{broken ")
    assert "pancreatitis" in rows["d"]["text"]


def test_binary_extraction(spark, tmp_path):
    for name, content in {"ok": b"text", "empty": b" ", "bad": b"!"}.items():
        (tmp_path / f"{name}.pdf").write_bytes(content)

    def extractor(path, content):
        if content == b"!":
            raise ValueError("broken file")
        return content.decode().strip()

    rows = {r["path"].rsplit("/", 1)[1]: r for r in CO.extract_binary(CO.read_binary_files(spark, str(tmp_path), "*.pdf"), extractor).collect()}
    assert rows["ok.pdf"]["text"] == "text" and not rows["ok.pdf"]["error"]
    assert rows["empty.pdf"]["error"] and rows["bad.pdf"]["text"].endswith("broken file")


def test_templates(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"diseases": [{"name": "flu", "common_symptoms": ["a", "b"]}]}, indent=2))
    (tmp_path / "m.json").write_text(json.dumps({"drugs": [{"name": "tea", "treats": ["flu"]}]}))
    (tmp_path / "s.csv").write_text("id,name,severity,description\n1,cough,low,x\n")
    (tmp_path / "r.xml").write_text("<g><relation><source>a</source><target>b</target><type>T</type></relation></g>")
    (tmp_path / "t.csv").write_text("flu[疾病],症状, cough \nshort,row\n")
    assert CO.read_disease_template(spark, str(tmp_path / "d.json")).first()["common_symptoms"] == ["a", "b"]
    assert CO.read_medicine_template(spark, str(tmp_path / "m.json")).first()["treats"] == ["flu"]
    assert CO.read_symptom_template(spark, str(tmp_path / "s.csv")).first()["name"] == "cough"
    assert tuple(CO.read_relation_template(spark, str(tmp_path / "r.xml")).first()) == ("a", "b", "T")
    assert [tuple(r) for r in CO.read_triples(spark, str(tmp_path / "t.csv")).collect()] == [("flu[疾病]", "症状", "cough")]


def test_every_line_survives_the_lineage(spark):
    body = "\n".join(f"line number {w} about a patient" for w in ("one", "two", "three", "four"))
    lines = spark.createDataFrame([(0, f"p1\t{body}"), (1, "p1\tsecond shard about a patient"), (2, "no tab"), (3, "p2\tERROR: gone")], "pos int, value string")
    chunks = B.prepare_corpus(lines, size=60).orderBy("chunk_index").collect()
    assert " ".join(r["chunk"] for r in chunks) == (body + " second shard about a patient").replace("\n", " ")
    counts = B.stage_counts(lines, 60).first()
    assert (counts["extracted"], counts["cleaned"], counts["dropped"]) == (2, 1, 1)


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    ST.write_partitioned(spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), path, "k")
    ST.write_partitioned(spark.createDataFrame([(3, "b")], "v int, k string"), path, "k")
    assert sorted((r["v"], r["k"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]


def test_delete_keeps_rows_with_unknown_predicate(spark):
    store = spark.createDataFrame([("1", "a"), ("2", None)], "chunk_id string, kb_id string")
    assert [r["chunk_id"] for r in ST.delete_chunks(store, F.col("kb_id") == "a").collect()] == ["2"]


def test_message_state_over_batches(spark, tmp_path):
    schema = "conv_id bigint, turn bigint, role string, text string"
    for part, turns in enumerate([range(0, 8), range(8, 15)]):
        rows = [(1, t, "user", f"m{t}") for t in turns]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run_updates(J.last_messages(stream, 10))
    last = out.filter(F.col("batch") == out.agg(F.max("batch")).scalar()).orderBy("age").collect()
    assert len(last) == 10 and {r["turn"] for r in last} == set(range(5, 15)) and last[0]["turn"] == 14


def test_workers_import_the_package_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "job.py"
    script.write_text(f"""import sys
sys.path.append({root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", entry.queries()["ch3_sentence_blocks"](spark, "/root/testdata/sf0.001").count())
""")
    clean = {k: v for k, v in os.environ.items() if not k.startswith(("PYTHONPATH", "PYSPARK", "SPARK_"))}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("rows ")[1]) > 0


@pytest.mark.parametrize("parts", [1, 3])
def test_streams_read_tables_of_part_files(spark, tmp_path, parts):
    from loomwright.plans import all_queries

    rows = [(conv, turn, "user", f"{conv}:{turn}") for conv in range(4) for turn in range(12 + conv)]
    messages = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    if parts > 1:
        messages.repartition(parts).write.parquet(f"{tmp_path}/conversations.parquet")
    else:
        messages.toPandas().to_parquet(f"{tmp_path}/conversations.parquet", index=False)
    got = all_queries()["st6_last_messages"](spark, str(tmp_path)).collect()
    assert sorted((r["conv_id"], r["age"], r["turn"]) for r in got) == [(conv, age, 12 + conv - age) for conv in range(4) for age in range(1, 11)]
