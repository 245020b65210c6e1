import gzip
import json

import pytest
from pyspark.sql import functions as F

from lexitide.functions import text as X
from lexitide.schemas import MissingColumns
from lexitide.sources import jsonl, stores
from lexitide.streaming import ingest

LINES = [
    '{"doc_id":"a","rights_year":1934,"full_text":["x","y"]}',
    "",
    "   ",
    "{bad json",
    '{"doc_id":7,"rights_year":"1941","full_text":["x",42]}',
    '{"doc_id":"c","rights_year":null,"full_text":"notalist"}',
    '{"full_text":[]}',
    '{"doc_id":"e","rights_year":1950.5,"full_text":["z"]}',
]


def write(path, lines):
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


@pytest.fixture
def batches(tmp_path):
    d = tmp_path / "batches"
    d.mkdir()
    write(d / "batch_00.jsonl.gz", LINES)
    write(d / "batch_01.jsonl.gz", ['{"doc_id":"b","rights_year":1960,"full_text":["q"]}', '{"rights_year":1961,"full_text":["q"]}'])
    write(d / "batch_12.jsonl.gz", ['{"doc_id":"z","full_text":["last"]}'])
    return str(d)


def test_tolerant_scan(spark, batches):
    got = {r["doc_id"]: (r["rights_year"], r["full_text"]) for r in jsonl.read_docs(spark, batches, 0, 0).collect()}
    assert got == {"a": (1934, ["x", "y"]), "7": (1941, ["x", "42"]), "e": (1950, ["z"])}


def test_quarantine_reasons(spark, batches):
    raw = jsonl.raw_batches(spark, batches, 0, 0)
    assert sorted(r["reason"] for r in jsonl.quarantine(raw).collect()) == ["bad_json", "bad_tokens", "no_tokens"]
    counts = {r["batch"]: (r["processed"], r["skipped"]) for r in jsonl.ingest_counts(raw).collect()}
    assert counts == {"batch_00": (3, 3), None: (3, 3)}


def test_batch_range_and_order(spark, batches):
    got = jsonl.read_docs(spark, batches, start_batch=1).select("batch", "doc_id").orderBy("batch", "line_no").collect()
    assert [r["batch"] for r in got] == ["batch_01", "batch_01", "batch_12"]
    assert jsonl.read_docs(spark, batches, start_batch=2, end_batch=11).count() == 0


def test_missing_id_is_stable_and_unique(spark, batches):
    ids = [sorted(r["doc_id"] for r in jsonl.read_docs(spark, batches).collect()) for _ in range(2)]
    assert ids[0] == ids[1] and len(set(ids[0])) == len(ids[0])
    assert sum(i.startswith("doc_") for i in ids[0]) == 1


def test_file_index(spark):
    df = spark.createDataFrame([("batch_00.jsonl.gz",), ("b1_part2.jsonl.gz",), ("none.jsonl.gz",)], "n STRING")
    assert [r[0] for r in df.select(X.file_index(F.col("n"))).collect()] == [0, 12, -1]


def test_vector_store_replaces_only_its_batches(spark, tmp_path):
    path, meta = str(tmp_path / "v"), str(tmp_path / "m")
    schema = "doc_id STRING, rights_year INT, embedding ARRAY<DOUBLE>, batch STRING"
    stores.write_vectors(spark.createDataFrame([("a", 1900, [1.0, 2.0], "b0"), ("b", None, [3.0, 4.0], "b1")], schema), path, meta)
    stores.write_vectors(spark.createDataFrame([("c", 1901, [5.0, 6.0], "b1")], schema), path, meta)
    got = {r["doc_id"]: r["embedding"] for r in stores.read_vectors(spark, path).collect()}
    assert got == {"a": [1.0, 2.0], "c": [5.0, 6.0]}
    assert {r["doc_id"] for r in spark.read.json(meta).collect()} == {"a", "c"}
    assert len(stores.sources_of(stores.read_vectors(spark, path)).first()["sources"]) == 2
    check = stores.check_vectors(stores.read_vectors(spark, path)).collect()
    assert all(r["min_dim"] == r["max_dim"] == 2 and r["n_incomplete"] == 0 for r in check)


def test_label_csv(spark, tmp_path):
    p = tmp_path / "labels.csv"
    p.write_text("doc_id,label\n1,x\n2,\n")
    assert [(r[0], r[1]) for r in stores.read_labels(spark, str(p)).collect()] == [("1", "x"), ("2", None)]
    p2 = tmp_path / "bad.csv"
    p2.write_text("id,label\n1,x\n")
    with pytest.raises(MissingColumns):
        stores.read_labels(spark, str(p2))


def test_topic_csvs(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("topic,rank,word\n0,1,null\n0,2,b\n")
    assert [(r[0], r[1], r[2]) for r in stores.read_topic_words(spark, str(p)).collect()] == [(0, 1, "null"), (0, 2, "b")]
    tl = tmp_path / "tl.csv"
    tl.write_text("rights_year,0,1\n1999,0.5,NaN\n2000,,1\n")
    assert [tuple(r) for r in stores.read_timeline(spark, str(tl)).collect()] == [(1999, 0.5, None), (2000, None, 1.0)]
    bad = tmp_path / "bad.csv"
    bad.write_text("year,0\n1,2\n")
    with pytest.raises(MissingColumns):
        stores.read_timeline(spark, str(bad))
    with pytest.raises(MissingColumns):
        stores.read_topic_words(spark, str(bad))
    with pytest.raises(MissingColumns):
        stores.read_topic_info(spark, str(bad))
    info = tmp_path / "info.csv"
    info.write_text("Topic,Count,w1,w2\n0,5,a,b\n")
    assert stores.read_topic_info(spark, str(info)).first()["Representation"] == "a, b"


def test_kmeans_metric_files(spark, tmp_path):
    for k, sil in ((75, "n/a"), (50, 0.1), (100, None)):
        (tmp_path / f"kmeans_k{k}_metrics.json").write_text(
            json.dumps({"k": k, "inertia": float(k), "silhouette": sil, "n_docs": 3, "sources": ["a"]})
        )
    got = [(r["k"], r["silhouette"]) for r in stores.read_kmeans_metrics(spark, str(tmp_path)).collect()]
    assert got == [(50, 0.1), (75, None), (100, None)]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        stores.read_kmeans_metrics(spark, str(tmp_path / "empty"))


def test_csv_sink_quotes_and_nulls(spark, tmp_path):
    out = str(tmp_path / "out")
    stores.write_csv(spark.createDataFrame([("a,b", None, ["x", "y"])], "w STRING, y INT, l ARRAY<STRING>"), out)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert text.splitlines()[0] == '"w","y","l"'
    back = spark.read.option("header", True).option("escape", "\\").csv(out).first()
    assert back["w"] == "a,b" and back["y"] is None


def test_json_and_matrix_sinks(spark, tmp_path):
    stores.write_json(spark.createDataFrame([(1, None)], "k INT, s DOUBLE"), str(tmp_path / "j"))
    assert '"s":null' in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    stores.write_matrix(spark.createDataFrame([("a", [0.5, 0.5])], "doc_id STRING, dist ARRAY<DOUBLE>"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).first()["dist"] == [0.5, 0.5]


def test_split_reader_drops_nulls(spark, tmp_path):
    rows = [("1", "t", "x", "train"), ("2", None, "x", "train"), ("3", "t", None, "valid")]
    df = spark.createDataFrame(rows, "doc_id STRING, text STRING, label STRING, split STRING")
    stores.write_split(df, str(tmp_path / "s"))
    assert [r["doc_id"] for r in stores.read_split(spark, str(tmp_path / "s")).collect()] == ["1"]


def test_stream_equals_batch_and_takes_only_new_files(spark, batches, tmp_path):
    store, vec, ck = str(tmp_path / "store"), str(tmp_path / "vec"), str(tmp_path / "ck")
    ingest.ingest(spark, batches, store, ck, vec, max_files=1).awaitTermination()
    batch = jsonl.read_docs(spark, batches)

    def content(df):
        return sorted((r["batch"], r["rights_year"] or 0, tuple(r["full_text"])) for r in df.collect())

    assert content(spark.read.parquet(store)) == content(batch)
    assert spark.read.parquet(vec).count() == batch.count()
    write(f"{batches}/batch_13.jsonl.gz", ['{"doc_id":"n","rights_year":1934,"full_text":["new"]}'])
    ingest.ingest(spark, batches, store, ck, vec, max_files=1).awaitTermination()
    assert content(spark.read.parquet(store)) == content(jsonl.read_docs(spark, batches))
    ingest.yearly_counts(spark, batches, "yearly", str(tmp_path / "ck2"), 2).awaitTermination()
    got = {r["rights_year"]: r["n"] for r in spark.table("yearly").collect()}
    assert got == {r["rights_year"]: r["n"] for r in jsonl.read_docs(spark, batches).groupBy("rights_year").agg(F.count("*").alias("n")).collect()}


def test_made_up_ids_depend_on_file_and_place_only(spark, tmp_path):
    import gzip

    from lexitide.sources import jsonl
    from lexitide.streaming import ingest

    for b in range(1, 4):
        with gzip.open(tmp_path / f"batch_{b:02d}.jsonl.gz", "wt") as f:
            f.writelines(f'{{"rights_year": 19{b}0, "full_text": ["same", "words"]}}\n' for _ in range(3))

    def ids(df):
        return {(r["batch"], r["line_no"]): r["doc_id"] for r in df.collect()}

    whole = ids(jsonl.documents(jsonl.raw_batches(spark, str(tmp_path))))
    part = ids(jsonl.documents(jsonl.raw_batches(spark, str(tmp_path), start_batch=2)))
    assert len(set(whole.values())) == 9 and {n for _, n in whole} == {0, 1, 2}
    assert part == {k: v for k, v in whole.items() if k[0] != "batch_01"}
    ingest.ingest(spark, str(tmp_path), f"{tmp_path}/store", f"{tmp_path}/ck", max_files=1).awaitTermination()
    assert {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/store").collect()} == set(whole.values())


def test_package_reaches_executors_from_elsewhere(tmp_path):
    import os
    import subprocess
    import sys

    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {home!r})
from lexitide.session import local_session, ship_package
spark = local_session(1, 2, "1g")
ship_package(spark)
def where(batches):
    import lexitide.operators.blocks
    for b in batches:
        yield b
assert spark.range(3).mapInArrow(where, "id LONG").count() == 3
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_running_counts_over_folders_and_repeats(spark, tmp_path):
    """Two folders hold a file of one name; counts after each micro-batch are those of all files, however often they come."""
    from lexitide.operators import vocab

    root, store, counts = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "counts")
    for folder, year in (("a", 1901), ("b", 1902)):
        (root / folder).mkdir(parents=True)
        lines = [f'{{"rights_year":{year},"full_text":["both","{folder}{k % 2}","both"]}}' for k in range(5)]
        write(f"{root}/{folder}/batch_1.jsonl.gz", lines)
    write(f"{root}/a/batch_2.jsonl.gz", ['{"rights_year":1901,"full_text":["late","both"]}'])
    path = f"{root}/*"

    def state():
        return (
            [tuple(r) for r in ingest.running_vocab(spark, counts, 4, 2).orderBy("term_idx").collect()],
            sorted((r["rights_year"], r["n"]) for r in ingest.running_years(spark, counts).collect()),
            spark.read.parquet(store).count(),
        )

    def whole():
        docs = jsonl.read_docs(spark, path)
        years = docs.groupBy("rights_year").agg(F.count("*").alias("n"))
        return ([tuple(r) for r in vocab.build_vocab(docs, 4, 2).orderBy("term_idx").collect()], sorted(tuple(r) for r in years.collect()), docs.count())

    ingest.ingest(spark, path, store, str(tmp_path / "ck"), max_files=1, counts=counts).awaitTermination()
    first = state()
    assert first == whole() and first[1] == [(1901, 6), (1902, 5)] and first[2] == 11
    assert {r["batch"] for r in spark.read.parquet(store).select("batch").distinct().collect()} == {"a/batch_1", "b/batch_1", "a/batch_2"}
    ingest.ingest(spark, path, store, str(tmp_path / "ck-lost"), max_files=2, counts=counts).awaitTermination()
    assert state() == first
    write(f"{root}/b/batch_2.jsonl.gz", ['{"rights_year":1903,"full_text":["late","late"]}'])
    ingest.ingest(spark, path, store, str(tmp_path / "ck"), max_files=1, counts=counts).awaitTermination()
    assert state() == whole() and state()[2] == 12


def test_broadcast_goes_by_rows_and_bytes(spark):
    from lexitide.session import broadcast_if_small

    def hinted(df, **limits):
        return "broadcast" in broadcast_if_small(df, **limits)._jdf.queryExecution().logical().toString().lower()

    long = spark.range(50).select("id", F.repeat(F.lit("x"), 10_000).alias("text"), F.array("id").alias("ids"))
    assert hinted(long) and not hinted(long, max_rows=49) and not hinted(long, max_bytes=400_000)
    assert hinted(long.limit(0)) and hinted(spark.range(10).select(F.lit(None).cast("string").alias("s")))
