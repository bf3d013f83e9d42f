"""Sources and sinks against real files in a temporary folder."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from filamet.sinks import tables as K
from filamet.sources import files, stores
from filamet.sources.images import import_channel
from filamet.streaming import campaign as SC


def test_scan_and_number_files(spark, tmp_path):
    for name, data in (("b.tif", b"two"), ("a.tiff", b"one"), ("skip.txt", b"no")):
        (tmp_path / name).write_bytes(data)
    got = files.number_cases(files.scan_files(spark, str(tmp_path))).orderBy("case_id").collect()
    assert [(r.case_id, r.filename) for r in got] == [("ZEISS_001", "a.tiff"), ("ZEISS_002", "b.tif")]
    assert got[0].sha256 == hashlib.sha256(b"one").hexdigest() and got[0].file_size_bytes == 3


def test_manifest_first_and_fallback(spark, tmp_path):
    inv = spark.createDataFrame([("a.tif",), ("b.tif",)], "filename string")
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"dataset_id": "D", "cases": [{"case_id": "K1", "filename": "b.tif"}, {"case_id": "K2", "filename": "gone.tif"}]}))
    got = files.manifest_first(files.read_manifest(spark, str(m)), inv, "dir").collect()
    assert [(r.dataset_id, r.case_id, r.filename) for r in got] == [("D", "K1", "b.tif")]
    m.write_text(json.dumps({"dataset_id": "D", "cases": [{"case_id": "K2", "filename": "gone.tif"}]}))
    got = files.manifest_first(files.read_manifest(spark, str(m)), inv, "dir").orderBy("case_id").collect()
    assert [(r.dataset_id, r.case_id) for r in got] == [("DATASET_dir", "ZEISS_001"), ("DATASET_dir", "ZEISS_002")]


def test_expected_count(spark):
    assert files.require_count(spark.range(3), 3, "images").count() == 3
    with pytest.raises(ValueError, match="exactly 16"):
        files.require_count(spark.range(3), 16, "images")


def test_corrupt_payload_is_a_row(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"image_id": "a", "results": [{"method_id": "FIELD", "status": "COMPLETE", "native_result": 2.5}]}')
    (tmp_path / "b.json").write_text('{"image_id": "b", "resu')
    p = stores.parse_payloads(stores.read_payload_text(spark, str(tmp_path)), "value", "path")
    assert sorted(r.read_status for r in p.collect()) == ["FAILED", "READ"]
    assert [r.native_result for r in stores.payload_methods(p, ["FIELD"], "path").collect()] == [2.5]


def test_review_store_rules(spark):
    cell = {"row": 0, "column": 0, "status": "MEASURED", "diameter": 1.5}
    good = json.dumps({"dataset_id": "D", "reviews": {"c": {"case_id": "c", "cells": [cell] + [{"row": i // 5, "column": i % 5} for i in range(1, 25)]}}})
    other = good.replace('"D"', '"E"')
    short = json.dumps({"dataset_id": "D", "reviews": {"c": {"case_id": "c", "cells": [cell]}}})
    cells = stores.parse_review_store(spark.createDataFrame([(good,), (other,)], "t string"), "t", "D")
    assert cells.count() == 25 and cells.where("status = 'MEASURED'").count() == 1
    with pytest.raises(Exception, match="exactly 25"):
        stores.parse_review_store(spark.createDataFrame([(short,)], "t string"), "t", "D").collect()


def test_channel_with_bad_range_fails(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0, 0.0, 1.0, 1, 1)], "image_id int, row int, col int, value double, x_range double, y_range double, width int, height int")
    with pytest.raises(Exception, match="ranges must be positive"):
        import_channel(df, ["image_id"]).collect()


def test_store_replaces_only_written_partitions(spark, tmp_path):
    path = str(tmp_path / "s")
    K.store_results(spark.createDataFrame([(1, "old"), (2, "old")], "image_id int, v string"), path)
    K.store_results(spark.createDataFrame([(2, "new")], "image_id int, v string"), path)
    assert {(r.image_id, r.v) for r in spark.read.parquet(path).collect()} == {(1, "old"), (2, "new")}


def test_csv_round_trip_of_quotes(spark, tmp_path):
    path = str(tmp_path / "c")
    K.write_csv(spark.createDataFrame([('a "b", c', None)], "x string, y string"), path)
    r = spark.read.option("header", True).option("escape", '"').csv(path).first()
    assert (r.x, r.y) == ('a "b", c', None)


def test_ingest_skips_seen_and_keeps_failures(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "id int, v double"

    def run():
        stream = spark.readStream.schema(schema).parquet(src)
        SC.ingest_new(spark, stream, "id", lambda d: d.select("id", (F.col("v") * 2).alias("w")), F.when(F.col("v") < 0, "NEGATIVE"), out, ck)
        return {r.id: (r.status, r.w, r.batch) for r in spark.read.option("basePath", out).parquet(out).collect()}

    spark.createDataFrame([(1, 1.0), (2, -1.0)], schema).coalesce(1).write.mode("append").parquet(src)
    first = run()
    assert first == {1: ("COMPLETE", 2.0, 0), 2: ("FAILED", None, 0)}
    spark.createDataFrame([(2, 5.0), (3, 3.0)], schema).coalesce(1).write.mode("append").parquet(src)
    assert run() == {**first, 3: ("COMPLETE", 6.0, 1)}


def test_review_state_over_two_batches_equals_batch(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "case_id int, cell int, status string, ts timestamp, event_id int"
    rows = [(1, 0, "A", "2024-01-01 00:00:00", 1), (1, 0, "B", "2024-01-02 00:00:00", 2), (1, 1, "C", "2024-01-01 00:00:00", 3), (1, 0, "late", "2023-01-01 00:00:00", 4)]
    df = spark.createDataFrame(rows, "case_id int, cell int, status string, t string, event_id int").select("case_id", "cell", "status", F.to_timestamp("t").alias("ts"), "event_id")
    for part in (df.where("event_id < 3"), df.where("event_id >= 3")):
        part.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        SC.run_review_state(stream, "case_id", "cell", "status", "ts", "event_id", out, ck)
    key = lambda r: (r.case_id, r.cell, r.status, r.revisions)
    got = sorted((int(r.case), int(r.cell), r.status, r.revisions) for r in SC.read_review_state(spark, out).collect())
    want = sorted(map(key, SC.review_state(df, "case_id", "cell", "status", "ts", "event_id").collect()))
    assert got == want == [(1, 0, "B", 3), (1, 1, "C", 1)]


def test_state_stays_bounded_over_fifty_batches(spark, tmp_path):
    """Each batch opens a case and closes the one before: the state never holds more than a few cells."""
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "case_id int, cell int, status string, ts timestamp, event_id int"
    rows = [(k - late, cell, f"S{k}", k * 100 + cell, k * 100 + cell + 50 * late) for k in range(50) for late in (0, 1) if k >= late for cell in range(3)]
    df = spark.createDataFrame(rows, "case_id int, cell int, status string, s int, event_id int").select("case_id", "cell", "status", F.timestamp_seconds("s").alias("ts"), "event_id")
    for k in range(50):  # one file per batch
        df.where(F.col("status") == f"S{k}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    sizes = SC.run_review_state(stream, "case_id", "cell", "status", "ts", "event_id", out, ck, closes=F.col("event_id") % 100 >= 50)
    assert len(sizes) >= 50 and max(sizes.values()) <= 8
    got = sorted((int(r["case"]), int(r["cell"]), r["status"], r["revisions"], r["last_ts"]) for r in SC.read_review_state(spark, out).collect())
    want = sorted((r["case_id"], r["cell"], r["status"], r["revisions"], r["last_ts"]) for r in SC.review_state(df, "case_id", "cell", "status", "ts", "event_id").collect())
    assert got == want and len(got) == 150
    # the batches are folded into one snapshot, and nothing happens without new files
    assert len(list((tmp_path / "out" / "changes").glob("batch=*"))) <= 1 and len(list((tmp_path / "out" / "snapshot").glob("upto=*"))) == 1
    SC.run_review_state(stream, "case_id", "cell", "status", "ts", "event_id", out, ck)
    assert SC.read_review_state(spark, out).count() == 150


def test_reopened_case_counts_on(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "case_id int, cell int, status string, ts timestamp, event_id int"
    rows = [(1, 0, "A", 10, 1), (1, 0, "closed", 20, 2), (1, 0, "again", 30, 3), (1, None, "x", 31, 4)]
    df = spark.createDataFrame(rows, "case_id int, cell int, status string, s int, event_id int").select("case_id", "cell", "status", F.timestamp_seconds("s").alias("ts"), "event_id")
    for part in (df.where("event_id < 3"), df.where("event_id = 3")):
        part.coalesce(1).write.mode("append").parquet(src)
        SC.run_review_state(spark.readStream.schema(schema).parquet(src), "case_id", "cell", "status", "ts", "event_id", out, ck, closes=F.col("status") == "closed")
    row = SC.read_review_state(spark, out).first()
    assert (row["status"], row["revisions"]) == ("again", 3)


def test_batches_read_their_own_buckets(spark, tmp_path):
    """What a batch reads of the key index does not grow with the history, and the buckets grow in number."""
    out = str(tmp_path / "results")
    index = SC.KeyIndex(spark, f"{out}-keys", "id", bits=1, bucket_keys=40)
    read = []
    for k in range(12):
        batch = spark.createDataFrame([(i,) for i in range(k * 30, k * 30 + 30)] + [(7,)], "id long").dropDuplicates()
        fresh = index.unseen(batch, k)
        assert fresh.count() == (30 if k else 30)
        index.add(fresh, k)
        one = spark.createDataFrame([(k * 30,)], "id long")
        paths = index.buckets_of(one)
        assert len(paths) == 1
        read.append(spark.read.parquet(*paths).count())
    assert max(read) <= 40 and index.level() >= 4
    # a replayed batch sees only what came before it
    assert index.unseen(spark.createDataFrame([(331,), (3,)], "id long"), 11).count() == 1
    assert index.unseen(spark.createDataFrame([(331,), (3,)], "id long"), 12).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_campaign_reads_a_table_in_one_file_or_many(spark, tmp_path, parts):
    from filamet.plans import catalog

    rows = [(i, "word " * i, 5 * i) for i in range(1, 80)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(parts).write.parquet(f"{tmp_path}/docs")
    if parts == 1:
        next((tmp_path / "docs").glob("part-*.parquet")).rename(tmp_path / "documents.parquet")
    else:
        (tmp_path / "docs").rename(tmp_path / "documents.parquet")
    got = {r.doc_id: (r.status, r.sha256) for r in catalog.QUERIES["r01_incremental_campaign"](spark, str(tmp_path)).collect()}
    assert got == {i: ("FAILED", None) if n < 200 else ("COMPLETE", hashlib.sha256(t.encode()).hexdigest()) for i, t, n in rows}
