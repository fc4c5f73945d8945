"""The id store: batches, repeated batches, broken-off runs, what a look-up reads."""

import os

import pytest

from jobweave.sources import seen, writers
from jobweave.sources.seen import SeenIds, append_unseen
from jobweave.sources.writers import append_new

SCHEMA = "job_id string, n int"


@pytest.fixture
def ids(rows):
    return lambda *values: rows(SCHEMA, [(v, i) for i, v in enumerate(values)])


def batches():
    """Ids of seven batches; ids come again within a batch, in the next one and much later."""
    return [[f"id{(7 * b + k * (b + 1)) % 40}" for k in range(12)] for b in range(7)]


def stored_rows(spark, out):
    return sorted((r.job_id or "", r.batch) for r in spark.read.parquet(out).select("job_id", "batch").collect())


@pytest.mark.parametrize("merge_at,buckets", [(1, 4), (3, 64), (100, 1)])
def test_batches_equal_a_plain_set(spark, ids, tmp_path, merge_at, buckets):
    out, store = str(tmp_path / "out"), SeenIds(str(tmp_path / "ids"), merge_at=merge_at, buckets=buckets)
    seen, want = set(), []
    for number, values in enumerate(batches()):
        append_unseen(ids(*values), out, store, number)
        want += [(v, number) for v in set(values) - seen]
        seen |= set(values)
        if number == 4:
            store.rewrite(spark)
    assert stored_rows(spark, out) == sorted(want)
    assert {r.job_id for r in store.stored(spark).collect()} == seen
    assert len(store.recent_batches(spark)) <= merge_at


def test_a_repeated_batch_adds_nothing(spark, ids, tmp_path):
    out, store = str(tmp_path / "out"), SeenIds(str(tmp_path / "ids"), merge_at=1)
    for number in (0, 0, 1, 1, 2, 2):
        append_unseen(ids(*batches()[number]), out, store, number)
    once = str(tmp_path / "once")
    for number in (0, 1, 2):
        append_unseen(ids(*batches()[number]), once, SeenIds(str(tmp_path / "once-ids")), number)
    assert stored_rows(spark, out) == stored_rows(spark, once)


def test_a_run_broken_off_is_repeated_whole(spark, ids, tmp_path, monkeypatch):
    out, store = str(tmp_path / "out"), SeenIds(str(tmp_path / "ids"), merge_at=2)
    append_unseen(ids("a", "b"), out, store, 0)
    with monkeypatch.context() as m:            # rows written, ids not
        m.setattr(SeenIds, "record", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            append_unseen(ids("b", "c"), out, store, 1)
    append_unseen(ids("b", "c"), out, store, 1)
    with monkeypatch.context() as m:            # merged, recent ids not removed
        m.setattr("jobweave.sources.seen._delete", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            append_unseen(ids("c", "d"), out, store, 2)
    append_unseen(ids("c", "d"), out, store, 2)
    assert stored_rows(spark, out) == [("a", 0), ("b", 0), ("c", 1), ("d", 2)]
    os.makedirs(tmp_path / "ids" / "parts" / "made=9" / "bucket=1")         # a rewrite that never ended
    store.merge(spark, 3)
    assert sorted(r.job_id for r in store.stored(spark).distinct().collect()) == ["a", "b", "c", "d"]
    store.rewrite(spark)
    assert sorted(r.job_id for r in store.stored(spark).collect()) == ["a", "b", "c", "d"]


def test_null_and_empty_ids_and_empty_batches(spark, ids, rows, tmp_path):
    out, store = str(tmp_path / "out"), SeenIds(str(tmp_path / "ids"), merge_at=1)
    append_unseen(rows(SCHEMA, []), out, store, 0)
    append_unseen(ids(None, None, "", ""), out, store, 1)
    append_unseen(ids(None, "", "x"), out, store, 2)
    assert stored_rows(spark, out) == [("", 1), ("", 1), ("", 1), ("", 2), ("x", 2)]


def test_first_row_of_an_id_stays(spark, rows, tmp_path):
    schema = "job_id string, crawled_at string, bucket int, batch_no int"
    batch = rows(schema, [("a", "2001-02-01", 7, 1), ("a", "2001-01-01", 8, 2), ("b", None, 9, 3)])
    append_unseen(batch, str(tmp_path / "out"), SeenIds(str(tmp_path / "ids")), 0)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()
    assert sorted(tuple(r) for r in got) == [("a", "2001-01-01", 8, 2), ("b", None, 9, 3)]


def test_a_look_up_reads_the_buckets_it_touches(spark, ids, tmp_path):
    store = SeenIds(str(tmp_path / "ids"), merge_at=1, buckets=64)
    store.record(spark.range(5000).selectExpr("concat('k', id) AS job_id", "1 AS n"), 0)
    store.merge(spark, 1)
    fresh = store.fresh(ids("k1", "k2", "other"), 1)
    text = fresh._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in text or "PartitionFilters: [bucket" in text, text
    touched = {r.b for r in ids("k1", "k2", "other").select(store.bucket().alias("b")).collect()}
    read = {int(f.split("bucket=")[1].split("/")[0]) for f in store.stored(spark, sorted(touched)).inputFiles()}
    files = {r.f for r in store.stored(spark, sorted(touched)).selectExpr("input_file_name() AS f").distinct().collect()}
    assert len(read) == 64 and {int(f.split("bucket=")[1].split("/")[0]) for f in files} <= touched
    assert [r.job_id for r in fresh.collect()] == ["other"]
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sent,large", [(0, 0), (1_000_000, 0), (0, 10 ** 9)])
def test_appended_rows_equal_a_plain_set(spark, ids, tmp_path, monkeypatch, sent, large):
    monkeypatch.setattr(seen, "SENT_ROWS", sent)
    monkeypatch.setattr(writers, "LARGE_STORED", large)
    path, known, want = str(tmp_path / "out"), set(), []
    for values in [*batches()[:4], [None, None, "", "id1"], []]:
        append_new(spark, ids(*values), path)
        want += ["" if v is None else v for v in set(values) - known]
        known |= set(values) - {None}
    assert sorted(r.job_id or "" for r in spark.read.parquet(path).collect()) == sorted(want)


def test_a_key_of_another_type_is_still_found(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "LARGE_STORED", 0)
    path = str(tmp_path / "out")
    append_new(spark, rows("job_id int, n int", [(1, 1), (2, 2)]), path)
    batch = rows("job_id long, n int", [(2, 3), (3, 4)]).persist()
    assert seen.met(spark.read.parquet(path), batch, "job_id", 2).count() == 2
    unseen = append_new(spark, batch, str(tmp_path / "out"))
    assert [r.job_id for r in unseen.collect()] == [3] and batch.storageLevel.useMemory


def test_stored_ids_are_not_shuffled(spark, ids, tmp_path):
    spark.range(5000).selectExpr("concat('k', id) AS job_id", "1 AS n").write.parquet(str(tmp_path / "out"))
    stored, batch = spark.read.parquet(str(tmp_path / "out")).select("job_id"), ids("k1", "k2", "other", None)
    found = seen.met(stored, batch, "job_id", 4)
    assert "BroadcastHashJoin" in plan(found) and "Exchange hashpartitioning" not in plan(found)
    assert sorted(r.job_id for r in found.collect()) == ["k1", "k2"]
    store = SeenIds(str(tmp_path / "ids"), merge_at=1, buckets=4)
    store.record(stored, 0)
    scan = plan(store.fresh(batch, 1)).split("LeftSemi")
    assert len(scan) == 2 and "hashpartitioning" not in scan[1]
    assert sorted(r.job_id or "" for r in store.fresh(batch, 1).collect()) == ["", "other"]


def test_merges_join_small_files(spark, ids, tmp_path, monkeypatch):
    monkeypatch.setattr(seen, "FILES", 2)
    out, store = str(tmp_path / "out dir"), SeenIds(str(tmp_path / "ids dir"), merge_at=1, buckets=4)
    known, most = set(), 0
    for number in range(12):
        values = [f"id{number}-{k}" for k in range(40)] + [f"id{number // 2}-1"]
        append_unseen(ids(*values), out, store, number)
        known |= set(values)
        files = [f for _, _, names in os.walk(tmp_path / "ids dir" / "parts") for f in names if f.endswith(".parquet")]
        most = max(most, len(files))
    assert most <= 6 * 4
    assert sorted(r.job_id for r in store.stored(spark).collect()) == sorted(known)
    assert spark.read.parquet(out).count() == len(known)
