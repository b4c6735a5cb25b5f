"""Masters as a log of commits, and deliveries that arrive in parts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from acopio.plans import ingest, snapshots
from acopio.session import new_path
from acopio.streaming import incremental

ROW = "tipo string, anio int, v string"


def rows(spark, *given):
    return spark.createDataFrame(list(given), ROW)


def held(spark, root, *args):
    return sorted((r.tipo, r.anio, r.v) for r in ingest.read_master(spark, root, *args).collect())


def arrive(spark, path, n, delivery, parts=1, first=0):
    spark.range(first, first + n).repartition(parts).write.mode("append").parquet(f"{path}/{delivery}")


def take(spark, path, root, ledger, max_files=1, **options):
    sink = incremental.upsert_sink(root, F.lit("t"), F.lit(2020), **options)
    schema = spark.range(1).schema
    incremental.run_available(incremental.file_stream(spark, f"{path}/*", schema, max_files=max_files), sink, ledger)
    return sorted(r.id for r in ingest.read_master(spark, root).select("id").collect())


def test_parts_of_a_delivery_in_several_batches_stay_together(spark):
    root, path, ledger = (new_path(spark, x) for x in ("upsert", "in", "ledger"))
    arrive(spark, path, 100, "entrega-1", parts=4)
    assert take(spark, path, root, ledger) == list(range(100))           # one file a batch
    arrive(spark, path, 40, "entrega-1", first=100)
    assert take(spark, path, root, ledger) == list(range(140))           # a part that comes later
    arrive(spark, path, 30, "entrega-2", parts=2, first=500)
    assert take(spark, path, root, ledger) == list(range(500, 530))      # a new delivery replaces
    arrive(spark, path, 7, "entrega-0", first=900)
    assert take(spark, path, root, ledger) == list(range(500, 530))      # an older one does not win
    arrive(spark, path, 5, "entrega-2", first=600)
    assert take(spark, path, root, ledger) == [*range(500, 530), *range(600, 605)]
    assert len(snapshots.current(spark, root).held[("t", 2020)].folders) == 3


def test_an_older_delivery_wins_when_asked(spark):
    root, path, ledger = (new_path(spark, x) for x in ("upsert", "in", "ledger"))
    arrive(spark, path, 10, "entrega-2")
    assert len(take(spark, path, root, ledger)) == 10
    arrive(spark, path, 3, "entrega-1", first=70)
    assert take(spark, path, root, ledger, late="replace") == [70, 71, 72]


def test_full_reingest_with_a_new_ledger_doubles_nothing(spark):
    root, path = new_path(spark, "upsert"), new_path(spark, "in")
    arrive(spark, path, 20, "entrega-1", parts=2)
    arrive(spark, path, 60, "entrega-2", parts=3, first=100)
    for _ in range(2):
        assert take(spark, path, root, new_path(spark, "ledger")) == list(range(100, 160))


def test_a_batch_that_failed_is_taken_once(spark, monkeypatch):
    root, path, ledger = (new_path(spark, x) for x in ("upsert", "in", "ledger"))
    arrive(spark, path, 10, "entrega-1")
    take(spark, path, root, ledger)
    arrive(spark, path, 10, "entrega-1", first=10)
    whole = snapshots.commit

    def dies(*args):        # after the commit, so that the batch is run again although it is in
        whole(*args)
        raise OSError("lost")
    monkeypatch.setattr(snapshots, "commit", dies)
    with pytest.raises(Exception):
        take(spark, path, root, ledger)
    monkeypatch.undo()
    assert take(spark, path, root, ledger) == list(range(20))


def test_readers_stay_on_the_old_rows_until_the_commit(spark, monkeypatch):
    root = new_path(spark, "m")
    ingest.upsert_by_year(rows(spark, ("A", 2020, "a"), ("A", 2021, "b"), ("B", 2020, "c")), root)
    was = held(spark, root)

    def dies(*args):
        raise OSError("lost")
    monkeypatch.setattr(snapshots, "commit", dies)
    with pytest.raises(OSError):
        ingest.upsert_by_year(rows(spark, ("A", 2020, "new")), root)
    with pytest.raises(OSError):
        ingest.rewrite_master(ingest.read_master(spark, root, "A").where("anio = 2021"), root, "A")
    monkeypatch.undo()
    assert held(spark, root) == was
    ingest.rewrite_master(ingest.read_master(spark, root, "A").where("anio = 2021"), root, "A")
    assert held(spark, root) == [("A", 2021, "b"), ("B", 2020, "c")]


def test_a_rewrite_of_changed_rows_is_refused(spark):
    root = new_path(spark, "m")
    ingest.upsert_by_year(rows(spark, ("A", 2020, "a"), ("B", 2020, "c")), root)
    base = snapshots.current(spark, root)
    df = ingest.read_master(spark, root, "A", state=base).withColumn("v", F.upper("v"))
    ingest.upsert_by_year(rows(spark, ("B", 2021, "d")), root)     # another category: no conflict
    ingest.rewrite_master(df, root, "A", base)
    assert held(spark, root, "A") == [("A", 2020, "A")]
    ingest.upsert_by_year(rows(spark, ("A", 2022, "e")), root)
    with pytest.raises(snapshots.Conflict):
        ingest.rewrite_master(df, root, "A", base)
    assert held(spark, root, "A") == [("A", 2020, "A"), ("A", 2022, "e")]


def test_two_writers_of_one_number(spark):
    """The slower of two commits decides again on the state the faster one left."""
    root = new_path(spark, "m")
    slow = snapshots.write(rows(spark, ("A", 2020, "slow")), root)
    seen = []

    def decide(state):
        seen.append(state.version)
        if len(seen) == 1:
            ingest.upsert_by_year(rows(spark, ("A", 2020, "fast"), ("A", 2021, "fast")), root)
        return snapshots.put_all(slow)(state)
    snapshots.commit(spark, root, decide)
    assert seen == [0, 1] and held(spark, root) == [("A", 2020, "slow"), ("A", 2021, "fast")]


def test_columns_change_over_the_years(spark):
    root = new_path(spark, "m")
    ingest.upsert_by_year(spark.createDataFrame([("A", 2020, "x")], "tipo string, anio int, viejo string"), root)
    ingest.upsert_by_year(spark.createDataFrame([("A", 2021, 5, "y z")], "tipo string, anio int, `Año ñ` bigint, viejo string"), root)
    got = ingest.read_master(spark, root).orderBy("anio").collect()
    assert [(r.anio, r.viejo, r["Año ñ"]) for r in got] == [(2020, "x", None), (2021, "y z", 5)]
    assert ingest.read_master(spark, root, "A", 2020).columns == ["tipo", "anio", "viejo"]
    assert ingest.read_master(spark, root, "other").collect() == []
    with pytest.raises(FileNotFoundError):
        ingest.read_master(spark, new_path(spark, "none"))


def test_null_keys_odd_names_and_empty_rows(spark):
    root = new_path(spark, "m")
    given = [(None, 2020, "a"), ("a/b=c %41 é", None, "b"), ("A", 2020, None), ("A", 2020, None)]
    ingest.upsert_by_year(rows(spark, *given), root)
    ingest.upsert_by_year(rows(spark), root)
    assert Counter(tuple(r) for r in ingest.read_master(spark, root).select("tipo", "anio", "v").collect()) == Counter(given)
    assert ingest.stored_years(spark, root).count() == 3
    assert ingest.delete_stored(spark, root, "a/b=c %41 é") == 1 and ingest.stored_years(spark, root).count() == 2


def test_the_log_is_read_from_its_last_whole_state(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "FULL_EVERY", 3)
    root = new_path(spark, "m")
    for i in range(8):
        ingest.upsert_by_year(rows(spark, ("A", 2020 + i % 3, f"v{i}")), root)
    want = [("A", 2020, "v6"), ("A", 2021, "v7"), ("A", 2022, "v5")]
    assert held(spark, root) == want and snapshots.current(spark, root).version == 8
    assert snapshots.vacuum(spark, root) == 5 and held(spark, root) == want
    ingest.upsert_by_year(rows(spark, ("A", 2020, "v8")), root)
    assert held(spark, root) == [("A", 2020, "v8"), *want[1:]]


def test_running_counts_survive_a_failed_batch(spark, monkeypatch):
    table, path, ledger = (new_path(spark, x) for x in ("counts", "in", "ledger"))
    schema = spark.range(1).schema

    def count(to=ledger):
        stream = incremental.file_stream(spark, f"{path}/*", schema, max_files=1)
        incremental.stream_counts(stream, [(F.col("id") % 5).alias("k")], to, table)

    def now():
        return {r.k: r.registros for r in incremental.read_counts(spark, table).collect()}
    monkeypatch.setattr(incremental, "MERGE", 2)
    arrive(spark, path, 50, "a", parts=4)
    count()
    assert now() == {k: 10 for k in range(5)} and len(snapshots.current(spark, table).held) <= 3
    spark.createDataFrame([(3,), (3,)], "id bigint").coalesce(1).write.parquet(f"{path}/b")
    whole = snapshots.commit

    def dies(*args):
        raise OSError("lost")
    monkeypatch.setattr(snapshots, "commit", dies)
    with pytest.raises(Exception):
        count()
    assert now() == {k: 10 for k in range(5)}
    monkeypatch.setattr(snapshots, "commit", whole)
    count()
    assert now() == {0: 10, 1: 10, 2: 10, 3: 12, 4: 10}
    count(new_path(spark, "ledger"))
    assert now() == {0: 10, 1: 10, 2: 10, 3: 12, 4: 10}
