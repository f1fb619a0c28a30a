import uuid

from pyspark.sql import functions as F

from rosterlake.operators import listing, pages
from rosterlake.sinks.tables import (
    GenerationTable,
    append_rows,
    merge_by_source_key,
    write_json,
    write_partitioned,
)
from rosterlake.sources.snapshots import latest_pages, live_entries, save_by_url
from rosterlake.spec import RecordSpec
from rosterlake.streaming.snapshots import (
    ChangeTracker,
    distinct_events,
    page_row_publisher,
    read_snapshot_stream,
)

ROWS = "_source_key string, name string"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


def test_replace_by_source_key(spark):
    old = spark.createDataFrame([("A/U", "old"), (" B/U ", "old"), ("C/U", "kept"), (None, None), ("", ""), (None, "kept too")], ROWS)
    keys = spark.createDataFrame([("A/U",), ("B/U",)], "_source_key string")
    new = spark.createDataFrame([("A/U", "new", "x")], ROWS + ", more string")
    merged = merge_by_source_key(old, keys, new)
    assert rows(merged) == [("A/U", "new", "x"), ("C/U", "kept", None), (None, "kept too", None)]
    again = merge_by_source_key(merged, keys, new)
    assert rows(again) == rows(merged)


def test_generations(spark, tmp_path):
    first = spark.createDataFrame([("A/U", "1"), ("B/U", "1"), ("C/U", "1")], ROWS)
    table = GenerationTable(spark, str(tmp_path / "t"), first.schema)
    table.commit(1, first, first)
    keys = spark.createDataFrame([("A/U",), ("B/U",)], "_source_key string")
    new = spark.createDataFrame([("A/U", "2")], ROWS)
    for _ in range(2):  # a retried run changes nothing
        table.commit(2, keys, new)
        assert rows(table.current(), "_source_key", "name") == [("A/U", "2"), ("C/U", "1")]
    compacted = table.compact(str(tmp_path / "c"))
    assert rows(compacted.current(), "_source_key", "name") == [("A/U", "2"), ("C/U", "1")]


def test_rows_without_committed_keys_are_not_current(spark, tmp_path):
    first = spark.createDataFrame([("A/U", "1")], ROWS)
    table = GenerationTable(spark, str(tmp_path / "t"), first.schema)
    table.commit(1, first, first)
    first.withColumn("name", F.lit("torn")).write.parquet(f"{tmp_path}/t/rows/run_no=2")
    assert rows(table.current(), "name") == [("1",)]


def test_partitioned_write_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    write_partitioned(spark.createDataFrame([("A", "1"), ("B", "1")], ROWS), path, "_source_key")
    write_partitioned(spark.createDataFrame([("B", "2")], ROWS), path, "_source_key")
    assert rows(spark.read.parquet(path), "_source_key", "name") == [("A", "1"), ("B", "2")]


def test_json_lines_and_logs(spark, tmp_path):
    df = spark.createDataFrame([("A", None), (None, "x")], ROWS)
    write_json(df, str(tmp_path / "j"))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "j")).collect())
    assert lines == ['{"_source_key":"A"}', '{"name":"x"}']
    for _ in range(2):
        append_rows(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_latest_and_live(spark):
    snaps = spark.createDataFrame([("u", 1, "a"), ("u", 3, "c"), ("u", 2, "b"), ("v", 1, "x")], "url string, run_no long, html string")
    assert rows(latest_pages(snaps), "url", "html") == [("u", "c"), ("v", "x")]
    entries = spark.createDataFrame([("never", None), ("short", 60), ("long", 86400)], "k string, ttl_sec long")
    entries = entries.withColumn("stored_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    live = live_entries(entries, F.lit("2024-01-01 00:01:00").cast("timestamp"))
    assert rows(live, "k") == [("long",), ("never",)]


def test_pages_saved_by_url_join_without_shuffle(spark, tmp_path):
    pages_df = spark.range(50).selectExpr("concat('u', id) AS url", "id AS run_no", "'x' AS html")
    spark.sql("DROP TABLE IF EXISTS t_old")
    spark.sql("DROP TABLE IF EXISTS t_new")
    save_by_url(pages_df, "t_old", 4, path=str(tmp_path / "old"))
    save_by_url(pages_df, "t_new", 4, path=str(tmp_path / "new"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("t_old").join(spark.table("t_new").select("url", "run_no"), "url")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE t_old")
        spark.sql("DROP TABLE t_new")


def test_changes_and_subtrees(spark):
    snaps = spark.createDataFrame(
        [("same", 1, "x"), ("same", 2, "x"), ("diff", 1, "x"), ("diff", 2, "y"), ("gone", 1, "x"), ("new", 2, "x"),
         ("older", 0, "z"), ("older", 1, "x"), ("older", 2, "x")],
        "url string, run_no long, html string",
    )
    changes = pages.changes_between(snaps, 2)
    want = [("diff", "changed"), ("gone", "gone"), ("new", "new"), ("older", "unchanged"), ("same", "unchanged")]
    assert rows(changes, "url", "status") == want
    prints = pages.fingerprint_snapshots(snaps)
    two = pages.page_changes(prints.where("run_no = 1"), prints.where("run_no = 2"))
    assert rows(two, "url", "status") == want
    edges = spark.createDataFrame([("same", "older"), ("older", "nowhere")], "src string, dst string")
    skip = {r["url"]: r["can_skip"] for r in pages.subtree_changes(changes, edges).collect()}
    assert skip == {"same": True, "older": False, "diff": False, "new": False, "gone": False}


def write_run(spark, path, run_no, rows_):
    df = spark.createDataFrame([(u, run_no, h) for u, h in rows_], "url string, run_no long, html string")
    df.coalesce(1).write.mode("append").parquet(path)


def test_stream_of_snapshots(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    seen = []
    tracker = ChangeTracker(spark, state, lambda df, b: seen.append((b, rows(df, "url"))))

    def go():
        stream = read_snapshot_stream(spark, source)
        tracker.start(stream, str(tmp_path / "cp")).awaitTermination()

    write_run(spark, source, 1, [("a", "1"), ("b", "1")])
    go()
    write_run(spark, source, 3, [("a", "1"), ("b", "2"), ("c", "1")])
    go()
    write_run(spark, source, 2, [("b", "late"), ("d", "1")])
    go()
    got = rows(tracker.changes(), "batch_id", "url", "status")
    assert got == [
        (0, "a", "new"), (0, "b", "new"), (1, "a", "unchanged"), (1, "b", "changed"), (1, "c", "new"), (2, "d", "new"),
    ]
    assert seen == [(0, [("a",), ("b",)]), (1, [("b",), ("c",)]), (2, [("d",)])]
    batch = spark.read.parquet(source).where("run_no = 3")
    tracker.process(batch, 1)  # the same batch again
    assert rows(tracker.changes(), "batch_id", "url", "status") == got


def test_rows_follow_changed_pages(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    names = "_source_key string, name string"
    table = GenerationTable(spark, str(tmp_path / "rows"), spark.createDataFrame([], names).schema)

    def rows_of(df):
        items = F.explode(F.regexp_extract_all("html", F.lit("<li>([^<]*)"), 1))
        return df.select("url", items.alias("name"))

    tracker = ChangeTracker(spark, state, page_row_publisher(table, rows_of))
    runs = [
        [("a", "<li>1<li>2"), ("b", "<li>3")],
        [("a", "<li>2"), ("b", "<li>3")],
        [("b", "nobody"), ("c", "<li>4")],
    ]
    for run_no, page_rows in enumerate(runs):
        write_run(spark, source, run_no, page_rows)
        stream = read_snapshot_stream(spark, source)
        tracker.start(stream, str(tmp_path / "cp")).awaitTermination()
    assert rows(table.current(), "_source_key", "name") == [("a", "2"), ("c", "4")]


def test_tracker_state_is_compacted(spark, tmp_path):
    """The same changes, whether state is read from a base or from all batches."""

    def changes(every):
        tracker = ChangeTracker(spark, str(tmp_path / f"every{every}"), compact_every=every)
        for b in range(5):
            batch = spark.createDataFrame(
                [("steady", b, "x"), ("moving", b, str(b)), (f"once{b}", b, "x"), ("late", 4 - b, str(b))],
                "url string, run_no long, html string",
            )
            tracker.process(batch, b)
            tracker.process(batch, b)
        return rows(tracker.changes(), "batch_id", "url", "status")

    got = changes(2)
    assert got == changes(100)
    assert (4, "steady", "unchanged") in got and (4, "moving", "changed") in got
    assert [r for r in got if r[1] == "late"] == [(0, "late", "new")]


def test_stream_without_duplicates(spark, tmp_path):
    path = str(tmp_path / "ev")
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:00:00")], "id long, t string")
    df.select("id", F.col("t").cast("timestamp").alias("ts")).write.parquet(path)
    stream = spark.readStream.schema("id long, ts timestamp").parquet(path)
    name = "out_" + uuid.uuid4().hex
    q = distinct_events(stream, ["id"], "ts", "1 hour").writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table(name), "id") == [(1,), (2,)]


def test_listing_rows_and_extractor(spark):
    html = (
        "<html><body><ul><li><a href='/p/ann'>Prof. Ann</a> Professor ann [at] a.edu</li>"
        "<li>nothing</li></ul><table><tr><td>Dr. Bob, Research Assistant bob@a.edu</td></tr></table></body></html>"
    )
    df = spark.createDataFrame([("https://a.edu/staff", html)], "url string, html string")
    got = rows(listing.listing_rows(df), "name", "profile_url", "email", "title", "is_academic_role")
    assert got == [
        ("", None, "bob@a.edu", "Dr.", False),
        ("Prof. Ann", "https://a.edu/p/ann", "ann@a.edu", "Prof.", True),
    ]
    spec = RecordSpec.from_dict({"columns": [{"name": "Name", "type": "extracted"}]})
    out = listing.extract_records(df, spec, lambda url, text: [{"Name": url, "junk": 1}, {}], max_tasks=2)
    assert rows(out, "url", "pos", "Name", "profile_url") == [
        ("https://a.edu/staff", 0, "https://a.edu/staff", None), ("https://a.edu/staff", 1, None, None),
    ]
