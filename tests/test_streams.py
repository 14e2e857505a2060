"""Streams over several micro-batches: order, late and repeated events, and state that goes; and work that is kept between runs."""

import datetime
import uuid

import pandas as pd
import pytest

T0 = datetime.datetime(2024, 5, 1, 12, 0, 0)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def run(spark, folder, batches, schema, how):
    """Each list of rows is one micro-batch; gives what was written, and how many state rows are left."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"in/batch{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder / "in/batch*"))
    out = how(stream)
    query = out.writeStream.format("parquet").outputMode("append").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return spark.read.schema(out.schema).parquet(str(folder / "out")).collect(), left[-1]


EVENTS = "event_id long, session_id long, action string, ts timestamp"


def test_rate_limit_expires(spark, tmp_path):
    from paperlake.streaming.sessions import rate_limited

    batches = [
        [(1, 1, "chat", at(0)), (2, 1, "chat", at(0.2)), (3, 1, "chat", at(0.4)), (4, 2, "chat", at(0.5)), (5, None, "chat", at(0.5))],
        [(6, 1, "chat", at(0.9)), (7, 1, "chat", at(1.0)), (8, 2, "chat", at(30))],  # 6 in the first window, 7 begins another
        [(9, 1, "chat", at(1.5)), (10, 3, "chat", at(300))],  # 9 is behind the watermark (30 - 10 minutes)
        [(11, 3, "chat", at(300.1))],
    ]
    rows, left = run(spark, tmp_path, batches, EVENTS, lambda s: rate_limited(s, "2/minute"))
    assert sorted((r.event_id, r.n, r.retry_after) for r in rows) == [(3, 3, 36), (6, 4, 6)]
    assert left == 1  # sessions 1 and 2 are gone


def test_uploads_expire(spark, tmp_path):
    from paperlake.streaming.sessions import session_uploads

    batches = [[(i, 1, "upload", at(i)) for i in range(1, 8)], [(20, 1, "chat", at(100)), (21, 1, "upload", at(110))], [(30, 1, "upload", at(400)), (31, 2, "upload", at(401))], [(40, 2, "chat", at(900))]]
    rows, left = run(spark, tmp_path, batches, EVENTS, session_uploads)
    got = {r.event_id: (r.taken, r.remaining) for r in rows}
    assert [got[i] for i in (1, 5, 6, 21, 30, 31)] == [(True, 4), (True, 0), (False, 0), (False, 0), (True, 4), (True, 4)]
    assert left == 1


def test_recent_turns(spark, tmp_path):
    from paperlake.streaming.sessions import recent_turns

    schema = "session_id long, turn long, query string, response string, ts timestamp"
    batches = [
        [(1, t, f"q{t}", f"r{t} [1]", at(t)) for t in (2, 1, 3)],
        [(1, 3, "again", "x", at(4)), (1, 4, None, None, at(5)), (2, 1, "other", "y", at(5))],
        [(2, 2, "late session", "z", at(200))],
        [(1, 9, "new", "w", at(500))],
        [(3, 1, "end", "", at(2000))],
    ]
    rows, left = run(spark, tmp_path, batches, schema, lambda s: recent_turns(s, most=3))
    assert {(r.session_id, r.turn, r.place, r.query, r.response) for r in rows} == {
        (1, 3, 1, "q3", "r3"), (1, 2, 2, "q2", "r2"), (1, 1, 3, "q1", "r1"),
        (1, 4, 1, "", ""), (1, 3, 2, "q3", "r3"), (1, 2, 3, "q2", "r2"), (2, 1, 1, "other", "y"),
        (2, 2, 1, "late session", "z"), (1, 9, 1, "new", "w"), (3, 1, 1, "end", ""),
    }
    assert left == 1


def test_once_each(spark, tmp_path):
    from paperlake.streaming.sessions import once_each

    batches = [[(1, 1, "a", at(0)), (1, 1, "a", at(1))], [(1, 1, "a", at(2)), (2, 1, "a", at(3))], [(3, 1, "a", at(500))], [(6, 1, "a", at(501))], [(1, 1, "a", at(502)), (4, 1, "a", at(5))], [(5, 1, "a", at(900))]]
    rows, left = run(spark, tmp_path, batches, EVENTS, lambda s: once_each(s, ("event_id",)))
    # event 1 comes once within the delay, and once more when its state is gone; 4 is behind the watermark
    assert sorted(r.event_id for r in rows) == [1, 1, 2, 3, 5, 6] and left == 1


def test_index_grows_and_repeats(spark, tmp_path):
    from paperlake.operators.increments import incremental_index, run_status

    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    docs = [(1, "a" * 25), (2, None), (3, ""), (4, "b" * 5), (1, "a" * 25)]
    frame = lambda rows: spark.createDataFrame([(*r, "other") for r in rows], "doc_id long, text string, content string")
    assert run_status(spark, path).count() == 0
    first = sorted((r.doc_id, r.chunk_number, r.content) for r in incremental_index(frame(docs), path, 10, 2).collect())
    assert first == [(1, 1, "a" * 10), (1, 2, "a" * 10), (1, 3, "a" * 9), (1, 4, "a"), (4, 1, "b" * 5)]
    assert tuple(run_status(spark, path).first())[1:] == (2, 5, "success")
    assert incremental_index(frame(docs), path, 10, 2).count() == 5 and run_status(spark, path).first().status == "nothing new"
    more = incremental_index(frame([*docs, (4, "changed"), (9, "new")]), path, 10, 2)
    assert sorted((r.doc_id, r.content) for r in more.where("doc_id > 3").collect()) == [(4, "b" * 5), (4, "changed"), (9, "new")]
    assert tuple(run_status(spark, path).first())[1:] == (2, 2, "success")
    assert more.groupBy("doc_key", "chunk_number").count().where("count > 1").count() == 0
    assert incremental_index(frame([]), path).count() == 7


@pytest.fixture
def counted(tmp_path):
    """A reader that leaves a mark for each request it is asked."""
    marks = tmp_path / "marks"
    marks.mkdir()

    def reader(requests):
        if (requests["page"] == 13).any():
            raise RuntimeError("no such page")
        for page in requests["page"]:
            (marks / f"{page}-{uuid.uuid4().hex}").touch()
        return pd.DataFrame({"text": requests["page"].map(lambda p: f"page {p}")})

    return reader, lambda: sorted(int(f.name.split("-")[0]) for f in marks.iterdir())


def test_reader_reads_once(spark, tmp_path, counted):
    from paperlake.operators.increments import with_reader

    reader, marks = counted
    path = f"file://{tmp_path}/answers"
    frame = lambda pages: spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "request_id long, page long")
    one = with_reader(frame([1, 2, 2, 1]), ("page",), reader, "text string", path).collect()
    assert sorted((r.request_id, r.text, r.error) for r in one) == [(0, "page 1", None), (1, "page 2", None), (2, "page 2", None), (3, "page 1", None)]
    two = with_reader(frame([2, 3, 13]), ("page",), reader, "text string", path).collect()
    assert sorted((r.page, r.text, r.error) for r in two) == [(2, "page 2", None), (3, "page 3", None), (13, None, "RuntimeError: no such page")]
    assert marks() == [1, 2, 3]
    again = with_reader(frame([1, 2, 3]), ("page",), reader, "text string", path)
    assert again.count() == 3 and marks() == [1, 2, 3]
    assert with_reader(frame([]), ("page",), reader, "text string", path).count() == 0


def test_a_sessions_actions_share_one_state(spark, tmp_path):
    from paperlake.streaming.sessions import rate_limited

    batches = [[(1, 1, "chat", at(0)), (2, 1, "upload", at(0.1)), (3, 1, None, at(0.1))], [(4, 1, "chat", at(0.2)), (5, 1, "upload", at(1.2)), (6, 1, None, at(0.3)), (7, 1, "upload", at(1.3))]]
    rows, left = run(spark, tmp_path, batches, EVENTS, lambda s: rate_limited(s, "1/minute"))
    assert sorted((r.event_id, r.action or "", r.n, r.retry_after) for r in rows) == [(4, "chat", 2, 48), (6, "", 2, 48), (7, "upload", 2, 54)]
    assert left == 1


def test_events_of_a_key_are_ordered_over_its_parts():
    from paperlake.streaming.sessions import _by_time

    parts = [pd.DataFrame({"event_id": [3, 2], "action": ["c", None], "at": [5, 5]}), pd.DataFrame({"event_id": [1, 9], "action": ["a", "d"], "at": [7, 1]})]
    assert list(_by_time(iter(parts), "event_id", "action")) == [(9, "d"), (2, None), (3, "c"), (1, "a")]
