"""Every query against its SQL in DuckDB, and a few operators on literal rows."""

import os

import duckdb
import pytest

from paperlake.queries import ORACLE_SQL, QUERIES
from paperlake.views import TABLES, with_views


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(tables, t)}.parquet')")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(float(r[i]) if isinstance(r[i], float) else str(r[i]) for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, tables, name):
    got = QUERIES[name](spark, tables)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    found = [tuple(r) for r in got.collect()]
    want = rows(want.fetchall(), columns)
    assert rows(found, got.columns) == want
    assert want or name in {"cross_check_duplicates", "cap_per_parent", "rate_limit_aligned"}


def test_unmatched_register_reads_every_visible_line(spark, duck, tables):
    """Register rows whose instrument is on an even line aren't missing."""
    seen, listed = (duck.execute(with_views(f"SELECT * FROM {v}")).to_arrow_table().to_pylist() for v in ("v_instruments", "v_register"))
    seen = [i for i in seen if not i["missing_from_scan"]]
    serials = {(i["batch_id"], i["serial_number"]) for i in seen if i["serial_number"]}
    units = {(i["batch_id"], i["unit"], i["amount_numeric"]) for i in seen}
    lacking = [r for r in listed if (r["batch_id"], r["serial_number"]) not in serials and (r["batch_id"], r["unit"], r["amount_numeric"]) not in units]
    want = sorted((r["batch_id"], r["line_no"]) for r in lacking)
    assert want and any(line % 2 == 0 for _, line in want)
    for name in ("unmatched_register", "placeholders"):
        assert sorted((r.batch_id, r.line_no) for r in QUERIES[name](spark, tables).collect()) == want


def test_answers_are_read_to_their_end(spark, tmp_path):
    text = "a" * 200 + " [17]  **late** words"
    spark.createDataFrame([(1, 1, "assistant", text), (1, 0, "user", "[18]")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {(r.answer_id, r.doc_num) for r in QUERIES["cited_numbers"](spark, str(tmp_path)).collect()} == {(101, n) for n in (2, 3, 17)}
    assert {(r.doc_num, r.new_num) for r in QUERIES["renumber_citations"](spark, str(tmp_path)).collect()} == {(2, 1), (3, 2), (17, 3)}
    assert [r.text for r in QUERIES["strip_citations"](spark, str(tmp_path)).collect()] == ["a" * 200 + " late words and x"]


def test_pages_have_no_limit(spark, tmp_path):
    from paperlake.operators.texts import paginate_text

    spark.createDataFrame([(1, "x" * 41_000), (2, "y")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.page_number, r.chars) for r in QUERIES["paginate_text"](spark, str(tmp_path)).collect())
    assert got == [(1, i, 2000) for i in range(1, 21)] + [(1, 21, 1000), (2, 1, 1)]
    assert paginate_text(spark.read.parquet(f"{tmp_path}/documents.parquet"), most=15).count() == 16


def test_streams_keep_state_over_batches(spark, tmp_path):
    """Events in two files, one a batch: windows and uploads go on where the batch before ended."""
    import datetime as dt

    from paperlake.streaming.sessions import parse_limit, rate_limited, session_uploads

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "event_id long, session_id long, action string, ts timestamp_ntz"
    for i, seconds in enumerate([(0, 10, 20), (59, 60, 61, 7300)]):
        rows = [(100 * i + k, 1, "upload", at(s)) for k, s in enumerate(seconds)] + [(900 + i, None, "chat", at(1))]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/events/batch={i}")
    for name, how in (("limit", lambda e: rate_limited(e, "2/minute")), ("uploads", lambda e: session_uploads(e, 2))):
        for _ in range(2):  # the second time there is nothing new
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/events")
            out = how(stream).writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-progress")
            out.trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.event_id, r.n, r.retry_after) for r in spark.read.parquet(f"{tmp_path}/limit").collect()) == [(2, 3, 40), (100, 4, 1)]
    got = sorted((r.event_id, r.taken, r.remaining) for r in spark.read.parquet(f"{tmp_path}/uploads").collect())
    assert got == [(0, True, 1), (1, True, 0), (2, False, 0), (100, False, 0), (101, False, 0), (102, False, 0), (103, True, 1)]
    assert parse_limit(" 20/minutes") == (20, 60)
    for wrong in ("0/minute", "x/minute", "5", "5/year"):
        with pytest.raises(ValueError):
            parse_limit(wrong)
