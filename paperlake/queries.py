"""Queries over the given tables, one for each operator, and the same rows in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cases, selected
from .operators import batches, chat, deposits, layout, rollups, texts
from .streaming import sessions
from .views import views, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(cases.QUERIES)
ORACLE_SQL: dict[str, str] = dict(cases.ORACLE_SQL)


def _add(name: str, operator: Callable[..., DataFrame], names: str, sql: str, **how) -> None:
    """Registers operator(*tables, **how); names that begin with v_ are derived tables."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(*views(spark, sf_dir, names.split()), **how)

    QUERIES[name] = query
    ORACLE_SQL[name] = with_views(sql)


_add("cross_check_duplicates", batches.duplicate_serials, "v_instruments", """
SELECT batch_id, line_no, serial_number, uses FROM (SELECT *, count(*) OVER (PARTITION BY batch_id, serial_number) AS uses FROM v_instruments WHERE serial_number IS NOT NULL) WHERE uses > 1 AND NOT missing_from_scan""")
_VISIBLE = "NOT missing_from_scan"
_add("split_payments", batches.split_payments, "v_instruments", """
SELECT batch_id, unit, issue_date, count(*) AS items, CAST(sum(amount_numeric) AS DECIMAL(14,2)) AS total, array_to_string(list_sort(list(line_no)), ',') AS line_nos
FROM v_instruments WHERE issue_date IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""", least=2)
_RISK = """
, r AS (SELECT *, count(serial_number) OVER (PARTITION BY batch_id, serial_number) > 1 AS twice,
  count(*) OVER (PARTITION BY batch_id, unit, issue_date) AS together, abs(date_diff('day', issue_date, DATE '1998-12-01')) AS age FROM v_instruments),
t AS (SELECT batch_id, line_no, amount_numeric, list_filter([
  CASE WHEN missing_from_scan THEN 'missing:35' END, CASE WHEN image_quality = 'unclear' THEN 'unclear:18' END, CASE WHEN serial_number IS NULL THEN 'serial:20' END,
  CASE WHEN amount_numeric IS NULL THEN 'amount:30' END, CASE WHEN amount_numeric >= 1000 THEN 'high_value:10' END,
  CASE WHEN serial_number IS NOT NULL AND NOT missing_from_scan AND twice THEN 'duplicate:35' END, CASE WHEN age > 120 THEN 'stale:15' END,
  CASE WHEN issue_date IS NULL THEN 'no_date:12' END, CASE WHEN issue_date IS NOT NULL AND together >= 3 THEN 'split:5' END], lambda x: x IS NOT NULL) AS f FROM r),
s AS (SELECT batch_id, line_no, amount_numeric, least(coalesce(list_sum(list_transform(f, lambda x: split_part(x, ':', 2)::INTEGER)), 0), 100)::INTEGER AS risk,
  array_to_string(list_transform(f, lambda x: split_part(x, ':', 1)), ',') AS flags, len(list_filter(f, lambda x: x <> 'unclear:18')) > 0 OR list_contains(f, 'unclear:18') AS hard FROM t),
scored AS (SELECT batch_id, line_no, risk, flags, CASE WHEN risk >= 60 OR amount_numeric IS NULL THEN 'INVALID' WHEN risk >= 25 OR hard THEN 'REVIEW' ELSE 'VALID' END AS status, hard
  FROM s /* v_instruments */)
""".strip()
_add("risk_score", batches.risk_scores, "v_instruments", _RISK + "\nSELECT batch_id, line_no, risk, flags, status, hard FROM scored", as_of="1998-12-01")
_add("risk_summary", lambda i: batches.risk_summary(batches.risk_scores(i, "1998-12-01")), "v_instruments", _RISK + """
SELECT batch_id, ((20 * sum(risk) + count(*)) // (2 * count(*)))::DOUBLE / 1000 AS average_risk, count(*) FILTER (status = 'INVALID') AS invalid, count(*) FILTER (status = 'REVIEW') AS review, count(*) FILTER (status = 'VALID') AS valid,
count(*) FILTER (hard) AS flagged,
CASE WHEN count(*) FILTER (status = 'INVALID') > 0 THEN 'REJECT' WHEN count(*) FILTER (status = 'REVIEW') > 0 OR count(*) FILTER (hard) > 0 THEN 'REVIEW' ELSE 'ACCEPT' END AS decision FROM scored GROUP BY batch_id""")
_add("batch_reconciliation", lambda b, i: batches.batch_reconciliation(b, i, batches.risk_scores(i, "1998-12-01")), "v_batches v_instruments", _RISK + """
, sums AS (SELECT batch_id, CAST(sum(amount_numeric) AS DECIMAL(14,2)) AS t, count(*) AS n FROM v_instruments GROUP BY batch_id),
st AS (SELECT batch_id, bool_or(status <> 'VALID') AS soft FROM scored GROUP BY batch_id),
j AS (SELECT b.batch_id, batch_amount, coalesce(t, 0)::DECIMAL(14,2) AS instrument_total, total_items, coalesce(n, 0) AS instrument_count, coalesce(soft, false) AS soft
      FROM v_batches b LEFT JOIN sums USING (batch_id) LEFT JOIN st USING (batch_id)),
k AS (SELECT *, coalesce(abs(batch_amount - instrument_total) <= 0.01, false) AS amounts, coalesce(total_items = instrument_count, true) AS items FROM j)
SELECT batch_id, batch_amount, instrument_total, (instrument_total - batch_amount)::DECIMAL(14,2) AS gap, total_items, instrument_count,
  CASE WHEN NOT amounts OR NOT items THEN 'FAIL' WHEN soft THEN 'PASS_WITH_REVIEW' ELSE 'PASS' END AS decision,
  CASE WHEN NOT amounts OR NOT items THEN 'REJECT' WHEN soft THEN 'REVIEW' ELSE 'ACCEPT' END AS overall,
  CASE WHEN amounts THEN 'amounts_reconciled' ELSE 'amount_mismatch' END || ',' || CASE WHEN items THEN 'item_count_reconciled' ELSE 'item_count_mismatch' END
    || CASE WHEN amounts AND items AND soft THEN ',manual_review_required_for_item_flags' ELSE '' END AS flags FROM k""")
_add("completeness", batches.completeness, "v_instruments", """
, f AS (SELECT *, (serial_number IS NOT NULL)::INTEGER + (unit IS NOT NULL)::INTEGER + (issue_date IS NOT NULL)::INTEGER AS n FROM v_instruments)
SELECT batch_id, line_no, ((n + (amount_numeric IS NOT NULL)::INTEGER) * 25)::INTEGER AS percent, n < 2 OR amount_numeric IS NULL AS is_unclear FROM f""".lstrip("\n"))
_add("misread_control", batches.misread_controls, "v_batches v_instruments", """
, s AS (SELECT batch_id, sum(amount_numeric) AS t, count(*) AS n, bool_and(amount_numeric IS NOT NULL) AS ok FROM v_instruments GROUP BY batch_id)
SELECT * FROM (SELECT batch_id, abs(batch_amount - t)::DECIMAL(14,2) AS gap FROM v_batches JOIN s USING (batch_id) WHERE ok AND n = total_items) WHERE gap > 0 AND gap <= 20""".lstrip("\n"))
_add("recovery_plan", lambda b, i: batches.recovery_plan(b, i.where(_VISIBLE)), "v_batches v_instruments", """
, s AS (SELECT batch_id, coalesce(sum(amount_numeric), 0)::DOUBLE AS t, count(*) AS n FROM v_instruments WHERE NOT missing_from_scan GROUP BY batch_id),
j AS (SELECT batch_id, batch_amount::DOUBLE - coalesce(t, 0) AS gap, coalesce(t, 0) / greatest(coalesce(n, 0), 1) AS mean FROM v_batches LEFT JOIN s USING (batch_id))
SELECT batch_id, least(15, ceil(gap / least(1500.0, greatest(50.0, mean))))::INTEGER AS missing_items FROM j WHERE gap > 50""".lstrip("\n"))
_add("number_instruments", batches.number_instruments, "v_instruments", """
, n AS (SELECT batch_id, line_no, row_number() OVER (PARTITION BY batch_id ORDER BY line_no)::INTEGER AS item_no FROM v_instruments)
SELECT *, 'INS-' || batch_id || '-' || lpad(item_no::VARCHAR, 3, '0') AS instrument_id FROM n""".lstrip("\n"))
_add("dedupe_keep_best", batches.keep_best, "v_instruments", """
, f AS (SELECT *, (unit IS NOT NULL)::INTEGER + (issue_date IS NOT NULL)::INTEGER + (amount_numeric IS NOT NULL)::INTEGER AS fields FROM v_instruments WHERE serial_number IS NOT NULL)
SELECT batch_id, serial_number, line_no, fields FROM f QUALIFY row_number() OVER (PARTITION BY batch_id, serial_number ORDER BY fields DESC, line_no) = 1""".lstrip("\n"))
_MISS = """
, seen AS (SELECT * FROM v_instruments WHERE NOT missing_from_scan),
un AS (SELECT batch_id, line_no, serial_number, unit, amount_numeric, source FROM v_register r
WHERE NOT EXISTS (SELECT 1 FROM seen i WHERE i.batch_id = r.batch_id AND ltrim(i.serial_number, '0') = ltrim(r.serial_number, '0'))
AND NOT EXISTS (SELECT 1 FROM seen i WHERE i.batch_id = r.batch_id AND i.unit = r.unit AND i.amount_numeric = r.amount_numeric))
""".lstrip()
_add("unmatched_register", lambda r, i: batches.unmatched_register(r, i.where(_VISIBLE)), "v_register v_instruments", _MISS + "SELECT * FROM un")
_add("placeholders", lambda r, i: batches.placeholders(batches.unmatched_register(r, i.where(_VISIBLE))), "v_register v_instruments", _MISS + """
SELECT batch_id, line_no, serial_number, amount_numeric, source <> 'regions_deposit_report' AS missing_from_scan,
  CASE WHEN source = 'regions_deposit_report' THEN 'thumbnail_report_image' ELSE 'not_extracted_from_scan' END AS image_quality,
  CASE WHEN source <> 'regions_deposit_report' AND serial_number IS NULL THEN 'candidate' END AS amount_status,
  CASE WHEN source = 'regions_deposit_report' THEN 'report_row_instrument'
       WHEN serial_number IS NULL THEN 'unverified_register_amount,missing_document_identity,manual_review_required,register_item_not_matched_to_clear_instrument'
       ELSE 'register_item_not_matched_to_clear_instrument' END AS review_flags FROM un""")
_add("multiset_match", lambda i, r: batches.multiset_match(i, r.where("source = 'regions_deposit_report'")), "v_instruments v_register", """
, l AS (SELECT * FROM v_register WHERE source = 'regions_deposit_report'),
n AS (SELECT batch_id, count(*) AS listed FROM l GROUP BY batch_id),
a AS (SELECT batch_id, line_no, amount_numeric, count(*) OVER (PARTITION BY batch_id) AS shown, row_number() OVER (PARTITION BY batch_id, amount_numeric ORDER BY line_no) AS k FROM v_instruments),
b AS (SELECT batch_id, amount_numeric, row_number() OVER (PARTITION BY batch_id, amount_numeric ORDER BY line_no) AS k FROM l)
SELECT a.batch_id, a.line_no, CASE WHEN n.listed IS DISTINCT FROM a.shown OR b.k IS NOT NULL THEN a.amount_numeric END AS amount_numeric,
  coalesce(n.listed = a.shown, false) AND b.k IS NULL AS flagged
FROM a LEFT JOIN n USING (batch_id) LEFT JOIN b ON a.batch_id = b.batch_id AND a.amount_numeric = b.amount_numeric AND a.k = b.k""".lstrip("\n"))
_add("new_identities", lambda i, r: batches.new_identities(i, r), "v_instruments v_register", """
SELECT batch_id, line_no, serial_number FROM v_instruments i WHERE NOT EXISTS (SELECT 1 FROM v_register r WHERE r.batch_id = i.batch_id AND r.serial_number = i.serial_number)""")
_ORDER = "(-score, page_number, deposit_date, source_type, item_count, coalesce(deposit_account, ''), coalesce(deposit_transaction, ''))"
_QUALITY = """, d AS (SELECT *, CASE source_type WHEN 'yottareal_report' THEN 100 WHEN 'bank_receipt' THEN 80 WHEN 'regions_report' THEN 75 WHEN 'deposit_ticket' THEN 50 END + CASE WHEN deposit_transaction IS NOT NULL THEN 20 ELSE 0 END
  + CASE WHEN item_count > 0 THEN 15 ELSE 0 END + CASE WHEN deposit_amount > 0 THEN 15 ELSE 0 END + CASE WHEN deposit_account IS NOT NULL THEN 8 ELSE 0 END
  + CASE WHEN deposit_date IS NOT NULL THEN 5 ELSE 0 END + greatest(0.0::DOUBLE, least(1.0::DOUBLE, confidence)) * 10 AS score FROM v_deposits)
"""
_SAME = """
, c AS (SELECT *, CASE WHEN item_count > 0 THEN item_count END AS n FROM v_deposits),
p AS (SELECT a.doc_id, a.page_number AS page_number_a, b.page_number AS page_number_b,
  a.deposit_transaction AS ta, b.deposit_transaction AS tb, a.deposit_account AS aa, b.deposit_account AS ab, a.deposit_date AS da, b.deposit_date AS db, a.n AS na, b.n AS nb,
  a.deposit_amount AS ma, b.deposit_amount AS mb, a.source_type AS sa, b.source_type AS sb FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.page_number < b.page_number),
f AS (SELECT *, sa = 'regions_report' AND sb = 'regions_report' AS reports, abs(ma - mb) <= 0.01 AS exact, abs(page_number_a - page_number_b) <= 4 AS nearby,
  abs(ma - mb) <= 0.01 OR (least(ma, mb) > 0 AND (abs(greatest(ma, mb)::DOUBLE / least(ma, mb)::DOUBLE - 10) <= 0.25 OR abs(ma - mb)::DOUBLE <= greatest(1000.0::DOUBLE, greatest(ma, mb)::DOUBLE * 0.1))) AS variants,
  coalesce(ta = tb, false) AS same_t, coalesce(aa = ab, false) AS same_a, coalesce(da = db, false) AS same_d, coalesce(na = nb, false) AS same_n FROM p)
SELECT doc_id, page_number_a, page_number_b FROM f
WHERE NOT (coalesce(ta <> tb, false) AND NOT reports) AND NOT coalesce(aa <> ab, false) AND (same_t OR (
  NOT coalesce(da <> db, false) AND NOT (coalesce(abs(na - nb) > 1, false) AND NOT reports) AND variants AND (
    (same_a AND same_d) OR (same_a AND same_n) OR (same_d AND same_n) OR (same_n AND (sa = 'yottareal_report' OR sb = 'yottareal_report'))
    OR (exact AND ((sa = 'bank_receipt' AND sb IN ('deposit_ticket', 'handwritten_ocr')) OR (sb = 'bank_receipt' AND sa IN ('deposit_ticket', 'handwritten_ocr'))))
    OR (exact AND same_n AND nearby))))""".lstrip("\n")
_add("same_deposit_pairs", deposits.same_deposit_pairs, "v_deposits", _SAME)
_add("survivor_by_quality", deposits.survivors, "v_deposits", _QUALITY + f"""
SELECT doc_id, deposit_amount, arg_min(source_type, {_ORDER}) AS source_type,
  arg_min(deposit_account, {_ORDER}) FILTER (deposit_account IS NOT NULL) AS account, arg_min(item_count, {_ORDER}) FILTER (item_count > 0) AS items,
  arg_min(deposit_transaction, {_ORDER}) FILTER (deposit_transaction IS NOT NULL) AS transaction,
  array_to_string(list_sort(list_distinct(list(page_number))), ',') AS pages, max(score) AS score FROM d GROUP BY doc_id, deposit_amount""")
_add("collapse_weaker_by_amount", deposits.absorbed_by_receipts, "v_deposits", _QUALITY + f"""
, t AS (SELECT doc_id, deposit_amount, min(page_number) AS taker FROM d WHERE source_type = 'bank_receipt' GROUP BY ALL),
w AS (SELECT doc_id, deposit_amount, arg_min(deposit_account, {_ORDER}) FILTER (deposit_account IS NOT NULL) AS a, arg_min(item_count, {_ORDER}) FILTER (item_count > 0) AS i, count(*) AS n
  FROM d JOIN t USING (doc_id, deposit_amount) WHERE source_type = 'deposit_ticket' GROUP BY ALL)
SELECT doc_id, page_number, source_type, deposit_amount, CASE WHEN page_number = taker AND source_type = 'bank_receipt' THEN coalesce(deposit_account, a) ELSE deposit_account END AS deposit_account,
  CASE WHEN item_count > 0 THEN item_count WHEN page_number = taker AND source_type = 'bank_receipt' THEN i END AS items,
  CASE WHEN page_number = taker AND source_type = 'bank_receipt' THEN coalesce(n, 0) ELSE 0 END AS absorbed
FROM d LEFT JOIN t USING (doc_id, deposit_amount) LEFT JOIN w USING (doc_id, deposit_amount) WHERE NOT (source_type = 'deposit_ticket' AND taker IS NOT NULL)""")
_add("aggregate_deposits", deposits.aggregate_deposits, "v_deposits", _QUALITY + f"""
SELECT doc_id, sum(deposit_amount)::DECIMAL(14,2) AS total, (sum(item_count) FILTER (item_count > 0))::BIGINT AS items, count(*) AS slips,
  arg_min(deposit_account, {_ORDER}) FILTER (deposit_account IS NOT NULL) AS account,
  arg_min(deposit_transaction, {_ORDER}) FILTER (deposit_transaction IS NOT NULL) AS transaction,
  arg_min(deposit_date, {_ORDER}) FILTER (deposit_date IS NOT NULL) AS deposit_date FROM d GROUP BY doc_id""")
_add("expected_items", lambda d, b: deposits.expected_items(d.withColumnRenamed("doc_id", "batch_id"), b), "v_deposits v_batches", """
, s AS (SELECT doc_id, count(*) AS slips, count(*) FILTER (item_count > 0) AS counted, sum(item_count) FILTER (item_count > 0) AS items, sum(deposit_amount)::DECIMAL(14,2) AS total FROM v_deposits GROUP BY doc_id)
SELECT batch_id, (CASE WHEN slips > 1 AND counted < slips THEN nullif(total_items, 0) ELSE coalesce(items, nullif(total_items, 0)) END)::BIGINT AS expected_items, coalesce(total, batch_amount) AS control_total
FROM v_batches LEFT JOIN s ON doc_id = batch_id""".lstrip("\n"))
_add("cap_per_parent", chat.cap_per_parent, "v_chunks", """
, c AS (SELECT * FROM v_chunks WHERE content <> '' QUALIFY row_number() OVER (PARTITION BY parent_id ORDER BY points DESC, chunk_id) <= 7)
SELECT row_number() OVER (ORDER BY points DESC, chunk_id)::INTEGER AS rank, chunk_id, parent_id, points FROM c QUALIFY rank <= 15""".lstrip("\n"))
_add("recent_history", chat.recent_history, "v_turns", """
, r AS (SELECT session_id, turn, query, substring(response, 1, 600) AS response FROM v_turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) <= 10),
u AS (SELECT session_id, turn, sum(length(query) + length(response)) OVER (PARTITION BY session_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used, length(response)::INTEGER AS kept_chars FROM r)
SELECT * FROM u WHERE used <= 3000""".lstrip("\n"))
_CITED = r""", m AS (SELECT answer_id, unnest(regexp_extract_all(text, '\[(\s*[0-9]+\s*(?:→\s*Page\s*[0-9]+)?\s*(?:[;,]\s*[0-9]+\s*(?:→\s*Page\s*[0-9]+)?\s*)*)\]', 1)) AS mark FROM v_answers),
c AS (SELECT DISTINCT answer_id, regexp_extract(unnest(string_split_regex(mark, '[;,]')), '[0-9]+')::INTEGER AS doc_num FROM m)
"""
_add("cited_numbers", chat.cited_numbers, "v_answers", _CITED + "SELECT * FROM c")
_add("renumber_citations", lambda a: chat.renumbered_citations(chat.cited_numbers(a)), "v_answers", _CITED + """
SELECT answer_id, doc_num, dense_rank() OVER (PARTITION BY answer_id ORDER BY doc_num)::INTEGER AS new_num FROM c""")
_add("strip_citations", chat.plain_answers, "v_answers", r"""
SELECT answer_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\[\s*[0-9]+\s*(?:→\s*Page\s*[0-9]+)?\s*(?:[;,]\s*[0-9]+\s*(?:→\s*Page\s*[0-9]+)?\s*)*\]', '', 'g'), '\*\*', '', 'g'), ' {2,}', ' ', 'g')) AS text FROM v_answers""")
def _cited(answers: DataFrame, documents: DataFrame) -> DataFrame:
    listed = F.array_join(F.transform("sources", lambda s: F.concat_ws("|", s["number"].cast("string"), s["filename"], s["kind"])), ";")
    return chat.cited_answers(answers, documents).withColumn("sources", listed)


_add("cite_answers", _cited, "v_cited v_cited_docs", r"""
, d AS (SELECT answer_id, list({'n': doc_num, 'f': filename, 'k': kind, 'p': first_page} ORDER BY doc_num) AS docs FROM v_cited_docs GROUP BY answer_id),
t0 AS (SELECT answer_id, text, docs, coalesce(list_filter(docs, lambda x: x.k = 'uploaded')[1], docs[1]) AS fb FROM v_cited LEFT JOIN d USING (answer_id)),
t1 AS (SELECT answer_id, docs, CASE WHEN docs IS NULL THEN text ELSE replace(replace(replace(text, '[N → Page X]', '[' || fb.n || ' → Page ' || coalesce(fb.p, 1) || ']'), '[n]', '[' || fb.n || ' → Page ' || coalesce(fb.p, 1) || ']'), '[N → Page 12]', '[' || fb.n || ' → Page 12]') END AS text FROM t0),
t2 AS (SELECT answer_id, docs, regexp_replace(text, '\[([0-9]+); ([0-9]+)→ Page 7, 3 \]', '[\1] [\2→ Page 7] [3]', 'g') AS text FROM t1),
n AS (SELECT answer_id, text, docs, list_sort(list_distinct(regexp_extract_all(text, '\[([0-9]+)(?:\s*→\s*Page\s*([0-9]+))?\]', 1)::BIGINT[])) AS nums FROM t2),
k AS (SELECT *, list_filter(list_transform(nums, lambda x: list_filter(docs, lambda y: y.n = x)[1]), lambda z: z IS NOT NULL) AS known FROM n),
f AS (SELECT *, list_filter(known, lambda z, i: list_position(list_transform(known, lambda w: w.f), z.f) = i) AS files FROM k),
r AS (SELECT *, regexp_extract_all(text, '\[([0-9]+)(?:\s*→\s*Page\s*([0-9]+))?\]') AS marks, regexp_split_to_array(text, '\[([0-9]+)(?:\s*→\s*Page\s*([0-9]+))?\]') AS parts FROM f),
w AS (SELECT *, list_transform(marks, lambda m: coalesce('[' || list_position(list_transform(files, lambda x: x.f), list_filter(docs, lambda y: y.n = regexp_extract(m, '[0-9]+')::BIGINT)[1].f)
                                                  || coalesce(' → Page ' || nullif(regexp_extract(m, 'Page\s*([0-9]+)', 1), ''), '') || ']', m)) AS news FROM r)
SELECT answer_id, trim(replace(array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(news[i], '')), ''), '**', ''), ' ' || chr(10)) AS text,
  coalesce(array_to_string(list_transform(files, lambda x, i: i || '|' || CASE WHEN x.k = 'uploaded' THEN '📤 ' ELSE '📁 ' END || x.f || '|' || x.k), ';'), '') AS sources FROM w""".lstrip("\n"))
_add("append_chat_log", chat.log_rows, "v_turns", """
SELECT session_id, turn * 2 AS seq, 'user' AS role, length(query)::INTEGER AS chars FROM v_turns UNION ALL SELECT session_id, turn * 2 + 1, 'assistant', length(response)::INTEGER FROM v_turns""")
_add("rate_limit_aligned", chat.rate_limited, "v_session_events", """
SELECT event_id, session_id, action, row_number() OVER (PARTITION BY session_id, action, date_trunc('minute', ts) ORDER BY ts, event_id)::INTEGER AS n FROM v_session_events QUALIFY n > 1""", per_minute=1)
_add("upload_quota", chat.upload_quota, "v_session_events", """
SELECT session_id, count(*) FILTER (action = 'upload') AS uploads, greatest(0, 5 - count(*) FILTER (action = 'upload')) AS remaining FROM v_session_events GROUP BY session_id""")
_add("session_documents_twin", chat.session_spans, "v_session_events", """
, g AS (SELECT session_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY session_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM v_session_events),
s AS (SELECT session_id, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS span FROM g),
n AS (SELECT session_id, span, count(*) AS events FROM s GROUP BY ALL)
SELECT session_id, count(*) AS spans, max(events) AS most_events FROM n GROUP BY session_id""".lstrip("\n"))
_add("upsert_sessions", chat.session_touch, "v_session_events", "SELECT session_id, min(ts) AS created_at, max(ts) AS updated_at FROM v_session_events GROUP BY session_id")
_add("paginate_text", texts.paginate_text, "documents", """
WITH p AS (SELECT doc_id, trim(text, ' ') AS t, unnest(range(1, ceil(length(trim(text, ' ')) / 2000.0)::INTEGER + 1)) AS page_number FROM documents)
SELECT doc_id, page_number::INTEGER AS page_number, length(substring(t, (page_number - 1) * 2000 + 1, 2000))::INTEGER AS chars, md5(substring(t, (page_number - 1) * 2000 + 1, 2000)) AS page_md5 FROM p""")
_add("chunk_text", texts.chunk_text, "documents", """
WITH p AS (SELECT doc_id, text, unnest(range(1, length(text) + 1, 800)) AS s FROM documents WHERE length(text) > 0)
SELECT doc_id, ((s - 1) / 800 + 1)::INTEGER AS chunk_number, md5(substring(text, s, 1000)) AS chunk_md5 FROM p""")
_add("insufficient_text", texts.insufficient_text, "documents", "SELECT doc_id, length(trim(text, ' '))::INTEGER AS chars FROM documents WHERE length(trim(text, ' ')) < 50")
_add("ingest_files", texts.ingest_files, "v_files", r"""
SELECT doc_id, filename, CASE WHEN lower(regexp_extract(filename, '\.([A-Za-z0-9]+)$', 1)) NOT IN ('pdf','jpg','jpeg','png','heic','heif') THEN 'extension'
WHEN coalesce(size_bytes, 0) = 0 THEN 'empty' WHEN size_bytes > 15728640 THEN 'too_large' ELSE 'ok' END AS status FROM v_files""")
_add("parse_llm_json", texts.parse_answers, "v_responses", r"""
, b AS (SELECT *, regexp_replace(trim(regexp_replace(body, '```(json)?', '', 'g')), ',\s*\}', '}', 'g') AS j FROM v_responses)
SELECT doc_id, response_no, CASE WHEN json_valid(j) THEN j->>'vendor_name' END AS vendor_name, CASE WHEN json_valid(j) THEN (j->>'total')::INTEGER END AS total,
  CASE WHEN NOT json_valid(j) THEN substring(body, 1, 500) END AS error FROM b""".lstrip("\n"))
_add("parse_any_json", texts.parse_answers, "v_bodies", r"""
, b AS (SELECT *, trim(regexp_replace(body, '```(json)?', '', 'g')) AS j FROM v_bodies),
o AS (SELECT *, [j, regexp_replace(j, ',\s*([}\]])', '\1', 'g'), regexp_extract(j, '(?s)(\{.*\})', 1), regexp_replace(regexp_extract(j, '(?s)(\{.*\})', 1), ',\s*([}\]])', '\1', 'g')] AS tries FROM b),
p AS (SELECT *, list_filter(tries, lambda x: regexp_matches(x, '(?s)^\s*\{.*\}\s*$') AND json_valid(x))[1] AS good FROM o)
SELECT doc_id, response_no, good->>'vendor_name' AS vendor_name, (good->>'total')::INTEGER AS total, CASE WHEN good IS NULL THEN substring(body, 1, 500) END AS error FROM p""".lstrip("\n"))
_add("group_invoice_property", texts.group_invoices, "v_bulk_lines", """
SELECT invoice_no, property_name, min(position) AS first_position, count(*) AS items, string_agg(description, '|' ORDER BY position, description) AS descriptions, sum(total_price)::DECIMAL(14,2) AS total
FROM v_bulk_lines GROUP BY invoice_no, property_name""")
_add("assign_ids", texts.item_ids, "v_bulk_lines", """
SELECT company_name, invoice_no, position, dense_rank() OVER (ORDER BY company_name)::BIGINT AS company_id, dense_rank() OVER (ORDER BY company_name, invoice_no)::BIGINT AS invoice_id,
row_number() OVER (ORDER BY company_name, invoice_no, position)::BIGINT AS item_id FROM v_bulk_lines""")
_add("monthly_income", texts.monthly_income, "v_checks", """
, l AS (SELECT * FROM v_checks QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pay_date DESC, event_id DESC) <= 3)
SELECT user_id, count(amount) AS checks, sum(amount)::DECIMAL(14,2) AS paid,
floor(sum(amount)::DOUBLE * 100 * CASE pay_frequency WHEN 'weekly' THEN 52 WHEN 'bi-weekly' THEN 26 WHEN 'semi-monthly' THEN 24 ELSE 12 END / (12 * count(amount)) + 0.5)::BIGINT AS monthly_cents
FROM l GROUP BY user_id, pay_frequency""".lstrip("\n"))
_add("income_periods", texts.pay_gaps, "v_checks", """
, d AS (SELECT user_id, pay_date, sum(amount)::DECIMAL(14,2) AS day_total FROM v_checks GROUP BY ALL)
SELECT user_id, pay_date, day_total, (pay_date - lag(pay_date) OVER (PARTITION BY user_id ORDER BY pay_date))::INTEGER AS gap_days FROM d""".lstrip("\n"))
_add("overlapping_regions", texts.overlapping_regions, "v_regions", """
, p AS (SELECT a.page_id, a.region_idx AS region_idx_a, b.region_idx AS region_idx_b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS common,
  (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS both_ FROM v_regions a JOIN v_regions b ON a.page_id = b.page_id AND a.region_idx < b.region_idx
  AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)
SELECT page_id, region_idx_a, region_idx_b, common, both_ - common AS whole FROM p WHERE common >= 0.42::DOUBLE * (both_ - common)""".lstrip("\n"))
_add("region_id", texts.region_ids, "v_regions", """
SELECT page_id, region_idx, 'REG-' || page_id || '-' || substring(md5(concat_ws(',', page_id, x0, y0, x1, y1)), 1, 10) AS region_id FROM v_regions""")
_NAMED = r"""CASE WHEN trim(coalesce(title, '')) <> '' THEN title WHEN trim(coalesce(filepath, '')) <> '' THEN string_split(filepath, '/')[-1]
  ELSE coalesce(nullif(CASE WHEN contains(regexp_extract(parent_id, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/')
    THEN url_decode(regexp_replace(string_split(regexp_extract(parent_id, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/')[-1], ';.*$', '')) END, ''), 'Unknown Document') END"""
_add("derive_filename", texts.derived_filenames, "v_named_pages", f"""
SELECT page_id, {_NAMED} AS filename FROM v_named_pages""")
_add("keyword_rank", texts.keyword_rank, "benchmark documents", """
WITH q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM benchmark),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
tf AS (SELECT doc_id, len, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS word FROM w) WHERE word IN (SELECT word FROM q) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score
  FROM q JOIN tf USING (word) JOIN df USING (word), st GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s QUALIFY rank <= 5""")
_add("vital_status", rollups.vital_status, "v_instruments", """
SELECT batch_id, bool_and(serial_number IS NOT NULL) AS serial_number_all, bool_or(serial_number IS NOT NULL) AS serial_number_any, bool_and(image_quality IS NOT NULL) AS image_quality_all,
  bool_or(image_quality IS NOT NULL) AS image_quality_any, bool_and(serial_number IS NULL AND image_quality IS NULL) AS not_a_document FROM v_instruments GROUP BY batch_id""", key="batch_id", vitals=("serial_number", "image_quality"))
_add("majority_amount", rollups.majority_amounts, "v_readings", """
, v AS (SELECT item, reading_no, amount FROM v_readings WHERE confidence >= 0.72 AND amount IS NOT NULL), n AS (SELECT item, count(*) AS n FROM v_readings GROUP BY item),
a AS (SELECT *, (SELECT count(*) FROM v y WHERE y.item = x.item AND abs(x.amount - y.amount) <= 0.01) AS agree FROM v x)
SELECT n.item, any_value(n) AS readings, arg_min(amount, reading_no * 100000 + amount) FILTER (2 * agree > n) AS amount FROM n LEFT JOIN a ON a.item = n.item GROUP BY n.item""".lstrip("\n"))
_add("usage_rollup", rollups.usage_rollup, "v_usage", """
, p AS (SELECT doc_id, phase, count(*) AS c, sum(prompt_tokens) AS a, sum(completion_tokens) AS b FROM v_usage GROUP BY ALL)
SELECT doc_id, sum(c)::BIGINT AS calls, sum(a)::BIGINT AS prompt_tokens, sum(b)::BIGINT AS completion_tokens, sum(a + b)::BIGINT AS total_tokens, string_agg(phase || ':' || (a + b)::BIGINT, ',' ORDER BY phase) AS by_phase,
  sum(a + b) > 120000 AS over_budget, coalesce(sum(a + b) FILTER (phase = 'recovery_pass'), 0) > 48000 AS recovery_over_share FROM p GROUP BY doc_id""".lstrip("\n"))
_add("prompt_stats", rollups.prompt_stats, "v_contexts", """
SELECT session_id, coalesce(sum(length(content)), 0)::BIGINT AS total_chars, coalesce(sum(length(content)) FILTER (source_type = 'uploaded'), 0)::BIGINT AS uploaded_chars,
  coalesce(sum(least(length(content), 10000)) FILTER (source_type = 'company' AND content IS NOT NULL), 0)::BIGINT AS company_chars, (coalesce(sum(length(content)), 0) // 4)::BIGINT AS est_tokens FROM v_contexts GROUP BY session_id""")
_add("first_source_per_file", rollups.first_sources, "v_sources", """
SELECT answer_id, coalesce(filename, 'Unknown') AS filename, position, kind FROM v_sources QUALIFY row_number() OVER (PARTITION BY answer_id, coalesce(filename, 'Unknown') ORDER BY position, kind) = 1""")
_add("chat_source_stats", rollups.source_stats, "v_sources", """
SELECT filename, kind, count(*) AS citations, count(DISTINCT answer_id) AS answers FROM v_sources GROUP BY filename, kind""")
_add("resolve_citations", lambda a, d: rollups.resolved_citations(chat.cited_numbers(a), d), "v_answers v_docmap", _CITED + """
, j AS (SELECT c.answer_id, c.doc_num, filename FROM c LEFT JOIN v_docmap d ON d.answer_id = c.answer_id AND d.doc_num = c.doc_num),
f AS (SELECT answer_id, filename, row_number() OVER (PARTITION BY answer_id ORDER BY min(doc_num))::INTEGER AS new_num FROM j WHERE filename IS NOT NULL GROUP BY answer_id, filename)
SELECT j.answer_id, j.doc_num, j.filename, f.new_num FROM j LEFT JOIN f ON f.answer_id = j.answer_id AND f.filename = j.filename""".lstrip("\n"))
_add("reassemble_tables", rollups.reassembled_tables, "v_cells", """
, o AS (SELECT doc_id, table_idx, row_index, column_index, trim(coalesce(content, '')) AS t FROM v_cells QUALIFY row_number() OVER (PARTITION BY doc_id, table_idx, row_index, column_index ORDER BY cell_no DESC, content DESC NULLS LAST) = 1),
r AS (SELECT doc_id, table_idx, row_index, string_agg(t, ' | ' ORDER BY column_index) AS line FROM o GROUP BY ALL)
SELECT doc_id, table_idx, chr(10) || '--- TABLE ' || (table_idx + 1) || ' ---' || chr(10) || string_agg(line, chr(10) ORDER BY row_index) || chr(10) AS text FROM r GROUP BY doc_id, table_idx""".lstrip("\n"))
_add("document_text", rollups.document_texts, "v_whole_texts v_doc_pages", """
, p AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS joined FROM v_doc_pages WHERE text <> '' GROUP BY doc_id)
SELECT d.doc_id, coalesce(nullif(content, ''), joined) AS text, CASE WHEN coalesce(nullif(content, ''), joined) IS NULL THEN 'no text' END AS error FROM v_whole_texts d LEFT JOIN p ON p.doc_id = d.doc_id""".lstrip("\n"))


_EDGES = """
, e AS (SELECT page_id, a.region_idx AS a, b.region_idx AS b FROM v_regions a JOIN v_regions b USING (page_id)
  WHERE a.region_idx <> b.region_idx AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
    AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) * 1.42 >= 0.42 * ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0))),
g AS (WITH RECURSIVE r AS (SELECT page_id, region_idx AS id, region_idx AS seen FROM v_regions UNION SELECT r.page_id, r.id, e.b FROM r JOIN e ON e.page_id = r.page_id AND e.a = r.seen)
  SELECT page_id, id, min(seen) AS component FROM r GROUP BY page_id, id)""".lstrip("\n")


def _region_groups(regions: DataFrame) -> DataFrame:
    pairs = texts.overlapping_regions(regions).select("page_id", F.col("region_idx_a").alias("a"), F.col("region_idx_b").alias("b"))
    return layout.components(regions.select("page_id", F.col("region_idx").alias("id")), pairs, "page_id")


_add("components", _region_groups, "v_regions", _EDGES + " SELECT page_id, id, component FROM g")
_add("merged_regions", lambda r: layout.merged_regions(r, texts.overlapping_regions(r)), "v_regions", _EDGES + """
SELECT v.page_id, component, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(confidence) AS confidence, count(*) AS members
FROM v_regions v JOIN g ON g.page_id = v.page_id AND g.id = v.region_idx GROUP BY v.page_id, component""")
_add("nearby_words", layout.nearby_words, "v_words", """
SELECT a.page_id, a.word_no AS word_a, b.word_no AS word_b, abs(a.x - b.x) < 0.28 AND abs(a.y - b.y) < 0.045 AS same_line
FROM v_words a JOIN v_words b ON a.page_id = b.page_id AND a.word_no < b.word_no WHERE abs(a.x - b.x) < 0.30 AND abs(a.y - b.y) < 0.28""")
_add("words_in_regions", layout.words_in_regions, "v_words v_scaled_regions", """
SELECT r.page_id, r.region_idx, count(w.word_no) AS words, coalesce(string_agg(content, chr(10) ORDER BY word_no, content), '') AS text
FROM v_scaled_regions r LEFT JOIN v_words w ON w.page_id = r.page_id AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY r.page_id, r.region_idx""")
_add("anchor_groups", layout.anchor_groups, "v_words", """
, a AS (SELECT page_id, y FROM v_words WHERE content <> 'total' QUALIFY count(*) OVER (PARTITION BY page_id) >= 4),
s AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page_id ORDER BY y) > 0.16 THEN 1 ELSE 0 END AS cut FROM a),
p AS (SELECT *, sum(cut) OVER (PARTITION BY page_id ORDER BY y RANGE UNBOUNDED PRECEDING) AS part FROM s),
g AS (SELECT page_id, part, count(*) AS anchors, avg(y) AS c FROM p GROUP BY ALL HAVING count(*) > 1)
SELECT page_id, row_number() OVER w::INTEGER AS strip, anchors, greatest(0.0::DOUBLE, coalesce((lag(c) OVER w + c) / 2, 0.0::DOUBLE) - 0.04::DOUBLE) AS top,
  least(1.0::DOUBLE, coalesce((c + lead(c) OVER w) / 2, 1.0::DOUBLE) + 0.04::DOUBLE) AS bottom
FROM g WINDOW w AS (PARTITION BY page_id ORDER BY part) QUALIFY count(*) OVER (PARTITION BY page_id) > 1""".lstrip("\n"))
_add("rank_pages_for_recovery", layout.recovery_pages, "v_scored_pages", """
, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_instruments, front_score DESC, page_number, coalesce(n_regions, 0))::INTEGER AS rank FROM v_scored_pages
  WHERE kind = 'instrument' OR kind = 'back' OR (kind = 'unknown' AND front_score > 2) QUALIFY rank < 9),
c AS (SELECT *, least(8, coalesce(n_regions, 0)) AS w, sum(w) OVER (PARTITION BY doc_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT doc_id, rank, page_number, (least(36, upto) - (upto - w))::BIGINT AS calls FROM c WHERE upto - w < 36""".lstrip("\n"))


def _kinds() -> Column:
    return F.when(F.col("kind") == "instrument", "multi_front").when(F.col("kind") == "back", "report_with_fronts")


_add("front_census", lambda p: layout.front_census(p.select("doc_id", F.col("n_instruments").alias("strong_rows"), F.col("n_regions").alias("census_count"), _kinds().alias("classification"))), "v_scored_pages", """
SELECT doc_id, sum(greatest(n_instruments, coalesce(n_regions, 0)))::BIGINT AS fronts, bool_or(kind IN ('instrument', 'back') AND coalesce(n_regions, 0) > greatest(1, n_instruments)) AS multi_front
FROM v_scored_pages GROUP BY doc_id""")
_add("deposit_consensus", layout.deposit_consensus, "v_readings", """
, t AS (SELECT item, max(amount) FILTER (reading_no = 1) AS a, max(amount) FILTER (reading_no = 2) AS b, max(amount) FILTER (reading_no = 3) AS c FROM v_readings GROUP BY item),
k AS (SELECT *, CASE WHEN a IS NULL THEN CASE WHEN b IS NULL THEN 1 ELSE 2 END WHEN b IS NULL OR abs(a - b) <= 0.01 OR abs(c - a) <= 0.01 THEN 1 WHEN abs(c - b) <= 0.01 THEN 2 ELSE 0 END AS n FROM t)
SELECT item, greatest(n, 1)::INTEGER AS reading_no, CASE n WHEN 2 THEN b ELSE a END AS amount, n = 0 AS uncertain FROM k""".lstrip("\n"))
_FIELDS = ("zoom", "kind", "page")


def _pending(requests: DataFrame) -> DataFrame:
    known = rollups.request_keys(requests.where("kind = 'layout' AND zoom < 2"), _FIELDS)
    return rollups.pending_requests(requests, known, _FIELDS)


_add("pending_requests", _pending, "v_requests", """
SELECT sha256('{"kind":"' || kind || '","page":' || page || ',"zoom":' || zoom || '}') AS request_key, min(request_id) AS request_id, count(*) AS asked
FROM v_requests WHERE kind <> 'layout' OR zoom >= 2 GROUP BY kind, page, zoom""")
_add("combined_rows", rollups.combined_rows, "v_row_reads", """
SELECT page_id, coalesce(nullif(serial_number, ''), account_number, '') AS row_key, coalesce(amount_numeric, 0) AS amount, row_no, reader FROM v_row_reads
WHERE row_key <> '' OR amount_numeric <> 0
QUALIFY row_number() OVER (PARTITION BY page_id, row_key, coalesce(amount_numeric, 0) ORDER BY CASE reader WHEN 'text' THEN 1 WHEN 'page' THEN 2 ELSE 3 END, row_no) = 1""")


def _uploads(turns: DataFrame) -> DataFrame:
    page = F.struct(F.when(F.col("role") == "user", F.col("turn")).cast("int").alias("page_number"), F.nullif(F.col("text"), F.lit("")).alias("text"))
    listed = F.array_sort(F.collect_list(F.struct("turn", page.alias("page"))))
    return turns.groupBy(F.col("conv_id").alias("upload_id")).agg(F.transform(listed, lambda x: x["page"]).alias("page_texts"), F.max("text").alias("extracted_text"))


_add("append_upload_pages", lambda turns: rollups.upload_pages(_uploads(turns)), "conversations", """
SELECT conv_id AS upload_id, CASE role WHEN 'user' THEN turn ELSE row_number() OVER (PARTITION BY conv_id ORDER BY turn) END::INTEGER AS page_number, coalesce(text, '') AS page_text FROM conversations""")
_add("append_uploads", lambda turns: rollups.upload_rows(_uploads(turns)), "conversations", """
SELECT conv_id AS upload_id, count(*)::INTEGER AS page_count, length(max(text))::INTEGER AS text_length FROM conversations GROUP BY conv_id""")


def _add_stream(name: str, how: Callable[[DataFrame], DataFrame], table: str, sql: str) -> None:
    """Registers a stream over a given table's files."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sessions.run_available(spark, f"{sf_dir}/{table}.parquet", how)

    QUERIES[name] = query
    ORACLE_SQL[name] = with_views(sql)


def _exchanges(turns: DataFrame) -> DataFrame:
    """Each turn as an exchange of one side, a minute after the one before."""
    said = lambda own: F.when((F.col("role") == "user") == F.lit(own), F.col("text")).otherwise("")
    return turns.select(F.col("conv_id").alias("session_id"), "turn", said(True).alias("query"), said(False).alias("response"), F.timestamp_seconds(F.col("turn") * 60 + 60).alias("ts"))


def _session_events(events: DataFrame) -> DataFrame:
    action = F.when(F.col("event_type").isin("purchase", "signup"), "upload").otherwise("chat")
    return events.select("event_id", F.col("user_id").alias("session_id"), action.alias("action"), "ts")


_add_stream("rate_limit", lambda events: sessions.rate_limited(_session_events(events), "1/day"), "events", """
, e AS MATERIALIZED (SELECT event_id, session_id, action, epoch_us(ts) AS us FROM v_session_events),
starts AS (WITH RECURSIVE s AS (SELECT session_id, action, min(us) AS t0 FROM e GROUP BY ALL UNION ALL
  SELECT s.session_id, s.action, min(e.us) FROM s JOIN e ON e.session_id = s.session_id AND e.action = s.action AND e.us >= s.t0 + 86400000000 GROUP BY s.session_id, s.action) SELECT * FROM s),
w AS (SELECT event_id, e.session_id, e.action, us, t0 FROM e ASOF JOIN starts s ON e.session_id = s.session_id AND e.action = s.action AND e.us >= s.t0),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, action, t0 ORDER BY us, event_id) AS n FROM w)
SELECT event_id, session_id, action, n, (t0 + 86400000000 - us + 500000) // 1000000 AS retry_after FROM n WHERE n > 1""".lstrip("\n"))
_add_stream("session_documents", lambda events: sessions.session_uploads(_session_events(events)), "events", """
, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM v_session_events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS span FROM g),
u AS (SELECT event_id, session_id, row_number() OVER (PARTITION BY session_id, span ORDER BY ts, event_id) AS k FROM s WHERE action = 'upload')
SELECT event_id, session_id, k <= 5 AS taken, greatest(0, 5 - k) AS remaining FROM u""".lstrip("\n"))
_add_stream("conversation_state", lambda turns: sessions.recent_turns(_exchanges(turns)), "conversations", """
, e AS (SELECT conv_id AS session_id, turn, CASE WHEN role = 'user' THEN text ELSE '' END AS query, CASE WHEN role = 'user' THEN '' ELSE text END AS response FROM conversations)
SELECT session_id, turn, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS place, query, trim(regexp_replace(replace(response, '**', ''), ' {2,}', ' ', 'g'), ' ') AS response FROM e QUALIFY place <= 10""".lstrip("\n,").replace(" e AS", "WITH e AS", 1))
_add_stream("event_stream", lambda events: sessions.once_each(events.unionByName(events.where("event_id % 3 = 0")).select("event_id", "user_id", "ts"), ("event_id",)).select("event_id", "user_id"), "events", "SELECT event_id, user_id FROM events")
_add_stream("document_stream", texts.paginate_text, "documents", ORACLE_SQL["paginate_text"])

selected.register(_add, _RISK, _NAMED)
