"""Queries of choosing, matching and merging evidence, and the same rows in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import boxes, deposits, increments, rollups, search, selection, similar, texts
from .tables import shared_folder

#: What was seen and listed, told apart and measured, in SQL; the derived serials and payees are clean, so nothing has to be mended.
_TOLD = """
, cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, coalesce(source, ''), page_number, coalesce(serial_number, ''), amount_numeric, coalesce(unit, ''), item_no ORDER BY row_no) AS nth
                          FROM (SELECT * FROM v_seen UNION ALL SELECT * FROM v_listed)) WHERE nth = 1),
marked AS (
  SELECT c.* EXCLUDE (nth), c.source NOT IN ('regions_deposit_report', 'transaction_detail_report', 'vision_register_items', 'yottareal_batch_detail') AND NOT coalesce(missing_from_scan, false)
           AND coalesce(page_number BETWEEN 1 AND total_pages, false) AND amount_numeric IS NOT NULL
           AND (serial_number IS NOT NULL OR micr_line IS NOT NULL OR payee_raw IS NOT NULL OR amount_words IS NOT NULL OR issue_date IS NOT NULL) AS strong
  FROM cand c JOIN v_controls USING (batch_id) WHERE NOT coalesce(page_number > total_pages, false)),
graded AS MATERIALIZED (
  SELECT *, CASE WHEN strong THEN 50 ELSE 0 END + CASE WHEN serial_number IS NOT NULL THEN 12 ELSE 0 END + CASE WHEN micr_line IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN amount_words IS NOT NULL THEN 10 ELSE 0 END
            + CASE WHEN payee_raw IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN issue_date IS NOT NULL THEN 5 ELSE 0 END - CASE WHEN image_quality = 'unclear' THEN 5 ELSE 0 END AS quality,
         list_filter([ltrim(serial_number, '0'), ltrim(micr_line, '0'), right(ltrim(serial_number, '0'), 10), right(ltrim(micr_line, '0'), 10), 'u' || unit || '|' || amount_numeric::DECIMAL(14,2)::VARCHAR], lambda x: x IS NOT NULL) AS keys
  FROM marked)"""
#: Every subset of a batch's rows as a bit mask; of equal qualities the smallest mask is the choice whose last row comes first.
_SUBSETS = """
masks AS (SELECT batch_id, n, unnest(range(1, 1 << n)) AS mask FROM (SELECT batch_id, count(*) AS n FROM {rows} GROUP BY batch_id)),
sums AS MATERIALIZED (SELECT m.batch_id, mask, bit_count(mask) AS k, sum(amount) AS t, sum(quality) AS q FROM masks m JOIN {rows} r ON r.batch_id = m.batch_id AND (mask >> (place - 1)) & 1 = 1 GROUP BY ALL),
best AS (SELECT s.batch_id, max_by(mask, (k, q, -mask)) AS mask FROM sums s JOIN {asked} a ON a.batch_id = s.batch_id AND s.t = a.total AND k BETWEEN least AND wanted GROUP BY s.batch_id)"""
_SELECTED = _TOLD + """,
visible AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY page_number, -quality, row_no) AS vplace FROM graded WHERE strong),
reg AS MATERIALIZED (SELECT *, coalesce(report_page, slip_page) AS gp, row_no AS rn FROM graded WHERE NOT strong AND source IN ('regions_deposit_report', 'transaction_detail_report', 'yottareal_batch_detail') AND amount_numeric IS NOT NULL),
groups_ AS (SELECT r.batch_id, source, gp, count(*) AS n, sum(amount_numeric) AS t, count(*) FILTER (serial_number IS NOT NULL OR micr_line IS NOT NULL) AS known, min(rn) AS f FROM reg r GROUP BY ALL),
good AS (SELECT g.batch_id, arg_max((source, gp), (known, -f)) AS pick FROM groups_ g JOIN v_controls c ON c.batch_id = g.batch_id AND n = expected_count AND expected_count > 0 AND abs(t - deposit_total) <= 0.01 GROUP BY g.batch_id),
listed AS MATERIALIZED (SELECT r.*, g.pick IS NOT NULL AS agrees FROM reg r LEFT JOIN good g USING (batch_id) WHERE g.pick IS NULL OR (source, gp) IS NOT DISTINCT FROM g.pick),
counts AS (SELECT batch_id, count(*) AS n, sum(amount_numeric) AS t FROM visible GROUP BY batch_id),
st0 AS (SELECT c.batch_id, CASE WHEN expected_count > 0 THEN expected_count END AS e, deposit_total AS dt, coalesce(n, 0) AS n, coalesce(t, 0) AS t, c.batch_id IN (SELECT batch_id FROM listed WHERE agrees) AS agreed FROM v_controls c LEFT JOIN counts USING (batch_id)),
st1 AS (SELECT *, coalesce(abs(t - dt) > 0.01, false) AS off_ FROM st0),
st AS MATERIALIZED (SELECT *, CASE WHEN agreed AND off_ THEN 'report' WHEN n = e THEN 'exact' WHEN n > e THEN 'surplus' WHEN n < e THEN 'shortfall' WHEN dt IS NOT NULL AND n > 1 THEN CASE WHEN off_ THEN 'searched' ELSE 'seen' END WHEN n = 0 THEN 'register' ELSE 'seen' END AS rule FROM st1),
spare AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY source, gp NULLS LAST, item_no NULLS LAST, row_no) AS nth
  FROM listed l WHERE NOT EXISTS (SELECT 1 FROM visible v WHERE v.batch_id = l.batch_id AND list_has_any(v.keys, l.keys))),
asked AS (SELECT batch_id, CASE rule WHEN 'surplus' THEN e WHEN 'shortfall' THEN e - n ELSE n - 1 END AS wanted, CASE rule WHEN 'shortfall' THEN dt - t ELSE dt END AS total,
                 CASE rule WHEN 'searched' THEN 1 WHEN 'surplus' THEN e ELSE e - n END AS least FROM st WHERE rule IN ('surplus', 'shortfall', 'searched')),
tried AS MATERIALIZED (SELECT v.batch_id, row_no, vplace AS place, amount_numeric AS amount, quality FROM visible v JOIN st USING (batch_id) WHERE rule IN ('surplus', 'searched')
                       UNION ALL SELECT s.batch_id, row_no, nth, amount_numeric, quality FROM spare s JOIN st USING (batch_id) WHERE rule = 'shortfall'),
""" + _SUBSETS.format(rows="tried", asked="asked") + """,
chosen AS (SELECT t.batch_id, t.row_no FROM tried t JOIN best b ON b.batch_id = t.batch_id AND (mask >> (place - 1)) & 1 = 1)"""

_FINAL = """,
kept AS (
  SELECT v.batch_id, v.row_no, CASE WHEN rule = 'surplus' AND b.mask IS NULL THEN 'surplus_kept' ELSE rule END AS rule, source, page_number, item_no AS given, serial_number, unit, issue_date, amount_numeric, coalesce(missing_from_scan, false) AS missing_from_scan, image_quality,
         NULL::VARCHAR AS amount_status, CASE WHEN rule = 'surplus' AND b.mask IS NULL THEN 'visible_instruments_exceed_control_count,manual_review_required' ELSE '' END AS review_flags, page_number AS o1, 0 AS o2, -quality AS o3
  FROM visible v JOIN st USING (batch_id) LEFT JOIN best b USING (batch_id)
  WHERE rule <> 'report' AND (rule NOT IN ('surplus', 'searched') OR b.mask IS NULL OR (v.batch_id, v.row_no) IN (SELECT (batch_id, row_no) FROM chosen))),
stood AS (
  SELECT l.*, rule, 0 AS o3 FROM listed l JOIN st USING (batch_id) WHERE rule = 'report' AND agrees
  UNION ALL SELECT s.* EXCLUDE (nth), rule, CASE WHEN rule = 'shortfall' THEN nth ELSE 0 END AS o3 FROM spare s JOIN st USING (batch_id) LEFT JOIN best b USING (batch_id)
  WHERE rule = 'register' OR rule = 'shortfall' AND CASE WHEN b.mask IS NOT NULL THEN (s.batch_id, s.row_no) IN (SELECT (batch_id, row_no) FROM chosen) ELSE nth <= e - n END),
filled AS (
  SELECT batch_id, row_no, rule, source, NULL AS page_number, item_no AS given, coalesce(serial_number, micr_line) AS serial, serial_number, unit, issue_date, amount_numeric, source = 'yottareal_batch_detail' AS missing_from_scan, o3 FROM stood),
allrows AS (
  SELECT * FROM kept UNION ALL
  SELECT batch_id, row_no, rule, source, page_number, given, serial_number, unit, issue_date, amount_numeric, missing_from_scan, CASE WHEN missing_from_scan THEN 'not_extracted_from_scan' ELSE 'thumbnail_report_image' END,
         CASE WHEN missing_from_scan AND serial IS NULL THEN 'candidate' END,
         CASE WHEN NOT missing_from_scan THEN 'report_row_instrument' WHEN serial IS NULL THEN 'unverified_register_amount,missing_document_identity,manual_review_required,register_item_not_matched_to_clear_instrument' ELSE 'register_item_not_matched_to_clear_instrument' END,
         1 << 30, 0, o3 FROM filled),
selected_ AS (SELECT *, concat('INS-', batch_id, '-', lpad(item_no::VARCHAR, 3, '0')) AS instrument_id FROM (
  SELECT batch_id, row_no, rule, source, page_number, serial_number, unit, issue_date, amount_numeric, missing_from_scan, image_quality, amount_status, review_flags,
         row_number() OVER (PARTITION BY batch_id ORDER BY o1, given NULLS LAST, o3, row_no)::INTEGER AS item_no FROM allrows))"""

_RANKED = """
, c AS MATERIALIZED (
  SELECT * EXCLUDE (item_count, deposit_amount), nullif(deposit_amount, 0) AS deposit_amount, nullif(item_count, 0) AS item_count, regexp_extract(deposit_account, '[0-9]{4,}') AS acc, upper(regexp_replace(deposit_transaction, '[^A-Za-z0-9]', '', 'g')) AS tx,
         upper(regexp_replace(source_system, '[^A-Za-z0-9]', '', 'g')) AS family, row_number() OVER (PARTITION BY doc_id ORDER BY row_no) AS k
  FROM v_candidates WHERE deposit_amount <> 0 OR item_count > 0),
both_ AS (
  SELECT a.doc_id, a.k AS ka, b.k AS kb, coalesce(a.tx = b.tx, false) AS tx, coalesce(a.tx <> b.tx, false) AS tx_not, coalesce(a.acc = b.acc, false) AS acc, coalesce(a.acc <> b.acc, false) AS acc_not,
         coalesce(a.deposit_date = b.deposit_date, false) AS dat, coalesce(a.deposit_date <> b.deposit_date, false) AS dat_not, coalesce(a.item_count = b.item_count, false) AS n, coalesce(abs(a.item_count - b.item_count) > 1, false) AS n_not,
         coalesce(a.family = b.family, false) AS fam, a.source_type = 'regions_report' AND b.source_type = 'regions_report' AS reports, coalesce(abs(a.deposit_amount - b.deposit_amount) <= 0.01, false) AS exact, abs(a.page_number - b.page_number) <= 4 AS close_,
         [a.source_type, b.source_type] AS kinds, greatest(a.deposit_amount, b.deposit_amount)::DOUBLE AS high, least(a.deposit_amount, b.deposit_amount)::DOUBLE AS low, a.deposit_amount IS NULL OR b.deposit_amount IS NULL AS unknown
  FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.k < b.k),
judged AS MATERIALIZED (
  SELECT doc_id, ka, kb, unknown OR exact OR abs(high / low - 10) <= 0.25 OR high - low <= greatest(1000, high * 0.1) AS variants,
         NOT unknown AND NOT exact AND kinds = ['bank_receipt', 'bank_receipt'] AS two_receipts, NOT (tx_not AND NOT reports) AND NOT acc_not AND (tx OR (NOT dat_not AND NOT (n_not AND NOT reports) AND variants AND (
           acc AND dat OR acc AND n OR dat AND n OR n AND list_contains(kinds, 'yottareal_report') OR fam AND n AND list_has_any(kinds, ['bank_receipt', 'summary_page'])
           OR exact AND (list_sort(kinds) = ['bank_receipt', 'deposit_ticket'] OR list_sort(kinds) = ['bank_receipt', 'handwritten_ocr']) OR exact AND n AND close_ OR exact AND fam AND dat AND close_
           OR exact AND fam AND close_ AND list_has_all(['bank_receipt', 'deposit_ticket', 'handwritten_ocr', 'summary_page'], kinds)))) AS linked
  FROM both_)"""
_GROUPS = _RANKED + """,
facts AS MATERIALIZED (
  SELECT doc_id, k, coalesce(list(ka) FILTER (linked), []) AS likes, coalesce(list(ka) FILTER (NOT variants OR two_receipts), []) AS bars
  FROM (SELECT doc_id, k FROM c) c LEFT JOIN judged USING (doc_id) WHERE kb = k OR k = 1 OR kb IS NULL GROUP BY ALL),
steps AS (
  SELECT doc_id, 1 AS k, [0] AS g FROM c WHERE k = 1
  UNION ALL
  SELECT s.doc_id, s.k + 1, list_append(g, coalesce(list_min(list_filter(list_transform(likes, lambda m: g[m]), lambda x: NOT list_contains(list_transform(bars, lambda m: g[m]), x))), list_max(g) + 1))
  FROM steps s JOIN facts f ON f.doc_id = s.doc_id AND f.k = s.k + 1),
grouped AS (SELECT c.*, g[c.k] AS group_no FROM c JOIN (SELECT doc_id, arg_max(g, k) AS g FROM steps GROUP BY doc_id) USING (doc_id))"""
_SCORE = """CASE source_type WHEN 'yottareal_report' THEN 100 WHEN 'bank_receipt' THEN 80 WHEN 'regions_report' THEN 75 WHEN 'deposit_ticket' THEN 50 WHEN 'handwritten_ocr' THEN 30 WHEN 'summary_page' THEN 20 ELSE 10 END
  + CASE WHEN deposit_transaction IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN item_count > 0 THEN 15 ELSE 0 END + CASE WHEN deposit_amount > 0 THEN 15 ELSE 0 END
  + CASE WHEN deposit_account IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN deposit_date IS NOT NULL THEN 5 ELSE 0 END + coalesce(confidence, 0) * 10"""


def _merged(order: str, *more: str) -> str:
    """First values in an order that is given as a list of numbers, and all pages."""
    facts = ["source_type", "source_system", "deposit_amount", "item_count", "deposit_account", "deposit_date", "deposit_transaction", "confidence"]
    return ", ".join([*(f"arg_min({c}, {order}) FILTER ({c} IS NOT NULL) AS {c}" for c in facts), "list_sort(list_distinct(flatten(list(pages)))) AS pages", *more])


_LOGICAL = _GROUPS + f""",
l0 AS (SELECT doc_id, group_no, {_merged("[-score, k]", "CASE WHEN count(*) > 1 THEN ['duplicate_deposit_candidates_collapsed'] ELSE [] END AS flags")} FROM (SELECT *, {_SCORE} AS score, [page_number] AS pages FROM grouped) GROUP BY ALL),
tk AS (SELECT doc_id, deposit_amount, max(group_no) AS taker FROM l0 WHERE source_type = 'bank_receipt' AND deposit_amount IS NOT NULL GROUP BY ALL),
l1 AS MATERIALIZED (SELECT *, source_type IN ('deposit_ticket', 'handwritten_ocr', 'summary_page', 'metadata') AND taker IS NOT NULL AS weak FROM l0 LEFT JOIN tk USING (doc_id, deposit_amount)),
taken AS (SELECT doc_id, taker, {_merged("[weak::INT, group_no]", "arg_min(flags, [weak::INT, group_no]) AS own", "arg_min(flags, group_no) FILTER (weak) AS nxt", "count(*) FILTER (weak) AS absorbed")} FROM l1 WHERE weak OR group_no = taker GROUP BY ALL),
l2 AS (
  SELECT doc_id, group_no, source_type, source_system, deposit_amount, item_count, deposit_account, deposit_date, deposit_transaction, confidence, pages, flags FROM l1 WHERE NOT weak AND NOT (source_type = 'bank_receipt' AND deposit_amount IS NOT NULL)
  UNION ALL
  SELECT l1.doc_id, group_no, t.source_type, t.source_system, t.deposit_amount, t.item_count, t.deposit_account, t.deposit_date, t.deposit_transaction, t.confidence, t.pages,
         list_concat(CASE WHEN len(own) > 0 OR nxt IS NULL THEN own ELSE nxt END, list_transform(range(absorbed), lambda i: 'same_amount_weaker_deposit_candidate_collapsed'))
  FROM l1 JOIN taken t ON t.doc_id = l1.doc_id AND t.taker = l1.taker WHERE NOT weak AND l1.source_type = 'bank_receipt' AND l1.deposit_amount IS NOT NULL),
l3 AS MATERIALIZED (SELECT *, {_SCORE} AS score, source_type = 'yottareal_report' AS rep FROM l2),
d AS (
  SELECT doc_id, arg_min(group_no, [-score, group_no]) FILTER (rep) AS control, arg_min(deposit_amount, [-score, group_no]) FILTER (rep) AS ca, count(*) FILTER (NOT rep AND deposit_amount IS NOT NULL) AS paid,
         count(*) FILTER (source_type = 'bank_receipt' AND deposit_amount IS NOT NULL) AS receipts, sum(deposit_amount) FILTER (NOT rep) AS total, count(*) FILTER (NOT rep) AS others FROM l3 GROUP BY doc_id),
r AS (SELECT l3.*, control, others, CASE WHEN control IS NULL THEN 'all' WHEN paid >= 2 AND paid = receipts AND coalesce(abs(total - ca) <= 0.01, false) OR receipts > 1 THEN 'receipts' ELSE 'report' END AS rule FROM l3 JOIN d USING (doc_id)),
res AS (
  SELECT doc_id, group_no, source_type, source_system, deposit_amount, item_count, deposit_account, deposit_date, deposit_transaction, confidence, pages, flags, rule FROM r
  WHERE rule = 'all' OR rule = 'receipts' AND source_type = 'bank_receipt' AND deposit_amount IS NOT NULL
  UNION ALL
  SELECT doc_id, control, source_type, source_system, deposit_amount, item_count, deposit_account, deposit_date, deposit_transaction, confidence, pages, CASE WHEN oth > 0 THEN list_append(coalesce(fl, []), 'aggregate_control_superseded_component_deposits') ELSE coalesce(fl, []) END, 'report'
  FROM (SELECT doc_id, {_merged("[(group_no <> control)::INT, group_no]", "any_value(others) AS oth", "arg_min(flags, [(group_no <> control)::INT, group_no]) FILTER (len(flags) > 0) AS fl", "any_value(control) AS control")}
        FROM r WHERE rule = 'report' AND (group_no = control OR NOT rep) GROUP BY doc_id))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pages[1] NULLS LAST, group_no)::INTEGER AS place, group_no, pages[1] AS page_number, source_type, source_system, deposit_amount, item_count, deposit_account, deposit_date, deposit_transaction,
       confidence, array_to_string(pages, ',') AS pages, array_to_string(flags, ',') AS flags, rule FROM res"""

def _ratio_sql(pairs: str) -> str:
    """rated(l, r, ratio) of distinct pairs (l, r): again and again the longest common block of a segment, leftmost in l, then in r, splits it in two."""
    return f"""
met AS MATERIALIZED (SELECT l, r, i, j, len(list_filter(range(1, least(len(l) - i, len(r) - j) + 2), lambda k: l[i:i + k - 1] = r[j:j + k - 1])) AS n
  FROM (SELECT l, r, i, unnest(range(1, len(r) + 1)) AS j FROM (SELECT l, r, unnest(range(1, len(l) + 1)) AS i FROM {pairs})) WHERE l[i] = r[j]),
parts AS (
  SELECT l, r, 1::BIGINT AS a0, len(l) + 1 AS a1, 1::BIGINT AS b0, len(r) + 1 AS b1, 0::BIGINT AS hit FROM {pairs}
  UNION ALL
  SELECT l, r, CASE side WHEN 0 THEN a0 ELSE i + k END, CASE side WHEN 0 THEN i ELSE a1 END, CASE side WHEN 0 THEN b0 ELSE j + k END, CASE side WHEN 0 THEN j ELSE b1 END, CASE side WHEN 0 THEN k ELSE 0 END
  FROM (SELECT p.*, i, j, least(n, a1 - i, b1 - j) AS k, row_number() OVER (PARTITION BY p.l, p.r, a0, a1, b0, b1 ORDER BY least(n, a1 - i, b1 - j) DESC, i, j) AS nth
        FROM parts p JOIN met m ON m.l = p.l AND m.r = p.r AND i >= a0 AND i < a1 AND j >= b0 AND j < b1) x, (SELECT unnest([0, 1]) AS side) WHERE nth = 1),
rated AS MATERIALIZED (SELECT l, r, 2.0::DOUBLE * sum(hit) / (len(l) + len(r)) AS ratio FROM parts GROUP BY l, r)"""


_PAYEE = """
, p0 AS (SELECT batch_id, line_no, regexp_replace(upper(payee_raw), '[^A-Z0-9]', '', 'g') AS p FROM v_payees),
n0 AS (SELECT DISTINCT batch_id, regexp_replace(upper(alias), '[^A-Z0-9]', '', 'g') AS t, false AS word FROM v_names UNION SELECT batch_id, upper(unnest(regexp_extract_all(alias, '[A-Za-z0-9]{5,}'))), true FROM v_names),
pairs_ AS (SELECT DISTINCT p AS l, t AS r FROM p0 JOIN n0 USING (batch_id) WHERE p <> '' AND t <> ''),
""".rstrip(",\n") + "," + _ratio_sql("pairs_") + """,
sc AS (SELECT batch_id, line_no, CASE WHEN word THEN CASE WHEN round(ratio, 3) >= 0.8 THEN greatest(0.88, round(ratio, 3)) END
                                  ELSE greatest(round(ratio, 3), CASE WHEN least(len(p), len(t)) >= 5 AND (contains(p, t) OR contains(t, p)) THEN 0.95 END) END AS s
       FROM p0 JOIN n0 USING (batch_id) JOIN rated ON l = p AND r = t)
SELECT batch_id, line_no, coalesce(max(s), 0)::DOUBLE AS score FROM p0 LEFT JOIN sc USING (batch_id, line_no) GROUP BY batch_id, line_no"""
_SAME_ROWS = """
, ob AS MATERIALIZED (
  SELECT *, regexp_replace(upper(coalesce(serial_number, '')), '[^A-Z0-9]', '', 'g') AS s, regexp_replace(upper(coalesce(micr_line, '')), '[^A-Z0-9]', '', 'g') AS ml, regexp_replace(coalesce(micr_line, ''), '[^0-9]', '', 'g') AS m,
         regexp_replace(upper(coalesce(payee_raw, '')), '[^A-Z0-9]', '', 'g') AS py FROM v_observations),
cross_ AS (SELECT a.page_id, a.row_no AS a, b.row_no AS b, a.s AS sa, b.s AS sb, a.m AS ma, b.m AS mb, a.ml AS la, a.py <> '' AND a.py = b.py AND a.amount_numeric = b.amount_numeric AND coalesce(a.instrument_type, '') = coalesce(b.instrument_type, '') AS same
           FROM ob a JOIN ob b ON a.page_id = b.page_id AND a.row_no < b.row_no),
pairs_ AS (SELECT DISTINCT sb AS l, sa AS r FROM cross_ WHERE sa <> '' AND sb <> '' UNION SELECT mb, ma FROM cross_ WHERE ma <> '' AND mb <> ''),
""".rstrip(",\n") + "," + _ratio_sql("pairs_") + """,
linked AS MATERIALIZED (
  SELECT page_id, a, b FROM cross_ LEFT JOIN rated x ON x.l = sb AND x.r = sa LEFT JOIN rated y ON y.l = mb AND y.r = ma
  WHERE coalesce(x.ratio >= 0.82, false) OR coalesce(y.ratio >= 0.82, false) OR coalesce(same, false) OR (sb <> '' AND contains(la, sb)) OR (sa <> '' AND contains(mb, sa)))"""
_MERGED_ROWS = _SAME_ROWS + """,
facts AS MATERIALIZED (SELECT o.page_id, o.row_no, list(a) FILTER (a IS NOT NULL) AS likes FROM ob o LEFT JOIN linked k ON k.page_id = o.page_id AND k.b = o.row_no GROUP BY ALL),
steps AS (
  SELECT page_id, 1::BIGINT AS k, [0] AS g FROM facts WHERE row_no = 1
  UNION ALL
  SELECT s.page_id, s.k + 1, list_append(g, coalesce(list_min(list_transform(likes, lambda m: g[m])), list_max(g) + 1)) FROM steps s JOIN facts f ON f.page_id = s.page_id AND f.row_no = s.k + 1),
grouped AS (
  SELECT o.*, g[row_no] AS group_no, (serial_number IS NOT NULL)::INT + (micr_line IS NOT NULL)::INT + (amount_numeric IS NOT NULL)::INT + (payee_raw IS NOT NULL)::INT + (instrument_type IS NOT NULL)::INT + (issue_date IS NOT NULL)::INT AS n_full
  FROM ob o JOIN (SELECT page_id, arg_max(g, k) AS g FROM steps GROUP BY page_id) USING (page_id)),
placed AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY page_id, group_no ORDER BY n_full DESC, row_no) = 1 THEN -1 ELSE row_no END AS o FROM grouped),
merged_ AS (
  SELECT page_id, group_no, arg_min(serial_number, o) FILTER (serial_number IS NOT NULL) AS sn, arg_min(micr_line, o) FILTER (micr_line IS NOT NULL) AS micr_line, arg_min(amount_numeric, o) FILTER (amount_numeric IS NOT NULL) AS am,
         arg_min(payee_raw, o) FILTER (payee_raw IS NOT NULL) AS payee_raw, arg_min(instrument_type, o) FILTER (instrument_type IS NOT NULL) AS instrument_type, arg_min(issue_date, o) FILTER (issue_date IS NOT NULL) AS issue_date,
         count(*) AS observations, count(DISTINCT amount_numeric) > 1 AS torn, count(DISTINCT s) FILTER (s <> '') > 1 AS twice FROM placed GROUP BY ALL),
mo AS (
  SELECT page_id, group_no, CASE WHEN NOT twice THEN sn END AS serial_number, micr_line, CASE WHEN NOT torn THEN am END AS amount_numeric, payee_raw, instrument_type, issue_date, observations, CASE WHEN torn OR twice THEN 'unclear' END AS image_quality,
         array_to_string(list_filter([CASE WHEN torn THEN 'conflicting_region_amounts,manual_review_required' END, CASE WHEN twice THEN 'conflicting_region_document_numbers,manual_review_required' END], lambda x: x IS NOT NULL), ',') AS review_flags FROM merged_)"""
_ONE_FRONT = _MERGED_ROWS + """,
cf AS (
  SELECT m.*, kind = 'instrument' AND NOT several_fronts AND count(*) OVER (PARTITION BY page_id) > 1 AND count(DISTINCT amount_numeric) FILTER (amount_numeric > 0) OVER (PARTITION BY page_id) <= 1 AS one,
         row_number() OVER (PARTITION BY page_id ORDER BY 4 * (micr_line IS NOT NULL)::INT + 3 * (serial_number IS NOT NULL)::INT + 2 * (payee_raw IS NOT NULL)::INT + 2 * (issue_date IS NOT NULL)::INT + (amount_numeric IS NOT NULL)::INT DESC, group_no) AS nth
  FROM mo m LEFT JOIN v_fronts USING (page_id))
SELECT * EXCLUDE (one, nth) REPLACE (CASE WHEN one THEN 'unclear' ELSE image_quality END AS image_quality, CASE WHEN one THEN array_to_string(list_filter([nullif(review_flags, ''), 'multiple_interpretations_single_front'], lambda x: x IS NOT NULL), ',') ELSE review_flags END AS review_flags)
FROM cf WHERE NOT coalesce(one, false) OR nth = 1"""
_ROLLUP = """
, h AS (SELECT *, (batch_number IS NOT NULL)::INT + (batch_amount IS NOT NULL)::INT + (total_items IS NOT NULL)::INT + (property_name <> '' AND property_name IS NOT NULL)::INT AS fields FROM v_headers),
o AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY fields = 0, batch_number IS NULL, coalesce(total_items, 0) DESC, coalesce(batch_amount, 0) DESC, fields DESC, page_number) = 1 THEN -1 ELSE page_number END AS o FROM h)
SELECT doc_id, arg_min(batch_number, o) FILTER (batch_number IS NOT NULL) AS batch_number, arg_min(batch_amount, o) FILTER (batch_amount IS NOT NULL) AS batch_amount, arg_min(total_items, o) FILTER (total_items IS NOT NULL) AS total_items,
  arg_min(property_name, o) FILTER (property_name <> '') AS property_name, arg_max(deposit_account, page_number) FILTER (deposit_account IS NOT NULL) AS deposit_account, arg_max(deposit_date, page_number) FILTER (deposit_date IS NOT NULL) AS deposit_date,
  arg_max(deposit_amount, page_number) FILTER (deposit_amount IS NOT NULL) AS deposit_amount FROM o GROUP BY doc_id"""

#: The whole job: a batch's control joins its candidates, logical deposits give the controls, these choose the instruments, and a lone receipt may overrule.
_CONTROLLED = """
, slips_ AS MATERIALIZED (
  SELECT doc_id, row_no, page_number, source_type, source_system, deposit_amount, item_count, deposit_account, deposit_date, deposit_transaction, confidence FROM v_slips
  UNION ALL
  SELECT batch_id, 0, NULL, CASE WHEN batch_number IS NOT NULL AND source_system IS NULL THEN 'yottareal_report' WHEN source_system LIKE 'Regions%' THEN 'regions_report' WHEN source_system LIKE 'Deposit Detail%' THEN 'deposit_detail_report' ELSE 'summary_page' END,
         source_system, batch_amount, total_items, NULL, NULL, NULL, NULL
  FROM v_heads WHERE (batch_amount IS NOT NULL OR total_items IS NOT NULL) AND (batch_number IS NOT NULL OR source_system IS NOT NULL OR batch_id NOT IN (SELECT doc_id FROM v_slips)))"""
_CONTROLS = """,
dsum AS (SELECT doc_id AS batch_id, count(*) AS slips, count(item_count) AS counted, sum(item_count) AS items, sum(deposit_amount)::DECIMAL(14,2) AS dt FROM res GROUP BY doc_id),
lsum AS (SELECT batch_id, count(*) AS n_listed FROM v_listed WHERE source <> 'vision_register_items' GROUP BY batch_id),
controls_ AS MATERIALIZED (
  SELECT batch_id, total_pages, CASE WHEN slips > 1 AND counted < slips THEN coalesce(nullif(total_items, 0), n_listed) ELSE coalesce(items, nullif(total_items, 0), n_listed) END AS expected_count, dt AS deposit_total
  FROM v_heads LEFT JOIN dsum USING (batch_id) LEFT JOIN lsum USING (batch_id))"""
_JUDGED = """,
ssum AS (SELECT batch_id, sum(amount_numeric) FILTER (page_number IS NOT NULL) AS shown, count(*) AS n FROM selected_ GROUP BY batch_id),
lone AS (SELECT s.batch_id FROM ssum s JOIN res ON doc_id = s.batch_id AND source_type = 'bank_receipt' AND abs(deposit_amount - shown) <= 0.01 GROUP BY s.batch_id HAVING count(*) = 1),
final_ AS (
  SELECT c.batch_id, coalesce(n, 0) AS n, coalesce(t, 0)::DECIMAL(14,2) AS instrument_total, CASE WHEN by_ THEN n ELSE expected_count END AS total_items, CASE WHEN by_ THEN shown ELSE deposit_total END::DECIMAL(14,2) AS batch_amount
  FROM (SELECT c.*, shown, n, c.batch_id IN (SELECT batch_id FROM lone) AND coalesce(abs(deposit_total - shown) > 0.01, true) AS by_ FROM controls_ c LEFT JOIN ssum USING (batch_id)) c
  LEFT JOIN (SELECT batch_id, sum(amount_numeric) AS t FROM selected_ GROUP BY batch_id) USING (batch_id)),
inst_ AS (SELECT *, item_no AS line_no FROM selected_)"""
_DECIDED = """,
soft_ AS (SELECT batch_id, bool_or(status <> 'VALID') AS soft FROM scored GROUP BY batch_id),
tested AS (SELECT *, coalesce(abs(instrument_total - batch_amount) <= 0.01, false) AS amounts, coalesce(n = total_items, true) AS items FROM final_ LEFT JOIN soft_ USING (batch_id))
SELECT batch_id, batch_amount, instrument_total, (instrument_total - batch_amount)::DECIMAL(14,2) AS gap, total_items, n AS instrument_count, CASE WHEN NOT amounts OR NOT items THEN 'FAIL' WHEN soft THEN 'PASS_WITH_REVIEW' ELSE 'PASS' END AS decision,
  CASE WHEN NOT amounts OR NOT items THEN 'REJECT' WHEN soft THEN 'REVIEW' ELSE 'ACCEPT' END AS overall,
  concat_ws(',', CASE WHEN amounts THEN 'amounts_reconciled' ELSE 'amount_mismatch' END, CASE WHEN items THEN 'item_count_reconciled' ELSE 'item_count_mismatch' END, CASE WHEN amounts AND items AND soft THEN 'manual_review_required_for_item_flags' END) AS flags
FROM tested"""
_TYPED = r"""
, w AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, CASE WHEN content LIKE 'Pay to%' THEN 'payee' WHEN content LIKE 'Check No%' THEN 'document_number' WHEN content LIKE '$%' OR content LIKE '%.25' THEN 'amount_box'
             WHEN content LIKE '%dollars' THEN 'amount_words' WHEN regexp_matches(content, '^[0-9]{4,}$') THEN 'micr' END AS kind,
           CASE WHEN content LIKE 'For dep%' THEN 'back' WHEN content LIKE 'Pay to%' OR content = 'Remitter' THEN 'front' WHEN content LIKE '$%' OR content LIKE '%.25' THEN 'amount' WHEN regexp_matches(content, '[0-9]{4,}$') THEN 'number' END AS anchor
        FROM v_placed_words WHERE x1 <= 1 AND y1 <= 1)"""
_GRAPH = _TYPED + """,
nodes AS MATERIALIZED (SELECT * FROM w WHERE kind IS NOT NULL),
near AS MATERIALIZED (SELECT a.page_id, a.word_no AS a, b.word_no AS b FROM nodes a JOIN nodes b ON a.page_id = b.page_id AND abs(a.cx - b.cx) < 0.30 AND abs(a.cy - b.cy) < 0.28),
reach AS (SELECT page_id, a, b FROM near UNION SELECT r.page_id, r.a, n.b FROM reach r JOIN near n ON n.page_id = r.page_id AND n.a = r.b),
comp AS (SELECT page_id, a AS word_no, min(b) AS group_no FROM reach GROUP BY ALL),
eg AS (SELECT page_id, group_no, count(*) AS words, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, greatest(0.0, min(x0) - 0.08) AS x0, greatest(0.0, min(y0) - 0.14) AS y0, least(1.0, max(x1) + 0.08) AS x1, least(1.0, max(y1) + 0.14) AS y1,
         string_agg(kind || ': ' || content, chr(10) ORDER BY word_no) AS text, least(0.99, sum(confidence) / count(*)) AS confidence
       FROM nodes JOIN comp USING (page_id, word_no) GROUP BY ALL HAVING bool_or(kind IN ('document_number', 'micr')) AND bool_or(kind IN ('amount_box', 'amount_words')))"""
_SHARED = "(greatest(0.0, least(x.x1, b.x1) - greatest(x.x0, b.x0)) * greatest(0.0, least(x.y1, b.y1) - greatest(x.y0, b.y0)))"


def _greedy(boxes: str, overlap: float) -> str:
    """place, region_idx, box, confidence, members of the kept boxes: one box a step, the first kept one that it overlaps enough grows."""
    hit = f"list_min(list_filter(range(1, len(g) + 1), lambda i: list_transform([g[i]], lambda x: {_SHARED} / ((x.x1 - x.x0) * (x.y1 - x.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_SHARED}) >= {overlap})[1]))"
    one = "{'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1, 'c': b.confidence, 'i': b.region_idx, 'n': 1::BIGINT}"
    grown = "{'x0': least(x.x0, b.x0), 'y0': least(x.y0, b.y0), 'x1': greatest(x.x1, b.x1), 'y1': greatest(x.y1, b.y1), 'c': x.c, 'i': x.i, 'n': x.n + 1}"
    return f"""
ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, region_idx) AS k FROM {boxes}),
steps AS (
  SELECT page_id, 1::BIGINT AS k, [{one}] AS g FROM ordered b WHERE k = 1
  UNION ALL
  SELECT page_id, k, CASE WHEN h IS NULL THEN list_append(g, {one}) ELSE list_transform(g, lambda x, i: CASE WHEN i = h THEN {grown} ELSE x END) END
  FROM (SELECT s.page_id, b.k, s.g, b, {hit} AS h FROM steps s JOIN ordered b ON b.page_id = s.page_id AND b.k = s.k + 1)),
final AS (SELECT page_id, unnest(g) AS u, unnest(range(1, len(g) + 1))::INTEGER AS place FROM (SELECT page_id, arg_max(g, k) AS g FROM steps GROUP BY page_id))
SELECT page_id, place, u.i AS region_idx, u.x0 AS x0, u.y0 AS y0, u.x1 AS x1, u.y1 AS y1, u.c AS confidence, u.n AS members FROM final"""


_SUPPRESSED = f"""
, ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, region_idx) AS k FROM v_boxes),
steps AS (
  SELECT page_id, 1::BIGINT AS k, [b] AS g FROM ordered b WHERE k = 1
  UNION ALL
  SELECT s.page_id, b.k, CASE WHEN len(list_filter(g, lambda x: {_SHARED} > 0.65 * least((x.x1 - x.x0) * (x.y1 - x.y0), (b.x1 - b.x0) * (b.y1 - b.y0)))) > 0 THEN g ELSE list_append(g, b) END
  FROM steps s JOIN ordered b ON b.page_id = s.page_id AND b.k = s.k + 1)
SELECT page_id, unnest(range(1, len(g) + 1))::INTEGER AS place, unnest(g).region_idx AS region_idx FROM (SELECT page_id, arg_max(g, k) AS g FROM steps GROUP BY page_id)"""
_TERRITORY = _TYPED + """,
an AS (SELECT * FROM w WHERE anchor IS NOT NULL)
SELECT s.page_id, s.word_no, count(*) AS anchors, greatest(0.0, min(a.x0) - 0.07) AS x0, greatest(0.0, min(a.y0) - 0.12) AS y0, least(1.0, max(a.x1) + 0.07) AS x1, least(1.0, max(a.y1) + 0.12) AS y1
FROM an s JOIN an a ON a.page_id = s.page_id AND abs(a.cx - s.cx) <= 0.30 AND abs(a.cy - s.cy) <= 0.24 WHERE s.anchor <> 'back' GROUP BY s.page_id, s.word_no
HAVING bool_or(a.anchor = 'amount') AND (bool_or(a.anchor = 'front') OR bool_or(a.anchor = 'number')) AND (NOT bool_or(a.anchor = 'back') OR bool_or(a.anchor = 'front'))"""
_HASHED = """
, ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY item) AS k FROM v_hashes WHERE hash IS NOT NULL),
steps AS (
  SELECT page_id, 1::BIGINT AS k, [hash] AS g, [item] AS kept FROM ordered WHERE k = 1
  UNION ALL
  SELECT page_id, k, CASE WHEN seen THEN g ELSE list_append(g, hash) END, CASE WHEN seen THEN kept ELSE list_append(kept, item) END
  FROM (SELECT s.page_id, b.k, g, kept, hash, item, len(list_filter(g, lambda x: bit_count(xor(x, hash)) < 0.08 * 64)) > 0 AS seen FROM steps s JOIN ordered b ON b.page_id = s.page_id AND b.k = s.k + 1))
SELECT page_id, unnest(kept) AS item FROM (SELECT page_id, arg_max(kept, k) AS kept FROM steps GROUP BY page_id) UNION ALL SELECT page_id, item FROM v_hashes WHERE hash IS NULL"""

_FOUND = """
, qv AS (SELECT query_id, list_transform(vector, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM v_questions WHERE vector IS NOT NULL),
cv AS (SELECT chunk_id, list_transform(vector, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM v_named_chunks),
nn AS (SELECT q.query_id, c.chunk_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::DOUBLE / sqrt(list_sum(list_transform(q.v, lambda x: x * x))::DOUBLE * list_sum(list_transform(c.v, lambda x: x * x))::DOUBLE) AS score FROM qv q, cv c),
near_ AS MATERIALIZED (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS r1 FROM nn WHERE score IS NOT NULL QUALIFY r1 <= 120)"""
_HYBRID = _FOUND + """,
q AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM v_questions),
w AS (SELECT chunk_id, coalesce(regexp_extract_all(lower(content), '[a-z]+'), []) AS w FROM v_named_chunks), stt AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
tf AS (SELECT chunk_id, len, word, count(*) AS tf FROM (SELECT chunk_id, len(w) AS len, unnest(w) AS word FROM w) WHERE word IN (SELECT word FROM q) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
sw AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score FROM q JOIN tf USING (word) JOIN df USING (word), stt GROUP BY query_id, chunk_id),
said_ AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r2 FROM sw QUALIFY r2 <= 75),
fused AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(1.0::DOUBLE / (60 + r1), 0) + coalesce(1.0::DOUBLE / (60 + r2), 0) DESC, chunk_id) AS place FROM near_ FULL JOIN said_ USING (query_id, chunk_id) QUALIFY place <= 75),
hits AS (SELECT query_id, chunk_id, place, coalesce(parent_id, 'chunk ' || chunk_id) AS parent, NAMED AS own_name, substr(content, 1, 5000) AS content FROM fused JOIN v_named_chunks USING (chunk_id)),
named AS (SELECT *, first_value(own_name) OVER (PARTITION BY query_id, parent ORDER BY place) AS filename FROM hits),
seven AS (SELECT * FROM named WHERE content <> '' QUALIFY row_number() OVER (PARTITION BY query_id, parent ORDER BY place) <= 7)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place)::INTEGER AS rank, chunk_id, parent, filename, content FROM seven QUALIFY rank <= 15"""


def _whole(df: DataFrame) -> DataFrame:
    """Vectors in whole numbers of 1/256, of which sums are exact."""
    return df.withColumn("vector", F.transform("vector", lambda x: F.floor(x.cast("double") * 256)))


def _nearest(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    return search.nearest(_whole(questions).select("query_id", "vector"), _whole(chunks).select("chunk_id", "vector"), 120)


def _hybrid(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    return search.hybrid_search(_whole(questions), _whole(chunks))


def _grown_index(documents: DataFrame) -> DataFrame:
    """An index that grows: a run over half of the documents, one over all and one more, of which each text's chunks stay once."""
    path = f"{shared_folder(documents.sparkSession)}/index-{uuid.uuid4().hex}"
    for rows in (documents.where("doc_id % 2 = 0"), documents, documents):
        index = increments.incremental_index(rows, path)
    return index.select("doc_id", "chunk_number", F.md5("content").alias("chunk_md5"))


def _read_page(requests: pd.DataFrame) -> pd.DataFrame:
    if (requests["zoom"] == 2).any():
        raise ValueError("zoom 2 can't be read")
    return pd.DataFrame({"place": requests["page"] * 10 + requests["zoom"]})


def _read_requests(requests: DataFrame) -> DataFrame:
    """Requests whose answers were kept by an earlier call for some of them."""
    path, fields = f"{shared_folder(requests.sparkSession)}/answers-{uuid.uuid4().hex}", ("kind", "page", "zoom")
    increments.with_reader(requests.where("kind = 'layout'"), fields, _read_page, "place long", path)
    return increments.with_reader(requests, fields, _read_page, "place long", path).select("request_id", "kind", "page", "zoom", "place", "error")


def _merged_rows(observations: DataFrame) -> DataFrame:
    return similar.merge_observations(observations, similar.same_instrument_pairs(observations))


def _one_front(observations: DataFrame, fronts: DataFrame) -> DataFrame:
    merged = _merged_rows(observations).withColumn("amount_words", F.lit(None).cast("string"))
    return similar.consolidate_single_front(merged, fronts).drop("amount_words")


def register(add: Callable, risk: str, named: str) -> None:
    """Adds the queries; ``risk`` is the SQL of v_instruments' risk scores, ``named`` that of a hit's name."""
    logical = _LOGICAL.replace("v_candidates", "slips_").split("\nSELECT doc_id, row_number()")[0]
    own = lambda text: text.replace("v_controls", "controls_")
    scored = risk.replace("v_instruments", "inst_").replace(", r AS", ",\nrk AS").replace("FROM r)", "FROM rk)")
    whole = _CONTROLLED + logical + _CONTROLS + own(_SELECTED + _FINAL).replace("\n, cand", ",\ncand").replace("steps AS", "steps AS") + _JUDGED + scored + _DECIDED
    add("validate_batches", selection.validate_batches, "v_heads v_slips v_seen v_listed", whole, as_of="1998-12-01")
    add("payee_score", similar.payee_score, "v_payees v_names", _PAYEE)
    add("same_instrument_pairs", similar.same_instrument_pairs, "v_observations", _SAME_ROWS + "\nSELECT page_id, a, b FROM linked")
    add("merge_observations", _merged_rows, "v_observations", _MERGED_ROWS + "\nSELECT * FROM mo")
    add("consolidate_single_front", _one_front, "v_observations v_fronts", _ONE_FRONT)
    add("knn", _nearest, "v_questions v_named_chunks", _FOUND + "\nSELECT query_id, r1 AS rank, chunk_id, score FROM near_")
    add("hybrid_search", _hybrid, "v_questions v_named_chunks", _HYBRID.replace("NAMED", named))
    add("match_verified", selection.match_verified, "v_first_reads v_second_reads v_totals", """
, s AS (SELECT batch_id, count(*) AS n, coalesce(sum(amount_numeric), 0) AS t FROM v_first_reads GROUP BY batch_id),
o AS (SELECT batch_id, t, deposit_total AS dt FROM v_totals JOIN s USING (batch_id) WHERE abs(deposit_total - t) > 0.01 AND CASE WHEN expected_count > 0 THEN n >= expected_count ELSE abs(deposit_total - t) <= 150 END),
a AS (SELECT f.*, t, dt, row_number() OVER (PARTITION BY batch_id ORDER BY row_no) AS nth FROM v_first_reads f JOIN o USING (batch_id)
      WHERE page_number BETWEEN 1 AND total_pages AND (words_amount IS NULL OR coalesce(abs(words_amount - amount_numeric) > 0.01, false) OR coalesce(image_quality = 'unclear', false)) QUALIFY nth <= 4),
r AS (SELECT a.batch_id, a.row_no, coalesce(amount_numeric, 0) AS was, amount AS now_, t, dt, row_number() OVER (PARTITION BY a.batch_id ORDER BY a.row_no) AS k FROM a JOIN v_second_reads b ON a.batch_id = b.batch_id AND a.row_no = b.row_no
      AND amount IS NOT NULL AND confidence >= 0.72 AND agree AND (NOT conflict OR source = 'both')),
steps AS (
  SELECT batch_id, 0::BIGINT AS k, any_value(t) AS now_t, any_value(dt) AS dt, []::BIGINT[] AS taken FROM r GROUP BY batch_id
  UNION ALL
  SELECT batch_id, k, CASE WHEN better THEN now_t - was + now_ ELSE now_t END, dt, CASE WHEN better THEN list_append(taken, row_no) ELSE taken END
  FROM (SELECT s.batch_id, r.k, s.now_t, s.dt, s.taken, r.row_no, r.was, r.now_, abs(s.dt - now_t) > 0.01 AND abs(s.dt - (now_t - r.was + r.now_)) < abs(s.dt - now_t) AS better FROM steps s JOIN r ON r.batch_id = s.batch_id AND r.k = s.k + 1)),
won AS (SELECT batch_id, unnest(taken) AS row_no FROM (SELECT batch_id, arg_max(taken, k) AS taken FROM steps GROUP BY batch_id))
SELECT f.* REPLACE (CASE WHEN w.row_no IS NOT NULL THEN b.amount ELSE f.amount_numeric END AS amount_numeric), w.row_no IS NOT NULL AS replaced
FROM v_first_reads f LEFT JOIN won w ON w.batch_id = f.batch_id AND w.row_no = f.row_no LEFT JOIN v_second_reads b ON b.batch_id = f.batch_id AND b.row_no = f.row_no""")
    add("best_rotation", rollups.best_rotation, "v_turned v_turned_controls", """
, b AS (SELECT page_id, orientation, count(*) AS items, coalesce(sum(amount), 0)::DECIMAL(14,2) AS total FROM v_turned GROUP BY ALL),
j AS (SELECT b.*, nullif(expected_count, 0) AS e, nullif(expected_total, 0) AS t, abs(total - expected_total)::DOUBLE AS off_, list_position([0, 180, 90, 270], orientation) AS turn FROM b LEFT JOIN v_turned_controls USING (page_id)),
s AS (SELECT *, coalesce(turn = 1 AND items = e AND (t IS NULL OR off_ <= 1), false) AS stands, items * 100.0::DOUBLE - coalesce(abs(items - e) * 500.0::DOUBLE, 0) + CASE WHEN items = e THEN 1000 ELSE 0 END
             + CASE WHEN t IS NULL THEN 0 WHEN off_ <= 1 THEN 400 WHEN off_ <= 250 THEN 75 ELSE -least(off_, 1000.0) / 25 END + total::DOUBLE / 1000 AS score FROM j)
SELECT page_id, orientation, items, total FROM s QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY stands DESC, score DESC, turn) = 1""")
    add("infer_property", selection.inferred_property, "v_first_reads", """
, n AS (SELECT batch_id, row_no, CASE WHEN lower(payee_raw) = 'oak court' THEN 'Oak Court' ELSE payee_raw END AS p FROM v_first_reads WHERE payee_raw NOT IN ('First Bank', 'Pay to the order of')),
g AS (SELECT batch_id, p AS property_name, count(*) AS items, min(row_no) AS f FROM n GROUP BY ALL)
SELECT batch_id, property_name, items FROM g QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY items DESC, f) = 1""")
    pattern = "(?i)" + "|".join(texts.FOCUS)
    add("focus_context", texts.focus_context, "documents", rf"""
WITH l0 AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(regexp_replace(x, '^[\s\pZ]+|[\s\pZ]+$', '', 'g'), '[ \t]+', ' ', 'g')), lambda x: length(x) >= 2)) AS line,
             generate_subscripts(list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(regexp_replace(x, '^[\s\pZ]+|[\s\pZ]+$', '', 'g'), '[ \t]+', ' ', 'g')), lambda x: length(x) >= 2), 1) AS pos FROM documents),
h AS (SELECT *, regexp_matches(line, '{pattern}') AS hit FROM l0),
k AS (SELECT *, hit OR lag(hit, 1, false) OVER w OR lead(hit, 1, false) OVER w AS near, bool_or(hit) OVER (PARTITION BY doc_id) AS any_hit, upper(regexp_replace(line, '[^\p{{L}}\p{{N}}_]+', '', 'g')) AS same FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
o AS (SELECT * FROM k WHERE (near OR NOT any_hit AND pos <= 35) AND same <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, same ORDER BY pos) = 1),
b AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, sum(length(line) + 1) OVER (PARTITION BY doc_id) AS whole FROM o),
t AS (SELECT doc_id, count(*) AS lines, string_agg(line, chr(10) ORDER BY pos) AS text FROM b WHERE upto <= 2600 OR whole - 1 <= 2600 GROUP BY doc_id)
SELECT doc_id, coalesce(lines, 0) AS lines, coalesce(t.text, '') AS text FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN t USING (doc_id)""")
    add("incremental_index", _grown_index, "documents", """
WITH p AS (SELECT doc_id, text, unnest(range(1, length(text) + 1, 800)) AS s FROM documents WHERE text <> '')
SELECT doc_id, ((s - 1) / 800 + 1)::INTEGER AS chunk_number, md5(substring(text, s, 1000)) AS chunk_md5 FROM p""")
    add("with_reader", _read_requests, "v_requests", """
SELECT request_id, kind, page, zoom, CASE WHEN zoom <> 2 THEN page * 10 + zoom END AS place, CASE WHEN zoom = 2 THEN 'ValueError: zoom 2 can''t be read' END AS error FROM v_requests""")
    add("evidence_groups", boxes.evidence_groups, "v_placed_words", _GRAPH + "\nSELECT * FROM eg")
    add("evidence_regions", boxes.evidence_regions, "v_placed_words", _GRAPH + ",\nbx AS (SELECT page_id, group_no AS region_idx, x0, y0, x1, y1, confidence FROM eg)," + _greedy("bx", 0.58) + " WHERE place <= 12")
    add("amount_bound_regions", boxes.amount_bound_regions, "v_placed_words", _TERRITORY)
    add("merge_regions_greedily", boxes.greedily_merged, "v_boxes", "," + _greedy("v_boxes", 0.42))
    add("suppress_contained", boxes.suppress_contained, "v_boxes", _SUPPRESSED)
    add("distinct_hashes", boxes.distinct_hashes, "v_hashes", _HASHED)
    add("rollup_document", similar.rollup_document, "v_headers", _ROLLUP)
    add("logical_deposits", deposits.logical_deposits, "v_candidates", _LOGICAL)
    add("select_instruments", selection.select_instruments, "v_seen v_listed v_controls", _SELECTED + _FINAL + "\nSELECT * FROM selected_")
