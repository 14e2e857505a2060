"""Tables of evidence derived from the given tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import written

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_instruments": """
SELECT l_orderkey AS batch_id, l_linenumber AS line_no, l_partkey AS part_key,
       CASE WHEN mod(l_partkey, 17) = 0 THEN NULL ELSE concat('1', CAST(1000000 + mod(l_partkey * 7919, 97) AS STRING)) END AS serial_number,
       CASE WHEN mod(l_linenumber + l_partkey, 13) = 0 THEN NULL
            ELSE CAST(mod(CAST(round(l_extendedprice * 100) AS BIGINT), 150000) / 100.0 AS DECIMAL(12,2)) END AS amount_numeric,
       concat('A', CAST(100 + mod(l_suppkey, 3) AS STRING)) AS unit,
       CASE WHEN mod(l_partkey, 19) = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS issue_date,
       CASE WHEN mod(l_partkey, 23) = 0 THEN 'unclear' ELSE NULL END AS image_quality,
       (mod(l_partkey, 29) = 0) AS missing_from_scan
FROM lineitem""",
    "v_batches": """
SELECT o.o_orderkey AS batch_id, c.c_name AS property_name,
       CAST(coalesce(sum(i.amount_numeric), 0) + CASE WHEN mod(o.o_orderkey, 5) = 0 THEN 10 ELSE 0 END AS DECIMAL(14,2)) AS batch_amount,
       count(i.batch_id) + CASE WHEN mod(o.o_orderkey, 7) = 0 THEN 1 ELSE 0 END AS total_items
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN v_instruments i ON i.batch_id = o.o_orderkey
GROUP BY o.o_orderkey, c.c_name""",
    "v_register": """
SELECT batch_id, line_no, unit, amount_numeric, CASE WHEN mod(part_key, 3) = 0 THEN NULL ELSE serial_number END AS serial_number,
       CASE WHEN mod(part_key, 2) = 0 THEN 'regions_deposit_report' ELSE 'yottareal_batch_detail' END AS source
FROM v_instruments WHERE amount_numeric IS NOT NULL""",
    "v_deposits": """
SELECT l_orderkey AS doc_id, l_linenumber AS page_number,
       CASE mod(l_partkey, 4) WHEN 0 THEN 'bank_receipt' WHEN 1 THEN 'deposit_ticket' WHEN 2 THEN 'regions_report' ELSE 'yottareal_report' END AS source_type,
       CAST(mod(l_suppkey, 2) * 100 + 250 AS DECIMAL(14,2)) AS deposit_amount, CAST(mod(l_partkey, 3) AS INT) AS item_count,
       CASE WHEN mod(l_partkey, 5) = 0 THEN NULL ELSE CAST(1000 + mod(l_suppkey, 2) AS STRING) END AS deposit_account,
       CASE WHEN mod(l_partkey, 6) = 0 THEN concat('T', CAST(mod(l_suppkey, 5) AS STRING)) ELSE NULL END AS deposit_transaction,
       CAST(l_shipdate AS DATE) AS deposit_date, l_discount * 10 AS confidence
FROM lineitem""",
    "v_bulk_lines": """
SELECT o.o_orderkey AS invoice_no, l.l_linenumber AS position, c.c_name AS company_name,
       CASE WHEN mod(l.l_suppkey, 6) = 0 THEN NULL ELSE s.s_name END AS property_name, p.p_name AS description,
       CAST(l.l_quantity AS INT) AS quantity, CAST(l.l_extendedprice AS DECIMAL(14,2)) AS total_price
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN part p ON p.p_partkey = l.l_partkey""",
    "v_checks": """
SELECT user_id, event_id, CAST(ts AS DATE) AS pay_date, CAST(value AS DECIMAL(12,2)) AS amount,
       concat(CAST(CAST(ts AS DATE) AS STRING), ': ', CAST(CAST(value AS DECIMAL(12,2)) AS STRING)) AS check_text,
       CASE mod(user_id, 4) WHEN 0 THEN 'weekly' WHEN 1 THEN 'bi-weekly' WHEN 2 THEN 'semi-monthly' ELSE 'monthly' END AS pay_frequency
FROM events WHERE event_type = 'purchase'""",
    "v_session_events": """
SELECT event_id, user_id AS session_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'upload' ELSE 'chat' END AS action, ts FROM events""",
    "v_turns": """
SELECT session_id, turn, query, response FROM (
  SELECT conv_id AS session_id, turn, role, text AS query, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS response,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) x
WHERE role = 'user' AND next_role = 'assistant'""",
    "v_answers": """
SELECT conv_id * 100 + turn AS answer_id,
       concat(text, ' [', CAST(mod(turn, 3) + 2 AS STRING), ' → Page ', CAST(turn + 1 AS STRING), '] and [', CAST(mod(conv_id, 3) + 1 AS STRING), '; ',
              CAST(mod(turn, 3) + 2 AS STRING), '] **x**') AS text
FROM conversations WHERE role = 'assistant'""",
    "v_chunks": """
SELECT vec_id AS chunk_id, mod(vec_id, 40) AS parent_id, CASE WHEN mod(vec_id, 11) = 0 THEN '' ELSE concat('chunk ', CAST(vec_id AS STRING)) END AS content,
       mod(vec_id * 7919, 10007) AS points FROM embeddings""",
    "v_regions": """
SELECT l_orderkey AS page_id, l_linenumber AS region_idx, CAST(mod(l_partkey, 60) AS INT) AS x0, CAST(mod(l_suppkey * 7, 60) AS INT) AS y0,
       CAST(mod(l_partkey, 60) + 30 AS INT) AS x1, CAST(mod(l_suppkey * 7, 60) + 25 AS INT) AS y1, CAST(round(l_discount * 100) AS INT) AS confidence
FROM lineitem""",
    "v_files": """
SELECT doc_id, n_chars * 2000 AS size_bytes,
       concat('d', CAST(doc_id AS STRING), CASE mod(doc_id, 5) WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.exe' WHEN 3 THEN '' ELSE '.heic' END) AS filename
FROM documents""",
    "v_responses": """
SELECT l_orderkey AS doc_id, l_linenumber AS response_no,
       concat(CASE WHEN mod(l_partkey, 2) = 0 THEN '```json ' ELSE '' END, '{"vendor_name": "v', CAST(l_suppkey AS STRING), '", "total": ', CAST(l_linenumber AS STRING),
              CASE WHEN mod(l_partkey, 7) = 0 THEN ',}' WHEN mod(l_partkey, 11) = 0 THEN '' ELSE '}' END, CASE WHEN mod(l_partkey, 2) = 0 THEN ' ```' ELSE '' END) AS body
FROM lineitem""",
    "v_readings": """
SELECT l_orderkey AS item, l_linenumber AS reading_no, CASE WHEN mod(l_partkey, 11) = 0 THEN NULL ELSE CAST((10000 + mod(l_suppkey, 3)) / 100.0 AS DECIMAL(12,2)) END AS amount,
       CAST(60 + 5 * mod(l_partkey, 8) AS DOUBLE) / 100 AS confidence
FROM lineitem""",
    "v_usage": """
SELECT l_orderkey AS doc_id, CASE mod(l_linenumber, 3) WHEN 0 THEN 'recovery_pass' WHEN 1 THEN 'extraction' ELSE 'verification' END AS phase,
       CAST(floor(l_extendedprice) AS BIGINT) AS prompt_tokens, CAST(l_quantity AS BIGINT) AS completion_tokens
FROM lineitem""",
    "v_contexts": """
SELECT lang AS session_id, CASE WHEN source < 'm' THEN 'uploaded' ELSE 'company' END AS source_type, text AS content FROM documents""",
    "v_sources": """
SELECT l_orderkey AS answer_id, l_linenumber AS position, CASE WHEN mod(l_partkey, 9) = 0 THEN NULL ELSE concat('file', CAST(mod(l_suppkey, 4) AS STRING)) END AS filename,
       CASE WHEN mod(l_partkey, 2) = 0 THEN 'uploaded' ELSE 'company' END AS kind
FROM lineitem""",
    "v_docmap": """
SELECT conv_id * 100 + turn AS answer_id, n.doc_num, concat('file', CAST(mod(conv_id + n.doc_num, 2) AS STRING)) AS filename
FROM conversations CROSS JOIN (SELECT 1 AS doc_num UNION ALL SELECT 2 AS doc_num UNION ALL SELECT 3 AS doc_num) n WHERE role = 'assistant'""",
    "v_cells": """
SELECT l_orderkey AS doc_id, mod(l_linenumber, 2) AS table_idx, mod(l_partkey, 3) AS row_index, mod(l_suppkey, 2) AS column_index, l_linenumber AS cell_no,
       CASE WHEN mod(l_partkey, 13) = 0 THEN NULL ELSE concat(' c', CAST(l_partkey AS STRING), ' ') END AS content
FROM lineitem""",
    "v_words": """
SELECT l_orderkey AS page_id, l_linenumber AS word_no, CAST(mod(l_partkey, 64) AS DOUBLE) / 64 AS x, CAST(mod(l_suppkey * 7 + l_linenumber * 11, 64) AS DOUBLE) / 64 AS y,
       CASE mod(l_partkey, 6) WHEN 0 THEN 'PAY' WHEN 1 THEN 'Remitter' WHEN 2 THEN 'exactly' WHEN 3 THEN 'Orders' WHEN 4 THEN 'total' ELSE NULL END AS content
FROM lineitem""",
    "v_scaled_regions": """
SELECT page_id, region_idx, CAST(x0 AS DOUBLE) / 64 AS x0, CAST(y0 AS DOUBLE) / 64 AS y0, CAST(x1 AS DOUBLE) / 64 AS x1, CAST(y1 AS DOUBLE) / 64 AS y1 FROM v_regions""",
    "v_scored_pages": """
SELECT l_orderkey - mod(l_orderkey, 16) AS doc_id, CAST(mod(l_orderkey, 16) * 10 + l_linenumber AS INT) AS page_number,
       CASE mod(l_partkey, 5) WHEN 0 THEN 'instrument' WHEN 1 THEN 'back' WHEN 2 THEN 'batch_report' ELSE 'unknown' END AS kind, CAST(mod(l_suppkey, 6) AS INT) AS front_score,
       CAST(mod(l_partkey, 2) AS INT) AS n_instruments, CASE WHEN mod(l_partkey, 17) = 0 THEN NULL ELSE CAST(mod(l_suppkey * 3 + l_partkey, 12) AS INT) END AS n_regions
FROM lineitem""",
    "v_requests": """
SELECT l_orderkey * 10 + l_linenumber AS request_id, CASE mod(l_linenumber, 2) WHEN 0 THEN 'layout' ELSE 'vision' END AS kind, l_suppkey AS page, mod(l_partkey, 3) AS zoom FROM lineitem""",
    "v_row_reads": """
SELECT l_orderkey AS page_id, l_linenumber AS row_no, CASE mod(l_partkey, 3) WHEN 0 THEN 'text' WHEN 1 THEN 'page' ELSE 'crop' END AS reader,
       CASE WHEN mod(l_partkey, 4) = 0 THEN NULL WHEN mod(l_partkey, 4) = 1 THEN '' ELSE concat('7', CAST(mod(l_suppkey, 2) AS STRING)) END AS serial_number,
       CASE WHEN mod(l_partkey, 5) = 0 THEN NULL ELSE concat('A', CAST(mod(l_suppkey, 2) AS STRING)) END AS account_number,
       CASE WHEN mod(l_partkey, 7) = 0 THEN NULL ELSE CAST(mod(l_suppkey, 3) AS DECIMAL(12,2)) END AS amount_numeric
FROM lineitem""",
    "v_doc_pages": """
SELECT conv_id AS doc_id, turn AS page_number, text FROM conversations""",
    "v_whole_texts": """
SELECT conv_id AS doc_id, CASE mod(conv_id, 3) WHEN 0 THEN max(text) WHEN 1 THEN '' ELSE NULL END AS content FROM conversations GROUP BY conv_id
UNION ALL SELECT -1 - conv_id AS doc_id, NULL AS content FROM conversations GROUP BY conv_id""",
    "v_lines": """
SELECT l_orderkey AS batch_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS BIGINT) AS line,
       l_partkey AS part, l_suppkey AS supp, CAST(l_shipdate AS DATE) AS day
FROM lineitem""",
    "v_observations": """
SELECT batch_id AS page_id, line AS row_no,
       CASE WHEN mod(part, 5) = 0 THEN NULL WHEN mod(part, 3) = 0 THEN concat(left(base, 3), 'O', substr(base, 5)) WHEN mod(part, 7) = 0 THEN concat(left(base, 2), '-', substr(base, 3), 'X') ELSE base END AS serial_number,
       CASE WHEN mod(supp, 3) = 0 THEN NULL WHEN mod(supp, 7) = 0 THEN concat('C021000021C ', substr(base, 1, 6), '9 ', CAST(mod(supp, 90) AS STRING)) ELSE concat('C', base, 'C ', CAST(mod(part, 1000) AS STRING), ' ', left(base, 5)) END AS micr_line,
       CASE WHEN mod(part, 6) = 0 THEN NULL ELSE CAST(100 + 25 * mod(unit + mod(supp, 2), 3) AS DECIMAL(12,2)) END AS amount_numeric,
       CASE mod(supp, 4) WHEN 0 THEN NULL WHEN 1 THEN 'Oak Court' WHEN 2 THEN 'OAK-COURT' ELSE concat('Maple ', CAST(mod(part, 3) AS STRING)) END AS payee_raw,
       CASE WHEN mod(part, 9) = 0 THEN NULL WHEN mod(unit, 2) = 0 THEN 'money_order' ELSE 'check' END AS instrument_type, CASE WHEN mod(part, 4) = 0 THEN NULL ELSE day END AS issue_date,
       CASE WHEN mod(part, 11) = 0 THEN 'one hundred' ELSE NULL END AS amount_words
FROM (SELECT batch_id, line, part, supp, day, CAST(floor((line + 1) / 2) AS BIGINT) AS unit, CAST(10000000 + mod(batch_id * 7919 + CAST(floor((line + 1) / 2) AS BIGINT) * 1047293, 89999999) AS STRING) AS base FROM v_lines) x""",
    "v_fronts": """
SELECT batch_id AS page_id, CASE WHEN mod(batch_id, 3) = 0 THEN 'back' ELSE 'instrument' END AS kind, (mod(batch_id, 5) = 0) AS several_fronts FROM v_lines GROUP BY batch_id""",
    "v_names": """
SELECT l_orderkey AS batch_id, concat(upper(left(p_name, 1)), substr(p_name, 2), CASE WHEN mod(l_partkey, 3) = 0 THEN ' Apartments, LLC' ELSE '' END) AS alias
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE mod(l_suppkey, 2) = 0""",
    "v_payees": """
SELECT batch_id, line AS line_no, CASE mod(supp, 7) WHEN 0 THEN p_name WHEN 1 THEN translate(p_name, 'aeiou', '4e10u') WHEN 2 THEN concat(p_name, ' apartment homes') WHEN 3 THEN replace(p_name, ' ', '') WHEN 4 THEN substr(p_name, 3) WHEN 5 THEN NULL ELSE upper(p_name) END AS payee_raw
FROM v_lines JOIN part ON p_partkey = part""",
    "v_headers": """
SELECT batch_id - mod(batch_id, 4) AS doc_id, mod(batch_id, 4) * 100 + line AS page_number, CASE WHEN mod(part, 3) = 0 THEN concat('B', CAST(mod(supp, 50) AS STRING)) ELSE NULL END AS batch_number,
       CASE WHEN mod(part, 4) = 0 THEN NULL ELSE CAST(mod(supp, 5) * 100 AS DECIMAL(14,2)) END AS batch_amount, CASE WHEN mod(supp, 3) = 0 THEN NULL ELSE CAST(mod(part, 5) AS INT) END AS total_items,
       CASE WHEN mod(supp, 4) = 0 THEN '' WHEN mod(supp, 4) = 1 THEN NULL ELSE concat('Property ', CAST(mod(part, 20) AS STRING)) END AS property_name,
       CASE WHEN mod(part, 6) = 0 THEN concat('9', CAST(mod(supp, 30) AS STRING)) ELSE NULL END AS deposit_account, CASE WHEN mod(part, 5) = 0 THEN day ELSE NULL END AS deposit_date,
       CASE WHEN mod(part, 7) < 2 THEN CAST(mod(supp, 9) AS DECIMAL(14,2)) ELSE NULL END AS deposit_amount
FROM v_lines""",
    "v_placed_words": """
SELECT batch_id AS page_id, line AS word_no, CAST(mod(part, 64) AS DOUBLE) / 64 AS x0, CAST(mod(supp * 7 + line * 11, 64) AS DOUBLE) / 64 AS y0, CAST(mod(part, 64) + 1 + mod(supp, 3) AS DOUBLE) / 64 AS x1,
       CAST(mod(supp * 7 + line * 11, 64) + 1 AS DOUBLE) / 64 AS y1, CAST(mod(part, 5) AS DOUBLE) / 4 AS confidence,
       CASE mod(part + supp, 9) WHEN 0 THEN 'Pay to the order of' WHEN 1 THEN concat('Check No ', CAST(supp AS STRING)) WHEN 2 THEN concat('$ ', CAST(part AS STRING), '.00') WHEN 3 THEN 'one hundred dollars' WHEN 4 THEN CAST(100000 + part AS STRING)
            WHEN 5 THEN concat(CAST(mod(part, 900) AS STRING), '.25') WHEN 6 THEN 'For deposit only' WHEN 7 THEN 'Remitter' ELSE 'the' END AS content
FROM v_lines""",
    "v_boxes": """
SELECT batch_id AS page_id, line AS region_idx, CAST(mod(part, 40) AS DOUBLE) / 64 AS x0, CAST(mod(supp * 7, 40) AS DOUBLE) / 64 AS y0, CAST(mod(part, 40) + 12 + mod(supp, 13) AS DOUBLE) / 64 AS x1,
       CAST(mod(supp * 7, 40) + 10 + mod(part, 15) AS DOUBLE) / 64 AS y1, CAST(mod(part, 8) AS DOUBLE) / 8 AS confidence
FROM v_lines""",
    "v_hashes": """
SELECT mod(vec_id, 20) AS page_id, vec_id AS item, CASE WHEN mod(vec_id, 17) = 0 THEN NULL WHEN mod(vec_id, 7) = 0 THEN 1023
            ELSE mod(mod(vec_id, 60) * 7046029254386353, 1000003) * 1048576 + CASE mod(vec_id, 8) WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 7 WHEN 3 THEN 63 WHEN 4 THEN 255 WHEN 5 THEN 4095 WHEN 6 THEN 65535 ELSE 73 END END AS hash
FROM embeddings""",
    "v_slips": """
SELECT x.batch_id AS doc_id, line AS row_no, CAST(1 + mod(part, 4) AS INT) AS page_number,
       CASE mod(part, 6) WHEN 0 THEN 'bank_receipt' WHEN 1 THEN 'deposit_ticket' WHEN 2 THEN 'regions_report' WHEN 3 THEN 'handwritten_ocr' WHEN 4 THEN 'summary_page' ELSE 'bank_receipt' END AS source_type,
       CASE WHEN mod(part, 3) = 0 THEN NULL ELSE 'First-Bank' END AS source_system,
       CASE WHEN mod(supp, 5) = 0 THEN NULL WHEN mod(supp, 5) < 3 THEN t ELSE CAST(25 * mod(part, 12) AS DECIMAL(14,2)) END AS deposit_amount, CAST(CASE WHEN mod(supp, 3) = 0 THEN 0 WHEN mod(supp, 3) = 1 THEN n ELSE mod(part, 4) END AS INT) AS item_count,
       CASE WHEN mod(part, 5) > 1 THEN NULL ELSE concat('x', CAST(1000 + mod(supp, 2) AS STRING)) END AS deposit_account, day AS deposit_date, CASE WHEN mod(part, 6) = 0 THEN concat('T-', CAST(mod(supp, 5) AS STRING)) ELSE NULL END AS deposit_transaction, CAST(mod(part, 5) AS DOUBLE) / 4 AS confidence
FROM v_lines x JOIN (SELECT batch_id, count(*) AS n, CAST(sum(CASE WHEN row_no < 50 THEN amount_numeric END) AS DECIMAL(14,2)) AS t FROM v_seen GROUP BY batch_id) s ON s.batch_id = x.batch_id
WHERE mod(part, 4) = 0""",
    "v_heads": """
SELECT o_orderkey AS batch_id, CAST(3 + mod(o_custkey, 2) AS INT) AS total_pages, CASE WHEN mod(o_custkey, 4) = 0 THEN concat('B', CAST(o_custkey AS STRING)) ELSE NULL END AS batch_number,
       CASE mod(o_custkey, 5) WHEN 0 THEN 'Regions Bank' WHEN 1 THEN 'Deposit Detail Report' ELSE NULL END AS source_system, CASE WHEN mod(o_orderkey, 3) = 0 THEN NULL ELSE CAST(25 * mod(o_custkey, 30) + 100 AS DECIMAL(14,2)) END AS batch_amount,
       CASE WHEN mod(o_orderkey, 4) = 0 THEN NULL ELSE CAST(mod(o_custkey, 6) AS INT) END AS total_items
FROM orders""",
    "v_named_pages": """
SELECT page_id, CASE WHEN mod(page_id, 7) = 0 THEN concat('Title ', CAST(page_id AS STRING)) WHEN mod(page_id, 7) = 1 THEN '  ' ELSE NULL END AS title,
       CASE WHEN mod(page_id, 5) = 0 THEN concat('a/b c/', CAST(page_id AS STRING), '.pdf') WHEN mod(page_id, 5) = 1 THEN 'plain.txt' WHEN mod(page_id, 5) = 2 THEN '' ELSE NULL END AS filepath,
       CASE WHEN mod(page_id, 3) = 0 THEN concat(url, '/last%20one+%C3%A9.pdf;v=', CAST(page_id AS STRING), '?q=1') ELSE url END AS parent_id
FROM pages""",
    "v_named_chunks": """
SELECT e.vec_id AS chunk_id, CASE WHEN mod(e.vec_id, 9) = 0 THEN NULL ELSE concat('https://h.example/c/doc%20', CAST(mod(e.vec_id, 12) AS STRING), '.pdf?x=1') END AS parent_id, CASE WHEN mod(e.vec_id, 12) = 5 THEN 'Five' ELSE NULL END AS title,
       CASE WHEN mod(e.vec_id, 9) = 0 THEN concat('x/', CAST(e.vec_id AS STRING)) ELSE NULL END AS filepath, d.text AS content, e.embedding AS vector
FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id""",
    "v_questions": """
SELECT b.item_id AS query_id, b.text, e.embedding AS vector FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id""",
    "v_first_reads": """
SELECT batch_id, line AS row_no, CAST(CASE WHEN mod(part, 13) = 0 THEN NULL ELSE mod(part, 5) END AS INT) AS page_number, 3 AS total_pages, CASE WHEN mod(part, 11) = 0 THEN NULL ELSE CAST(50 + 25 * mod(part, 6) AS DECIMAL(12,2)) END AS amount_numeric,
       CASE WHEN mod(supp, 2) = 0 THEN NULL ELSE CAST(50 + 25 * mod(part + mod(supp, 4), 6) AS DECIMAL(12,2)) END AS words_amount, CASE WHEN mod(part, 7) = 0 THEN 'unclear' ELSE NULL END AS image_quality, (mod(part, 9) = 0) AS conflict,
       CASE mod(supp, 6) WHEN 0 THEN 'oak court' WHEN 1 THEN 'Oak Court' WHEN 2 THEN 'First Bank' WHEN 3 THEN NULL WHEN 4 THEN 'Maple Ridge Homes' ELSE 'Pay to the order of' END AS payee_raw
FROM v_lines""",
    "v_second_reads": """
SELECT batch_id, line AS row_no, CASE WHEN mod(part, 10) = 0 THEN NULL ELSE CAST(50 + 25 * mod(part + mod(supp, 4), 6) AS DECIMAL(12,2)) END AS amount, CAST(60 + 5 * mod(supp, 8) AS DOUBLE) / 100 AS confidence, (mod(part, 4) > 0) AS agree,
       CASE WHEN mod(supp, 3) = 0 THEN 'both' ELSE 'numeric_box' END AS source
FROM v_lines WHERE mod(part, 8) > 0""",
    "v_totals": """
SELECT batch_id, CASE WHEN mod(batch_id, 3) = 0 THEN NULL ELSE count(*) + CASE WHEN mod(batch_id, 4) = 1 THEN 1 ELSE 0 END END AS expected_count,
       CASE WHEN mod(batch_id, 7) = 0 THEN NULL ELSE CAST(sum(50 + 25 * mod(part + mod(supp, 4), 6)) AS DECIMAL(14,2)) END AS deposit_total
FROM v_lines GROUP BY batch_id""",
    "v_bodies": """
SELECT batch_id AS doc_id, line AS response_no, concat(CASE mod(part, 4) WHEN 0 THEN '```json ' WHEN 1 THEN 'Here it is: ' ELSE '' END,
         CASE mod(supp, 7) WHEN 0 THEN concat('{"vendor_name": "v', CAST(supp AS STRING), '" "total": 3}') WHEN 1 THEN concat('{"total": ', CAST(line AS STRING), ', "vendor_name": "ab",}') WHEN 2 THEN '[1, 2]' WHEN 3 THEN '' WHEN 4 THEN '{"vendor_name": {"x": [1,]}, "total": 5'
              ELSE concat('{"vendor_name": "v', CAST(supp AS STRING), '", "total": ', CAST(line AS STRING), ', "items": [1, 2', CASE WHEN mod(part, 3) = 0 THEN ', ]}' ELSE ']}' END) END,
         CASE mod(part, 4) WHEN 0 THEN ' ```' WHEN 1 THEN ' as asked.' ELSE '' END) AS body
FROM v_lines""",
    "v_cited": """
SELECT conv_id * 100 + turn AS answer_id, concat(' ', text, ' [', CAST(mod(turn, 3) + 2 AS STRING), ' → Page ', CAST(turn + 1 AS STRING), '] **and** [', CAST(mod(conv_id, 3) + 1 AS STRING), '; ', CAST(mod(turn, 3) + 2 AS STRING), '→ Page 7, 3 ]',
       CASE WHEN mod(conv_id, 4) = 0 THEN ' [N → Page X] [n] [N → Page 12]' ELSE ' [1]' END, ' ') AS text
FROM conversations""",
    "v_cited_docs": """
SELECT conv_id * 100 + turn AS answer_id, n.doc_num, concat('file', CAST(mod(conv_id + n.doc_num, 2) AS STRING)) AS filename, CASE WHEN mod(conv_id + n.doc_num, 3) = 0 THEN 'uploaded' ELSE 'company' END AS kind,
       CASE WHEN mod(turn, 2) = 0 THEN NULL ELSE CAST(turn + 3 AS INT) END AS first_page
FROM conversations CROSS JOIN (SELECT 1 AS doc_num UNION ALL SELECT 2 AS doc_num UNION ALL SELECT 3 AS doc_num) n WHERE mod(conv_id, 6) < 5""",
    "v_turned": """
SELECT batch_id - mod(batch_id, 3) AS page_id, CAST(CASE mod(part, 4) WHEN 0 THEN 0 WHEN 1 THEN 180 WHEN 2 THEN 90 ELSE 270 END AS INT) AS orientation, mod(batch_id, 3) * 100 + line AS row_no,
       CASE WHEN mod(part, 11) = 0 THEN NULL ELSE CAST(50 + 25 * mod(part, 6) AS DECIMAL(12,2)) END AS amount
FROM v_lines""",
    "v_turned_controls": """
SELECT batch_id AS page_id, CASE WHEN mod(batch_id, 4) = 0 THEN NULL ELSE mod(min(part), 5) END AS expected_count, CASE WHEN mod(batch_id, 5) = 0 THEN NULL ELSE CAST(25 * mod(min(supp), 24) AS DECIMAL(14,2)) END AS expected_total
FROM v_lines WHERE mod(batch_id, 3) = 0 GROUP BY batch_id""",
    "v_candidates": """
SELECT batch_id - mod(batch_id, 4) AS doc_id, mod(batch_id, 4) * 100 + line AS row_no, CAST(1 + mod(part, 9) AS INT) AS page_number,
       CASE mod(part, 7) WHEN 0 THEN 'bank_receipt' WHEN 1 THEN 'deposit_ticket' WHEN 2 THEN 'regions_report' WHEN 3 THEN CASE WHEN mod(supp, 4) = 0 THEN 'yottareal_report' ELSE 'handwritten_ocr' END
            WHEN 4 THEN 'summary_page' WHEN 5 THEN 'bank_receipt' ELSE 'metadata' END AS source_type,
       CASE WHEN mod(part, 3) = 0 THEN NULL WHEN mod(part, 3) = 1 THEN 'Regions Bank' ELSE 'First-Bank' END AS source_system,
       CASE WHEN mod(supp, 6) = 0 THEN NULL ELSE CAST(CASE WHEN mod(supp, 6) = 1 THEN 250 WHEN mod(supp, 6) = 2 THEN 250.01 WHEN mod(supp, 6) = 3 THEN 2500 WHEN mod(supp, 6) = 4 THEN 1900 ELSE 9000 END AS DECIMAL(14,2)) END AS deposit_amount,
       CAST(mod(part, 4) AS INT) AS item_count, CASE WHEN mod(part, 5) > 1 THEN NULL ELSE concat('x', CAST(1000 + mod(supp, 2) AS STRING)) END AS deposit_account,
       CASE WHEN mod(part, 8) = 0 THEN NULL ELSE CAST(concat('2024-01-0', CAST(1 + mod(supp, 3) AS STRING)) AS DATE) END AS deposit_date,
       CASE WHEN mod(part, 6) = 0 THEN concat('T-', CAST(mod(supp, 5) AS STRING)) ELSE NULL END AS deposit_transaction, CAST(mod(part, 5) AS DOUBLE) / 4 AS confidence
FROM v_lines""",
    "v_seen": """
SELECT batch_id, row_no, CASE WHEN mod(part, 41) = 0 THEN 'vision_register_items' ELSE 'scan' END AS source,
       CAST(CASE WHEN mod(part, 31) = 0 THEN 90 ELSE 1 + floor((line - 1) / 2) END AS INT) AS page_number, CAST(NULL AS INT) AS item_no,
       CASE WHEN mod(part, 5) = 0 THEN NULL ELSE concat('1', CAST(1000000 + mod(part * 7919, 9973) AS STRING)) END AS serial_number,
       CASE WHEN mod(supp, 4) = 0 THEN concat('00', CAST(70000000 + supp AS STRING)) ELSE NULL END AS micr_line, CAST(NULL AS STRING) AS check_number,
       concat('A', CAST(100 + mod(supp, 3) AS STRING)) AS unit,
       CASE WHEN mod(line + part, 13) = 0 THEN NULL ELSE CAST(50 + 25 * mod(part, 6) AS DECIMAL(12,2)) END AS amount_numeric,
       CASE WHEN mod(supp, 3) = 0 THEN 'fifty' ELSE NULL END AS amount_words, CASE WHEN mod(part, 3) = 0 THEN 'Oak Court' ELSE NULL END AS payee_raw,
       CASE WHEN mod(part, 4) <> 0 THEN NULL ELSE day END AS issue_date, CASE WHEN mod(part, 23) = 0 THEN 'unclear' ELSE NULL END AS image_quality,
       (mod(part, 29) = 0) AS missing_from_scan, CAST(NULL AS INT) AS slip_page, CAST(NULL AS INT) AS report_page
FROM (SELECT batch_id, line AS row_no, line, part, supp, day FROM v_lines UNION ALL SELECT batch_id, line + 50, line, part, supp, day FROM v_lines WHERE mod(part, 10) = 0) x""",
    "v_listed": """
SELECT batch_id, line + 100 AS row_no,
       CASE mod(part, 5) WHEN 0 THEN 'regions_deposit_report' WHEN 1 THEN 'transaction_detail_report' WHEN 2 THEN 'vision_register_items' ELSE 'yottareal_batch_detail' END AS source,
       CAST(CASE WHEN mod(part, 7) = 0 THEN 90 ELSE 2 END AS INT) AS page_number, CASE WHEN mod(part, 6) = 0 THEN NULL ELSE CAST(8 - line AS INT) END AS item_no,
       CASE WHEN mod(part, 3) = 0 THEN concat('1', CAST(1000000 + mod(part * 7919, 9973) AS STRING)) WHEN mod(part, 3) = 1 THEN concat('5', CAST(part AS STRING)) ELSE NULL END AS serial_number,
       CASE WHEN mod(supp, 5) = 0 THEN concat('000', CAST(70000000 + supp AS STRING)) ELSE NULL END AS micr_line, CAST(NULL AS STRING) AS check_number,
       CASE WHEN mod(supp, 2) = 0 THEN NULL ELSE concat('A', CAST(100 + mod(supp, 3) AS STRING)) END AS unit,
       CASE WHEN mod(line + part, 17) = 0 THEN NULL ELSE CAST(50 + 25 * mod(part, 6) AS DECIMAL(12,2)) END AS amount_numeric,
       CAST(NULL AS STRING) AS amount_words, CAST(NULL AS STRING) AS payee_raw, CAST(NULL AS DATE) AS issue_date, CAST(NULL AS STRING) AS image_quality, CAST(NULL AS BOOLEAN) AS missing_from_scan,
       CASE WHEN mod(part, 5) > 2 THEN 3 ELSE NULL END AS slip_page, CAST(CASE WHEN mod(part, 5) < 2 THEN 4 ELSE NULL END AS INT) AS report_page
FROM v_lines WHERE mod(supp, 3) > 0""",
    "v_controls": """
SELECT o.o_orderkey AS batch_id, CAST(3 + mod(o.o_custkey, 2) AS INT) AS total_pages, CASE WHEN mod(o.o_custkey, 7) = 0 THEN NULL WHEN mod(o.o_custkey, 7) = 1 THEN r.n WHEN mod(o.o_custkey, 7) < 5 THEN mod(o.o_custkey, 7) ELSE s.n END AS expected_count,
       CASE WHEN mod(o.o_orderkey, 5) = 0 THEN NULL WHEN mod(o.o_orderkey, 5) = 1 THEN s.t WHEN mod(o.o_custkey, 7) = 1 THEN r.t WHEN mod(o.o_orderkey, 5) = 2 THEN s.part ELSE CAST(25 * mod(o.o_custkey, 30) + 100 AS DECIMAL(14,2)) END AS deposit_total
FROM orders o LEFT JOIN (SELECT batch_id, count(amount_numeric) AS n, CAST(sum(amount_numeric) AS DECIMAL(14,2)) AS t, CAST(sum(CASE WHEN row_no < 4 THEN amount_numeric END) AS DECIMAL(14,2)) AS part FROM v_seen GROUP BY batch_id) s ON s.batch_id = o.o_orderkey
LEFT JOIN (SELECT batch_id, count(*) AS n, CAST(sum(amount_numeric) AS DECIMAL(14,2)) AS t FROM v_listed WHERE source = 'yottareal_batch_detail' AND page_number = 2 GROUP BY batch_id) r ON r.batch_id = o.o_orderkey""",
}
_NEEDS = {"v_turned": ["v_lines"], "v_turned_controls": ["v_lines"], "v_bodies": ["v_lines"], "v_first_reads": ["v_lines"], "v_second_reads": ["v_lines"], "v_totals": ["v_lines"], "v_slips": ["v_lines", "v_seen"], "v_placed_words": ["v_lines"], "v_boxes": ["v_lines"], "v_observations": ["v_lines"], "v_fronts": ["v_lines"], "v_payees": ["v_lines"], "v_headers": ["v_lines"], "v_candidates": ["v_lines"], "v_seen": ["v_lines"], "v_listed": ["v_lines"], "v_controls": ["v_lines", "v_seen", "v_listed"], "v_batches": ["v_instruments"], "v_register": ["v_instruments"], "v_scaled_regions": ["v_regions"]}


def views(spark: SparkSession, sf_dir: str, names: list[str]) -> list[DataFrame]:
    """Tables, given or derived (v_). Lines that several derived ones read are numbered and written once; each of these would deal and sort all of them."""
    many = sum("v_lines" in _NEEDS.get(n, []) for n in names) > 1
    lines = written(view(spark, sf_dir, "v_lines")) if many else None
    return [view(spark, sf_dir, n, lines) if n.startswith("v_") else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def view(spark: SparkSession, sf_dir: str, name: str, lines: DataFrame | None = None) -> DataFrame:
    """One derived table; the given tables it reads become temporary views, and so does v_lines, if it was made before (``lines``)."""
    text = VIEWS[name] + "".join(VIEWS[n] for n in _NEEDS.get(name, []))
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for need in _NEEDS.get(name, []):
        (spark.sql(VIEWS[need]) if lines is None or need != "v_lines" else lines).createOrReplaceTempView(need)
    return spark.sql(VIEWS[name])


def with_views(sql: str) -> str:
    """The SQL, after WITH and the views that it names."""
    names = [n for n in VIEWS if n in sql]
    names = [*dict.fromkeys(x for n in names for x in [*_NEEDS.get(n, []), n])]
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH RECURSIVE {head}\n{sql.lstrip()}" if names else sql.lstrip()
