"""Fixture views: the process-record tables expressed over the shared test tables.

The same SQL text runs in Spark and in DuckDB, so both engines see identical
inputs.  Every view is a projection of a base table (plus partitioned
windows), so its size grows with the base table.

``fixture(spark, sf_dir, name)`` gives a Spark DataFrame;
``with_fixtures(sql)`` prefixes an oracle query with the ``WITH`` clauses of
the fixture views it mentions (DuckDB has the base tables registered).
"""

from __future__ import annotations

import re
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")

# Deterministic "now" for every recent-activity query.
AS_OF = "2024-01-30T23:59:59"

_ROW_ID = ("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, "
           "l_suppkey, l_extendedprice, l_shipdate)")

FIXTURE_SQL: dict[str, str] = {
    "fx_runs": """
SELECT o_orderkey AS id,
 CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('R', cast(o_orderkey as string)) END AS run_number,
 CASE WHEN o_orderkey % 77 = 0 THEN '  ' ELSE concat('B', cast(o_custkey as string)) END AS batch_number,
 CASE WHEN o_orderkey % 20 IN (0,1,2) THEN concat('BL', cast(cast(floor(o_orderkey / 60.0) as int) as string)) ELSE '' END AS blend_number,
 CASE WHEN o_orderkey % 20 IN (10,11) THEN concat('SP', cast(cast(floor(o_orderkey / 60.0) as int) as string)) ELSE '' END AS split_batch_number,
 CASE WHEN o_orderkey % 60 = 0 THEN 'blend' WHEN o_orderkey % 60 = 10 THEN 'split' WHEN o_orderkey % 9 = 0 THEN ' ' WHEN o_orderkey % 9 = 1 THEN NULL ELSE 'standard' END AS batch_type,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS product_name,
 CASE WHEN o_orderstatus = 'O' THEN 'Open' ELSE 'Complete' END AS status,
 concat(substr(cast(o_orderdate as string),1,10),'T08:00:00') AS created_at,
 concat(substr(cast(o_orderdate as string),1,10),'T',lpad(cast(9 + o_orderkey % 15 as string),2,'0'),':',lpad(cast(o_custkey % 60 as string),2,'0'),':',lpad(cast(o_orderkey % 60 as string),2,'0')) AS updated_at
FROM orders""",
    "fx_entries": """
SELECT event_id AS record_id,
 CASE event_type WHEN 'click' THEN 'extraction_entries' WHEN 'view' THEN 'filtration_entries' WHEN 'purchase' THEN 'evaporation_entries' ELSE 'sheet_entries' END AS entry_table,
 CASE event_type WHEN 'signup' THEN 'concentration' WHEN 'error' THEN 'clarifier' ELSE '' END AS stage_key,
 CASE event_type WHEN 'click' THEN 'Extraction' WHEN 'view' THEN 'Filtration' WHEN 'purchase' THEN 'Evaporation' WHEN 'signup' THEN 'Concentration' ELSE 'Clarifier' END AS section,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS run_id,
 concat('E', cast(user_id % 40 as string)) AS employee,
 CASE WHEN event_id % 6 = 0 THEN NULL ELSE concat('op', cast(user_id % 9 as string)) END AS operator_initials,
 CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 10 = 1 THEN NULL ELSE substr(cast(ts as string),1,10) END AS entry_date,
 CASE WHEN event_id % 8 = 0 THEN '' ELSE substr(cast(ts as string),12,5) END AS entry_time,
 replace(substr(cast(ts as string),1,19),' ','T') AS created_at,
 CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN NULL ELSE concat('note ', cast(event_id as string)) END AS comments,
 CASE WHEN event_id % 3 = 0 THEN '' ELSE '17:00' END AS end_label,
 CASE WHEN value < 20 THEN 'Draft' WHEN event_id % 3 = 0 THEN NULL ELSE 'Complete' END AS completion_status,
 CASE WHEN event_id % 50 = 0 THEN 'not json' ELSE concat('{"entry_date":"', substr(cast(ts as string),1,10), '","concentration_1_time":"', substr(cast(ts as string),12,5), '","concentration_1_product_ri":"', cast(cast(floor(value) as int) as string), '.5 %","concentration_2_gcv":"', CASE WHEN event_id % 2 = 0 THEN '' ELSE cast(event_id % 97 as string) END, '","rinse_comments":"', CASE WHEN event_id % 3 = 0 THEN 'foam' ELSE '' END, '"}') END AS payload_json
FROM events""",
    "fx_filtration_rows": f"""
SELECT l_orderkey * 100 + {_ROW_ID} AS id,
 l_orderkey AS filtration_entry_id, concat('cycle', cast((l_linenumber - 1) % 6 + 1 as string)) AS row_group, l_partkey % 12 + 1 AS row_no,
 CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE concat(lpad(cast(l_suppkey % 24 as string),2,'0'),':',lpad(cast(l_partkey % 60 as string),2,'0')) END AS row_time,
 concat(cast(cast(l_quantity as int) as string),' gpm') AS fic1_gpm,
 CASE WHEN l_suppkey % 7 = 0 THEN 'n/a' ELSE concat('1,', lpad(cast(l_partkey % 1000 as string),3,'0'), '.5') END AS perm_total,
 CASE WHEN l_returnflag = 'A' THEN '' ELSE cast(cast(l_discount * 100 as int) as string) END AS retentate_ri
FROM lineitem""",
    "fx_evaporation_rows": f"""
SELECT l_orderkey * 100 + {_ROW_ID} AS id,
 l_orderkey AS evaporation_entry_id, l_linenumber AS row_no, CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE concat(lpad(cast(l_suppkey % 24 as string),2,'0'),':30') END AS row_time,
 concat(cast(cast(l_quantity as int) as string),'.25') AS feed_rate, CASE WHEN l_linestatus = 'F' THEN 'n/a' ELSE cast(cast(l_tax * 100 as int) as string) END AS row_vacuum
FROM lineitem""",
    "fx_users": """
SELECT c_custkey AS id, concat('E', cast(c_custkey as string)) AS employee_number, c_name AS full_name,
 CASE WHEN c_custkey = 0 THEN 'admin' ELSE 'operator' END AS role, CASE WHEN c_custkey % 5 = 4 THEN 0 ELSE 1 END AS active,
 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE substr(c_name,10,3) END AS initials
FROM customer""",
    "fx_submits": """
SELECT event_id, user_id AS run_id,
 CASE event_type WHEN 'click' THEN 'concentration' WHEN 'view' THEN 'reconcentration' WHEN 'purchase' THEN 'centrifuge' WHEN 'signup' THEN 'anion_exchange' ELSE 'carbon_treatment' END AS stage_key,
 CASE WHEN event_id % 7 = 0 THEN 'Complete' ELSE 'Draft' END AS save_mode,
 replace(substr(cast(ts as string),1,19),' ','T') AS submitted_at, concat('E', cast(user_id % 40 as string)) AS employee
FROM events""",
    "fx_void_log": """
SELECT event_id, user_id AS run_id,
 CASE event_type WHEN 'click' THEN 'concentration' WHEN 'view' THEN 'reconcentration' WHEN 'purchase' THEN 'centrifuge' WHEN 'signup' THEN 'anion_exchange' ELSE 'carbon_treatment' END AS stage_key,
 CASE WHEN event_id % 7 = 0 THEN 'complete_save' ELSE 'toggle' END AS action,
 concat('E', cast(user_id % 40 as string)) AS actor, replace(substr(cast(ts as string),1,19),' ','T') AS logged_at
FROM events""",
    "fx_corrections": f"""
SELECT l_orderkey AS submission_id,
 concat('f', cast({_ROW_ID} as string)) AS field_name,
 concat(' ', cast(cast(l_quantity as int) as string)) AS old_value,
 cast(cast(l_quantity as int) + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END as string) AS new_value,
 CASE WHEN l_suppkey % 40 = 0 THEN ' ' ELSE concat('i', cast(l_suppkey % 9 as string)) END AS initials
FROM lineitem""",
    # ---- views added during the build, same style ----
    # Entry columns the shared shape lacks: wide extraction readings, evaporation
    # header, photo paths, stage titles and run-linked sheet payloads.
    "fx_entries_wide": """
SELECT e.*,
 CASE WHEN record_id % 4 = 0 THEN '' ELSE concat(cast(record_id % 90 + 10 as string), ' rpm') END AS psf1_speed,
 CASE WHEN record_id % 5 = 0 THEN 'n/a' ELSE concat(cast(record_id % 100 as string), '%') END AS psf1_load,
 CASE WHEN record_id % 6 = 0 THEN NULL ELSE concat('-', cast(record_id % 15 as string), ' psi') END AS press_blowback,
 CASE WHEN record_id % 3 = 0 THEN '' ELSE concat('1,', lpad(cast(record_id % 1000 as string),3,'0'), '.25') END AS chip_bin_steam,
 CASE WHEN record_id % 7 = 0 THEN '' ELSE cast(record_id % 4 + 1 as string) END AS evaporator_no,
 CASE WHEN record_id % 11 = 0 THEN '' ELSE concat('L', cast(record_id % 3 as string)) END AS location,
 CASE WHEN record_id % 9 = 0 THEN concat('/static/uploads/p', cast(record_id as string), '.jpg, static/uploads/q', cast(record_id % 5 as string), '.png') WHEN record_id % 9 = 1 THEN concat('notes.txt', chr(10), '/static/uploads/p', cast(record_id as string), '.jpg') ELSE '' END AS photo_path,
 CASE entry_table WHEN 'sheet_entries' THEN section ELSE '' END AS stage_title
FROM fx_entries e""",
    # Blend / split requests (O-STATE-7/8): a label and a set of source runs.
    "fx_group_requests": """
SELECT event_id AS request_id,
 CASE WHEN event_id % 2 = 0 THEN 'blend' ELSE 'split' END AS action,
 concat(CASE WHEN event_id % 2 = 0 THEN 'BL' ELSE 'SP' END, cast(cast(floor(user_id / 3.0) as int) as string)) AS group_label,
 user_id AS source_run_id,
 replace(substr(cast(ts as string),1,19),' ','T') AS requested_at,
 concat('E', cast(user_id % 40 as string)) AS employee
FROM events""",
    # Runs whose numbers are labels of groups: per label a blend or split run of that label, and a second run of that batch number.
    "fx_group_runs": """
SELECT o_orderkey AS id,
 CASE WHEN o_orderkey % 5 = 0 THEN concat('G', cast(cast(floor(o_orderkey / 5.0) as int) as string)) ELSE concat('R', cast(o_orderkey as string)) END AS run_number,
 CASE WHEN o_orderkey % 5 < 2 THEN concat('G', cast(cast(floor(o_orderkey / 5.0) as int) as string)) ELSE concat('B', cast(o_custkey as string)) END AS batch_number,
 CASE WHEN o_orderkey % 10 IN (0, 1) THEN concat('G', cast(cast(floor(o_orderkey / 5.0) as int) as string)) ELSE '' END AS blend_number,
 CASE WHEN o_orderkey % 10 IN (5, 6) THEN concat('G', cast(cast(floor(o_orderkey / 5.0) as int) as string)) ELSE '' END AS split_batch_number,
 CASE WHEN o_orderkey % 10 IN (0, 1) THEN 'blend' WHEN o_orderkey % 10 IN (5, 6) THEN 'split' WHEN o_orderkey % 9 = 1 THEN NULL ELSE 'standard' END AS batch_type,
 o_orderpriority AS product_name, CASE WHEN o_orderstatus = 'O' THEN 'Open' ELSE 'Complete' END AS status,
 concat(substr(cast(o_orderdate as string),1,10),'T08:00:00') AS created_at,
 concat(substr(cast(o_orderdate as string),1,10),'T09:00:00') AS updated_at
FROM orders""",
    # Blend / split requests of several source runs (comma-joined ids, some repeated, unknown or not positive), some of them group runs.
    "fx_multi_requests": """
SELECT event_id AS request_id,
 CASE WHEN (event_id % 11 = 0) = ((event_id + user_id) % 2 = 0) THEN 'split' ELSE 'blend' END AS action,
 CASE WHEN event_id % 50 = 7 THEN ' ' WHEN event_id % 4 = 3 THEN concat(' N', cast((event_id + user_id) % 300 as string)) ELSE concat('G', cast((event_id + user_id) % 300 as string)) END AS group_label,
 concat(cast(CASE WHEN event_id % 41 = 0 THEN 5 * (event_id * 7 % 300) ELSE 5 * (event_id * 13 % 290) + 2 + event_id % 3 END as string),
  CASE WHEN event_id % 3 = 0 THEN concat(',', cast(5 * (event_id * 29 % 290) + 2 as string)) ELSE '' END,
  CASE WHEN event_id % 29 = 0 THEN ',999999999,-3,0' ELSE '' END,
  CASE WHEN event_id % 37 = 0 THEN concat(',', cast(5 * (event_id * 11 % 300) + 1 as string)) ELSE '' END) AS source_ids,
 CASE WHEN event_id % 6 = 0 THEN 5 * (event_id * 29 % 290) + 2 ELSE NULL END AS source_run_id,
 replace(substr(cast(ts as string),1,19),' ','T') AS requested_at,
 concat('E', cast(user_id % 40 as string)) AS employee
FROM events""",
    # Create-run requests (O-STATE-11): free-text labels, some repeated, some open already.
    "fx_run_requests": """
SELECT event_id AS request_id,
 CASE WHEN event_id % 3 = 0 THEN concat('r', cast(user_id * 7 as string)) WHEN event_id % 3 = 1 THEN concat(' R', cast(event_id % 500 as string), ' ') ELSE concat('N', cast(user_id as string)) END AS run_label,
 CASE WHEN event_id % 4 = 0 THEN 'P2' ELSE 'P1' END AS product_name,
 replace(substr(cast(ts as string),1,19),' ','T') AS requested_at
FROM events""",
    # Saved field corrections (field_change_log).
    "fx_field_changes": f"""
SELECT l_orderkey * 100 + {_ROW_ID} AS id,
 CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_orderkey % 200 END AS run_id,
 CASE l_linenumber % 4 WHEN 0 THEN 'extraction_entries' WHEN 1 THEN 'filtration_entries' WHEN 2 THEN 'evaporation_entries' ELSE 'sheet_entries' END AS entry_table,
 l_orderkey AS record_id,
 concat('f', cast(l_linenumber as string)) AS field_name,
 cast(cast(l_quantity as int) as string) AS original_value,
 CASE WHEN l_partkey % 4 = 0 THEN '' ELSE cast(cast(l_quantity as int) + 1 as string) END AS corrected_value,
 cast(cast(l_quantity as int) + 1 as string) AS field_value,
 concat('i', cast(l_suppkey % 9 as string)) AS change_initials,
 replace(substr(cast(l_shipdate as string),1,19),' ','T') AS created_at
FROM lineitem""",
    # Run header edits (O-STATE-10) and finalize requests (O-STATE-5).
    "fx_run_edits": """
SELECT event_id AS edit_id, user_id AS run_id,
 CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(' R', cast(user_id as string), '-', cast(event_id % 3 as string), ' ') END AS run_number,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('P', cast(event_id % 7 as string)) END AS product_name,
 concat(' n', cast(event_id % 3 as string)) AS notes, CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'fe' END AS final_edit_initials,
 concat('why', cast(event_id % 2 as string)) AS final_edit_notes,
 replace(substr(cast(ts as string),1,19),' ','T') AS edited_at
FROM events""",
    "fx_finalize_requests": """
SELECT event_id AS request_id, user_id AS run_id,
 CASE WHEN event_id % 2 = 0 THEN 'review' ELSE 'quick' END AS path,
 concat('E', cast(user_id % 40 as string)) AS employee,
 replace(substr(cast(ts as string),1,19),' ','T') AS requested_at
FROM events""",
    # Submitted forms as JSON text: control keys, header fields, dynamic
    # filtration cycle cells (one of them at a varying cycle/row), cycle
    # summaries and the three evaporation rows.
    "fx_forms": """
SELECT event_id AS form_id, replace(substr(cast(ts as string),1,19),' ','T') AS submitted_at,
 concat('{"__session_signature_pad":"x","__change__entry_date":"OP', cast(user_id % 9 as string),
  '","save_mode":"', CASE WHEN event_id % 3 = 0 THEN 'Complete' ELSE 'Draft' END,
  '","entry_date":"', substr(cast(ts as string),1,10), '","entry_time":"', substr(cast(ts as string),12,5),
  '","location":"', CASE WHEN event_id % 4 = 0 THEN '' ELSE 'Pile 2' END,
  '","time_on_pipe_or_pile":"', cast(event_id % 30 as string), '","notes":"n', cast(event_id as string),
  '","comments":"', CASE WHEN event_id % 5 = 0 THEN 'c' ELSE '' END,
  '","operator_initials":" ab', cast(user_id % 9 as string), ' ","cycle_volume_set_point":"', cast(user_id % 5 as string),
  '","zero_refract":"0.1","shutdown_time":"17:00","evaporator_no":"', CASE WHEN event_id % 7 = 0 THEN '' ELSE '2' END,
  '","steam_pressure":"', cast(event_id % 13 as string), '","photo_path":"',
  '","psf1_speed":"', cast(cast(floor(value) as int) as string), ' rpm","cycle1_1_time":"', substr(cast(ts as string),12,5),
  '","cycle1_1_fic1_gpm":"', cast(event_id % 40 as string), '","cycle1_2_tit1":"', CASE WHEN event_id % 2 = 0 THEN '' ELSE '41' END,
  '","cycle', cast(event_id % 6 + 1 as string), '_', cast(user_id % 12 + 1 as string), '_dpt":"', cast(user_id % 7 as string),
  '","cycle1_cycle_number":"1","cycle2_ri_to_sewer":"', CASE WHEN event_id % 3 = 0 THEN '0.5' ELSE '' END,
  '","row1_time":"09:00","row1_feed_rate":"', cast(event_id % 11 as string), '","row2_vacuum":"22","row3_concentrate_ri":"',
  CASE WHEN event_id % 2 = 0 THEN '' ELSE '31' END, '"}') AS form_json
FROM events""",
    # The submit log with the form that each submit sent.
    "fx_submit_forms": """
SELECT s.*, f.form_json FROM fx_submits s JOIN fx_forms f ON f.form_id = s.event_id""",
    # Correction forms of saved sheets, as submitted: new values, initials, overrides and the reason.
    "fx_correction_forms": """
SELECT record_id AS submission_id, 'sheet_entries' AS entry_table, record_id, employee, created_at AS submitted_at,
 concat('{"entry_date":" ', coalesce(entry_date, ''), '","comments":"', CASE WHEN record_id % 3 = 0 THEN 'fixed' ELSE coalesce(comments, '') END,
  '","__change__comments":"', CASE WHEN record_id % 15 = 0 THEN ' ' ELSE 'ab' END, '","__original__comments":"', CASE WHEN record_id % 9 = 0 THEN ' was' ELSE '' END,
  '","rinse_comments":"', CASE WHEN record_id % 2 = 0 THEN 'none' ELSE '' END, '","__change__rinse_comments":"cd","__corrected__rinse_comments":"',
  CASE WHEN record_id % 8 = 0 THEN 'now ' ELSE '' END, '","__session_signature_pad":"x","correction_reason":" typo "}') AS form_json
FROM fx_entries_wide WHERE entry_table = 'sheet_entries'""",
    # Sheets of every run-linked stage with cells of two chartable fields of one
    # of its tables: a timed row, a second row (sometimes past the table's row
    # count, which must be ignored), a payload date on some, and for resistaid /
    # carbon a per-row `date` column that parses as a number (T13).
    "fx_stage_sheets": """
SELECT o_orderkey AS id, o_custkey % 150 AS run_id, st.stage_key, st.stage_title,
 concat('E', cast(o_custkey % 40 as string)) AS employee,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('op', cast(o_custkey % 9 as string)) END AS operator_initials,
 CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE substr(cast(o_orderdate as string),1,10) END AS entry_date,
 CASE WHEN o_orderkey % 4 = 0 THEN 'note' ELSE '' END AS comments,
 concat('{"', st.prefix, '_', cast(o_orderkey % 12 + 1 as string), '_time":"', lpad(cast(o_custkey % 24 as string),2,'0'), ':', lpad(cast(o_orderkey % 60 as string),2,'0'),
  '","', st.prefix, '_', cast(o_orderkey % 12 + 1 as string), '_', st.f1, '":"', CASE WHEN st.f1 = 'date' THEN substr(cast(o_orderdate as string),1,10) ELSE concat(cast(cast(floor(o_totalprice) as bigint) % 100 as string), ' %') END,
  '","', st.prefix, '_', cast(CASE WHEN o_orderkey % 17 = 0 THEN 99 ELSE o_orderkey % 12 + 2 END as string), '_', st.f2, '":"', CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE concat('1,', lpad(cast(o_custkey % 1000 as string),3,'0')) END, '"',
  CASE WHEN o_orderkey % 3 = 0 THEN concat(',"entry_date":"', substr(cast(o_orderdate as string),1,10), '"') ELSE '' END, '}') AS payload_json,
 CASE WHEN o_orderstatus = 'O' THEN 'Draft' ELSE 'Complete' END AS completion_status,
 concat(substr(cast(o_orderdate as string),1,10), 'T', lpad(cast(o_orderkey % 24 as string),2,'0'), ':', lpad(cast(o_custkey % 60 as string),2,'0'), ':00') AS created_at
FROM orders JOIN (VALUES
 (0, 'clarifier', 'Clarifier', 'clarifier_dia', 'feed_ri', 'retentate_ri'),
 (1, 'concentration', 'Concentration', 'concentration', 'product_ri', 'gcv'),
 (2, 'reconcentration', 'Reconcentration', 'reconcentration', 'product_ri', 'h2o2_ppm'),
 (3, 'h2o2_koh_decolorizing', 'H2O2 - KOH Decolorizing', 'koh_h2o2', 'totalizer', 'net_add'),
 (4, 'h2o2_calcium_decolorizing', 'H2O2 - Calcium Decolorizing', 'calcium_additions', 'scale_before', 'net_add_liquid_lb'),
 (5, 'centrifuge', 'Centrifuge', 'centrifuge', 'h2o2_added', 'back_pressure'),
 (6, 'anion_exchange', 'Anion Exchange', 'anion_exchange', 'product_ri', 'output_ri'),
 (7, 'resistaid_anion_exchange', 'ResistAid Anion Exchange', 'resistaid', 'date', 'product_ri'),
 (8, 'carbon_treatment', 'Carbon Treatment', 'carbon_monitoring', 'date', 'vessel_a_ri')
) AS st(k, stage_key, stage_title, prefix, f1, f2) ON st.k = o_orderkey % 9""",
    # The four entry tables and the users table in their own shapes (stored
    # state after the status backfill of O-SRC-3).
    "fx_extraction": """
SELECT record_id AS id, run_id, employee, operator_initials, entry_date, entry_time, location,
 entry_time AS start_time, end_label AS stop_time, psf1_speed, psf1_load, press_blowback, chip_bin_steam,
 comments, photo_path, created_at
FROM fx_entries_wide WHERE entry_table = 'extraction_entries'""",
    "fx_filtration": """
SELECT record_id AS id, run_id, employee, operator_initials, entry_date, entry_time AS startup_time,
 end_label AS shutdown_time, comments, photo_path, payload_json,
 coalesce(nullif(completion_status, ''), 'Complete') AS completion_status, created_at
FROM fx_entries_wide WHERE entry_table = 'filtration_entries'""",
    "fx_evaporation": """
SELECT record_id AS id, run_id, employee, operator_initials, entry_date, evaporator_no,
 entry_time AS startup_time, end_label AS shutdown_time, comments, photo_path, created_at
FROM fx_entries_wide WHERE entry_table = 'evaporation_entries'""",
    "fx_sheets": """
SELECT record_id AS id, run_id, stage_key, stage_title, employee, operator_initials, entry_date, comments,
 CASE record_id % 4 WHEN 1 THEN replace(payload_json, '{"entry_date"', concat('{"run_number":"R', cast(record_id as string), '","production_number":"","entry_date"'))
  WHEN 2 THEN replace(payload_json, '{"entry_date"', '{"run_blend_number":"BL0","entry_date"') ELSE payload_json END AS payload_json,
 coalesce(nullif(completion_status, ''), 'Complete') AS completion_status, created_at
FROM fx_entries_wide WHERE entry_table = 'sheet_entries'""",
}

_FX_NAME = re.compile(r"\bfx_[a-z_]+\b")


def _dependencies(sql: str) -> list[str]:
    """Fixture views referenced by ``sql``, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered or name not in FIXTURE_SQL:
            return
        for dep in _FX_NAME.findall(FIXTURE_SQL[name]):
            if dep != name:
                visit(dep)
        ordered.append(name)

    for name in _FX_NAME.findall(sql):
        visit(name)
    return ordered


def with_fixtures(sql: str) -> str:
    """Prefix ``sql`` with the fixture views it uses (for the DuckDB oracle)."""
    body = sql.strip()
    names = _dependencies(body)
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in names)
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


_REGISTERED: WeakKeyDictionary[SparkSession, str] = WeakKeyDictionary()


def register_base_tables(spark: SparkSession, sf_dir: str) -> None:
    """Expose the parquet test tables under their plain names.

    Spark analyses a DataFrame when it is created, so frames built earlier keep
    the folder they were built from even if another folder is registered later.
    """
    if _REGISTERED.get(spark) == sf_dir:
        return
    for name in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    _REGISTERED[spark] = sf_dir


_MATERIALIZED: WeakKeyDictionary[SparkSession, dict[str, str]] = WeakKeyDictionary()


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view as a Spark DataFrame (analysed against ``sf_dir``).

    When the views of ``sf_dir`` were materialised (``materialize_fixtures``),
    the stored table is read instead of deriving it again.
    """
    stored = _MATERIALIZED.get(spark, {}).get(sf_dir)
    if stored:
        return spark.read.parquet(f"{stored}/{name}")
    sql = with_fixtures(f"SELECT * FROM {name}")
    register_base_tables(spark, sf_dir)
    return spark.sql(sql)


def materialize_fixtures(spark: SparkSession, sf_dir: str, out_dir: str) -> None:
    """Write every fixture view of ``sf_dir`` once as Parquet under ``out_dir`` (shared storage).

    Later ``fixture`` calls read the stored tables, the way deployed process
    tables are read; the derivation cost is paid once.
    """
    _MATERIALIZED.setdefault(spark, {}).pop(sf_dir, None)
    for name in FIXTURE_SQL:
        fixture(spark, sf_dir, name).write.mode("overwrite").parquet(f"{out_dir}/{name}")
    _MATERIALIZED[spark][sf_dir] = out_dir
