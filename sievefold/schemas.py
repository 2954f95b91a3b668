"""Column types of payloads and stored tables, as DDL."""

from __future__ import annotations

BOARD_A = """count BIGINT, results ARRAY<STRUCT<id: STRING, created: STRING, title: STRING, description: STRING, redirect_url: STRING,
company: STRUCT<display_name: STRING>, location: STRUCT<display_name: STRING, area: ARRAY<STRING>>, latitude: DOUBLE, longitude: DOUBLE,
salary_min: DOUBLE, salary_max: DOUBLE, salary_is_predicted: STRING, contract_time: STRING, contract_type: STRING, category: STRUCT<label: STRING, tag: STRING>>>"""
BOARD_B = """totalCount BIGINT, jobs ARRAY<STRUCT<id: STRING, title: STRING, location: STRING, snippet: STRING, salary: STRING,
source: STRING, type: STRING, link: STRING, company: STRING, updated: STRING>>"""
LISTING = """source STRING, source_id STRING, url STRING, title STRING, company STRING, description STRING, location_raw STRING,
latitude DOUBLE, longitude DOUBLE, salary_min DOUBLE, salary_max DOUBLE, salary_is_predicted BOOLEAN, posted_date TIMESTAMP,
provider_matched_term STRING, hint_commitment STRING, hint_work_mode STRING, hint_role_type STRING, raw_json STRING"""
MATCHES = """id STRING, listing_id STRING, resume_version_id STRING, base_score INT, fit_score INT, preference_multiplier DECIMAL(4,2),
reasoning STRING, category STRING, compensation STRING, work_mode STRING, commitment STRING, duration_weeks INT, status STRING, model STRING,
scored_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP"""
SOURCES = """name STRING, enabled BOOLEAN, poll_interval_minutes INT, max_calls_per_day INT, calls_today INT, quota_reset_at TIMESTAMP,
last_polled_at TIMESTAMP, last_success_at TIMESTAMP, last_error STRING, consecutive_failures INT, updated_at TIMESTAMP"""
APP_SETTINGS = """id INT, is_paused BOOLEAN, notify_score_threshold INT, max_notifications_per_day INT, scoring_enabled BOOLEAN, scoring_batch_size INT,
max_scoring_spend_usd_per_cycle DECIMAL(8,4), max_scoring_spend_usd_per_day DECIMAL(8,4), scoring_spend_today DECIMAL(10,6), scoring_spend_reset_at TIMESTAMP, updated_at TIMESTAMP"""
NOTIFICATION_LOG = "id STRING, match_id STRING, channel STRING, chat_id STRING, message_id BIGINT, payload STRING, status STRING, error STRING, sent_at TIMESTAMP"
