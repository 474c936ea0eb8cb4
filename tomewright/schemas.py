"""Schemas of the catalogue's tables, as DDL; nothing is inferred (no date or number guessing)."""

from __future__ import annotations

from pyspark.sql import types as T

DDL = {
    "library": "id int, name string, ingest_path string, not_upscaled_path string, upscaled_path string, upscale_on_ingest boolean, merge_chapter_parts boolean, upscaler_profile_id int, strip_detection_mode int",
    "series": "id int, primary_title string, author string, should_upscale boolean, merge_chapter_parts boolean, library_id int, upscaler_profile_preference_id int",
    "alt_title": "manga_id int, title string",
    "chapter": "id int, manga_id int, file_name string, relative_path string, is_upscaled boolean, upscaler_profile_id int, created_at timestamp, modified_at timestamp",
    "found_chapter": "file_name string, relative_path string, storage_type string, metadata struct<series:string,chapter_title:string,number:string>",
    "filter_rule": "id int, library_id int, pattern string, pattern_type string, target_field string, action string",
    "rename_rule": "id int, library_id int, ord int, pattern string, pattern_type string, target_field string, replacement string",
    "filtered_image": "id int, library_id int, original_file_name string, content_hash string, perceptual_hash bigint, occurrence_count int, last_matched_at timestamp, date_added timestamp",
    "merged_chapter": "id int, chapter_id int, merged_chapter_number string, original_parts array<struct<file_name:string,chapter_number:string,metadata:struct<series:string,chapter_title:string,number:string>,page_names:array<string>,start_page_index:int,end_page_index:int>>",
    "split_finding": "id int, chapter_id int, page_file_name string, split_json string, detector_version int",
    "split_state": "id int, chapter_id int, last_processed_version int, last_applied_version int, status int",
    "upscaler_profile": "id int, name string, method string, scale int, format string, quality int, deleted boolean",
    "task": "id int, data string, status string, ord int, retry_count int, created_at timestamp, processed_at timestamp",
    "api_key": "id int, key string, user_id string, active boolean, expires_at timestamp",
    "log": "id int, timestamp timestamp, level string, exception string, rendered_message string, properties string",
    "page": "archive string, page_name string, ext string, width int, height int, content binary",
    "keep_alive": "task_id int, ts timestamp, total int, current int, status_message string, phase string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])


# Split states as they are stored.
SPLIT_STATES = {0: "Pending", 1: "Detected", 2: "Applied", 3: "Failed", 4: "Processing", 5: "NoSplitsFound"}
LOG_LEVELS = ["Trace", "Debug", "Information", "Warning", "Error", "Critical", "None"]
