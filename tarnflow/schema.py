"""Schemas of the library's tables, in the form that Spark readers take."""

DOCUMENT = "doc_id long, content string, regulation_type string, priority string, chemical_type string, source_file string"
CHUNK = "id string, content string, score double, rank int, metadata map<string,string>, retrieval_method string"
AUDIT = "id long, user_id string, operation string, details string, is_sensitive boolean, create_time timestamp"
SESSION = "session_id string, session_type string, created_at timestamp, last_updated timestamp"
TURN = "session_id string, turn int, role string, content string, ts timestamp"
WAREHOUSE = "chemical_name string, chemical_type string, quantity double, storage_location string, update_time timestamp"
EHS = "ticket_id string, title string, description string, priority string, is_completed boolean, create_time timestamp"
SEARCH_LOG = "query string, results_count int, execution_time_ms int, source_priority string, created_at timestamp"
