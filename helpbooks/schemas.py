"""Schemas of the tables that jobs read and write."""

ENTRIES = "book_id string, ordinal long, path string, size long, content binary"
SITEMAPS = "book_id string, kind string, text string"
NODES = "book_id string, kind string, ordinal long, parent_ordinal long, depth int, name string, locals array<string>"
TOC_NODES = "book_id string, node_id string, parent_id string, ordinal long, depth int, name string, local_path string"
INDEX_ENTRIES = "book_id string, entry_id string, ordinal long, name string, local_paths array<string>, depth int"
PAGES_TEXT = "book_id string, path string, title string, text string"
POSTINGS = "book_id string, path string, field string, term string, tf long, first_pos long"
INDEX_PAGES = "book_id string, path string, title string, text string, sha256 string, has_words boolean"
INDEX_POSTINGS = f"{POSTINGS}, page_words long, first_field boolean, lead string"
INDEX_TERMS = "term string, df long, tf long, lead string"
INDEX_ABOUT = "pages long, words long, text_chars long, postings long, term_sketch binary"
QUERIES = "query_id long, book_id string, q string"
HITS = "query_id long, book_id string, path string, title string, rank long, score double, excerpt string"
MANIFEST = "book string, path string, size long, sha256 string, tools array<string>"
REQUESTS = "request_id long, ts timestamp, url string"
NAV_EVENTS = "session_id string, ts timestamp, seq long, action string, url string"
NAV_STATES = "session_id string, ts timestamp, seq long, action string, current_url string, can_back boolean, can_forward boolean"
OPENS = "user_id string, ts timestamp, seq long, file_path string"
KEYSTROKES = "session_id string, ts timestamp, query string"
MANIFEST_JSON = "map<string, map<string, struct<size: bigint, sha256: string, tools: array<string>>>>"
