"""Schemas of the engine's tables, as Spark DDL."""

FILES = "path string, size long, hash string, content string"
CHUNKS = "path string, lang string, start_line int, end_line int, symbol string, text string"
SYMBOLS = "id long, name string, qualified string, kind string, path string, start_line int, end_line int"
CALLS = "call_id long, caller_id long, callee string, path string, line int"
CHANGES = "path string, start int, end int, deletion_only int"
MANIFEST = "path string, hash string"
EVAL_ITEMS = "item_id long, query string, gold_path string, gold_start int, gold_end int, source string"
