"""Sources and sinks: delimited text with dialect detection, writers, audit log."""

from .audit import append_log, read_log
from .delimited import Dialect, head_rows, load_files, load_summary, normalize_header, read_delimited, sniff
from .sinks import count_written, write_json, write_table

__all__ = ["append_log", "read_log", "Dialect", "head_rows", "load_files", "load_summary", "normalize_header",
           "read_delimited", "sniff", "count_written", "write_json", "write_table"]
