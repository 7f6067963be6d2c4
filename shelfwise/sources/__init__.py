from shelfwise.sources.readers import (
    parse_literal_records,
    scan_csv_gz,
    scan_json_lines,
    scan_lexicon,
    scan_literal_lines,
    scan_parquet,
)
from shelfwise.sources.scratch import scratch_path
from shelfwise.sources.writers import write_csv_gz, write_json_gz, write_parquet

__all__ = [
    "parse_literal_records",
    "scan_csv_gz",
    "scan_json_lines",
    "scan_lexicon",
    "scan_literal_lines",
    "scan_parquet",
    "scratch_path",
    "write_csv_gz",
    "write_json_gz",
    "write_parquet",
]
