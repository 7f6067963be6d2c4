from shelfwise.functions.arrays import (
    build_year_map,
    distinct_array_elements,
    expand_struct,
    explode_nested,
    one_hot_array,
    parse_nested_ids,
)
from shelfwise.functions.parsing import parse_price, parse_release_year, try_numeric
from shelfwise.functions.text import (
    capitalize,
    format_percent,
    percent_text,
    round_half_even,
    split_part,
    title_case,
    trim_left,
    trim_right,
    word_count,
)

__all__ = [
    "build_year_map",
    "capitalize",
    "distinct_array_elements",
    "expand_struct",
    "explode_nested",
    "format_percent",
    "one_hot_array",
    "parse_nested_ids",
    "parse_price",
    "parse_release_year",
    "percent_text",
    "round_half_even",
    "split_part",
    "title_case",
    "trim_left",
    "trim_right",
    "try_numeric",
    "word_count",
]
