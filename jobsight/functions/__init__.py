"""Scalar rules as Column -> Column functions (no UDFs)."""

from jobsight.functions.payload import dict_or_string, get_or_default, join_names
from jobsight.functions.salary import with_parsed_salary
from jobsight.functions.text import (
    absolute_url,
    blank_to_null,
    clean_education,
    clean_experience,
    clean_number,
    date_part,
    default_text,
    detect_country,
    first_truthy,
    format_millions,
    format_salary_range,
    indeed_job_type,
    join_degrees,
    map_years,
    midpoint,
    normalize_job_type,
    py_strip,
    remote_flag,
    strip_html,
    years_label,
)

__all__ = [
    "absolute_url", "blank_to_null", "clean_education", "clean_experience",
    "clean_number", "date_part", "default_text", "detect_country",
    "dict_or_string", "first_truthy", "format_millions", "format_salary_range",
    "get_or_default", "indeed_job_type", "join_degrees", "join_names", "map_years",
    "midpoint", "normalize_job_type", "with_parsed_salary", "py_strip", "remote_flag",
    "strip_html", "years_label",
]
