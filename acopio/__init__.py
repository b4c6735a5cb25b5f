"""Consolidation, cleaning, star-schema and segmentation operators on Spark DataFrames."""

from .functions.similarity import map_sex
from .functions.text import normalize_text
from .operators.cleaning import (base_clean, convert_types, normalize_institutions, normalize_sex, nullify_tokens,
                                 trim_footer)
from .operators.matching import variant_report
from .plans.ingest import clean_master
from .session import build_session
from .sources.files import scan_master, write_csv

__all__ = ["base_clean", "build_session", "clean_master", "convert_types", "map_sex", "normalize_institutions",
           "normalize_sex", "normalize_text", "nullify_tokens", "scan_master", "trim_footer", "variant_report", "write_csv"]
