"""Loads every module of this folder that registers a query."""

from veta.llm import (bpe, filter_audit, language, lexical_search, licenses, main_text, mixing, multiset, phrases, repeats, rotated_codes, simhash,  # noqa: F401
                      warc)  # noqa: F401
from veta.llm.common import ORACLES, QUERIES  # noqa: F401
