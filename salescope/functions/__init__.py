"""Column-level rules: pure functions from Column to Column, all JVM-side."""

from salescope.functions.codes import code_length_rejected
from salescope.functions.coercion import (
    NA_TOKENS,
    null_tokens_to_null,
    parse_invoice_timestamp,
    to_number,
)
from salescope.functions.names import normalise_product_name, remove_quotes_and_slashes, rtrim_unicode

__all__ = [
    "NA_TOKENS",
    "code_length_rejected",
    "normalise_product_name",
    "null_tokens_to_null",
    "parse_invoice_timestamp",
    "remove_quotes_and_slashes",
    "rtrim_unicode",
    "to_number",
]
