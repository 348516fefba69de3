"""The four-table star the rankings read, and its column names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Column names of the star (snake_case versions of the source model).
COUNTRY = "country"
PRODUCT_CODE = "product_code"
PRODUCT_NAME = "product_name"
INVOICE_NO = "invoice_no"
INVOICE_DATE = "invoice_date"
SALES = "sales"
# Optional partition column of stored invoices (year of invoice_date).
INVOICE_YEAR = "invoice_year"

# Declared widths of the source model's character columns and the integer range
# of the invoice number column (fixed values of the source schema).
MAX_LEN_COUNTRY = 30
MAX_LEN_PRODUCT_CODE = 20
MAX_LEN_PRODUCT_NAME = 50
INVOICE_NO_MIN = -2147483648
INVOICE_NO_MAX = 2147483647


@dataclass(frozen=True)
class Star:
    """countries(country), products(product_code, product_name),
    invoices(invoice_no, invoice_date, country), lines(invoice_no, product_code)."""

    countries: DataFrame
    products: DataFrame
    invoices: DataFrame
    lines: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {
            "countries": self.countries,
            "products": self.products,
            "invoices": self.invoices,
            "invoice_lines": self.lines,
        }
