"""plumbline: market-value reconciliation jobs on PySpark DataFrames."""

from plumbline.config import SuiteConfig
from plumbline.sources.tables import TableSet

__all__ = ["SuiteConfig", "TableSet"]
