"""rosterlake: crawled directory pages to governed record tables, on Spark."""

from .session import local_session
from .spec import ColumnRule, RecordSpec, Validation

__all__ = ["ColumnRule", "RecordSpec", "Validation", "local_session"]
