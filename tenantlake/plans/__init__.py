"""Domain views over the shared tables and the registered queries."""

from tenantlake.plans import cleansing, governance, indexes, lake, loads, ocr, operations, quality, serving, statements, streams  # noqa: F401
from tenantlake.plans.registry import REGISTRY  # noqa: F401
