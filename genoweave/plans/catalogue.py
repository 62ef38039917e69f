"""All queries of the library's own operators and their SQL twins."""

from __future__ import annotations

from . import views  # isort: skip
from . import q_base, q_network, q_report  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
