"""lendwise: circulation analytics for a lending library, written as plain PySpark DataFrame jobs.

Layout:
  sources/    typed table schemas, loaders, batch sinks, and the projection of the driver test tables
  functions/  column-level helpers (ordered distinct concat, date display, money text, ...)
  operators/  views, example queries, reports, data-quality checks, admission rules, distributed rank
  plans/      physical-plan inspection helpers used by tests and the bench
  streaming/  Structured Streaming wrapper around the admission rules
"""

from lendwise.session import build_session, ensure_checkpoint_dir  # noqa: F401
from lendwise.sources.tables import Tables  # noqa: F401
