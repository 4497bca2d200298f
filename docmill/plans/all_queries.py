"""Imports every module that registers queries."""
from . import text_queries  # noqa: F401
from . import report_queries  # noqa: F401
from . import search_queries  # noqa: F401
from . import graph_queries  # noqa: F401
from . import stream_queries  # noqa: F401
from . import file_queries  # noqa: F401
