"""Import every module that registers queries."""

from . import landcover_queries  # noqa: F401
from . import expression_queries  # noqa: F401
from . import pairing_queries  # noqa: F401
from . import spatial_queries  # noqa: F401
from . import text_queries  # noqa: F401
from . import ingest_queries  # noqa: F401
from . import tile_queries  # noqa: F401
from . import analysis_queries  # noqa: F401
