"""All registered queries (importing a module registers its queries)."""

from . import q_geometry, q_history, q_pixels, q_reports, q_review  # noqa: F401
from .registry import CATALOG  # noqa: F401
