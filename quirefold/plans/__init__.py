"""All registered queries of the notation and document operators."""

from . import assembly, control, geometry, more, notation, profiles, progress, shelf, streams, text  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
