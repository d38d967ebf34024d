"""Imports every module that registers queries."""

from batchtrail.plans import q_performance  # noqa: F401
from batchtrail.plans import q_scalars  # noqa: F401
from batchtrail.plans import q_runs  # noqa: F401
from batchtrail.plans import q_feeds  # noqa: F401
from batchtrail.plans import q_lifecycle  # noqa: F401
from batchtrail.plans import q_reshape  # noqa: F401
from batchtrail.plans import q_extra  # noqa: F401
