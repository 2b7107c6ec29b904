"""Imports every query module so the registry is complete."""

from tallyspark.plans import q_rules  # noqa: F401
from tallyspark.plans.registry import ORACLES, QUERIES  # noqa: F401
from tallyspark.plans import q_matching  # noqa: F401,E402
from tallyspark.plans import q_quality  # noqa: F401,E402
from tallyspark.plans import q_scalars  # noqa: F401,E402
from tallyspark.plans import q_sources  # noqa: F401,E402
from tallyspark.plans import q_statements  # noqa: F401,E402
from tallyspark.plans import q_marketplace  # noqa: F401,E402
from tallyspark.plans import q_passes  # noqa: F401,E402
