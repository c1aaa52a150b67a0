"""All registered queries: importing a suite registers its queries."""

from populi.plans import (cleaning_suite, incremental_suite, journey_suite, matching_suite, metrics_suite,  # noqa: F401
                          rollup_suite, sampling_suite, sources_suite, text_suite, vector_suite)
from populi.plans.testbed import REGISTRY

__all__ = ["REGISTRY"]
