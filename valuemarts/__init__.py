"""valuemarts — customer-value marts on Spark.

Staging tables with data-quality checks, conformed facts keyed by a stable
customer identity, RFM scores and segments, monthly cohort retention,
revenue at risk and the delivery-delay / review-score link, as lazy
DataFrame-to-DataFrame functions (``valuemarts.plans``) that can also be
registered as SQL views (``Marts.register_views``).
"""

from .plans.marts import Marts  # noqa: F401
from .session import checkpoint_dir, local_session  # noqa: F401
