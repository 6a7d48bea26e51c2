"""Named queries; importing this package fills the registry."""

from twinside.plans import aggregates, gates, ledger, models, patterns, scalars, sources, views, windows  # noqa: F401
from twinside.plans.base import registry  # noqa: F401
