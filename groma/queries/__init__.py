"""More site queries by theme; importing this package lists them in ``groma.catalogue``."""

from groma.queries import evidence, frames, plans, records, reports, screens, upkeep  # noqa: F401
