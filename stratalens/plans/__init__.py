"""The named queries; every module here has queries() and oracle_sql()."""

from __future__ import annotations


def modules() -> list:
    from stratalens.plans import dirty_data, library, media, records  # noqa: F401  media and records register with library

    return [library, dirty_data]
