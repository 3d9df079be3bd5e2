"""Named queries over the given tables, with their SQL."""


def load_all():
    """Import every plan module and return (queries, oracles)."""
    from barwright.plans import bundle, distribution, features, filings, price, quality, reports, scans, series, stationarity  # noqa: F401
    from barwright.plans.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
