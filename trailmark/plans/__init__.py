from trailmark.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
