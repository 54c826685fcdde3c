"""Composed jobs: role mapping, KPI views, feature frames and the query registry."""
