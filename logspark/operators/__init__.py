"""Analytic operators: search, rollups, sessions, reports, errors, anomalies, alerts."""
