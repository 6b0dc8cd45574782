"""Predicate specs, time ranges and skew-safe join shapes."""
