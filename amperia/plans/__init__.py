"""Whole dataflows: reconciliation of events and readings, reliability views."""
