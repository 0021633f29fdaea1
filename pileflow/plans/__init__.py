"""Whole-run plans: from reads and regions to reports."""
