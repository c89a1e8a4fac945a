"""Declarative plans: views, reports and ready-made pipelines."""
