"""Cleaning plans: ordered steps with undo, redo and an audit table."""

from .plan import CleaningPlan, Step, review_progress, target_columns

__all__ = ["CleaningPlan", "Step", "review_progress", "target_columns"]
