"""Operators: value frequencies, profiles, detectors, score, cleaning, summaries, audits."""
