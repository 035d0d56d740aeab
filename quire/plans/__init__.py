"""Composed jobs: refresh plan (R-4), search report (R-5), answer report (R-6), prompts (R-3)."""
