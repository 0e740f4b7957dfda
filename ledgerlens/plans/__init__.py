"""Query catalog and plan-level helpers (skew-aware joins and windows)."""
