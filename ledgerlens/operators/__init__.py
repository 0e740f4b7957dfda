"""Analytics operators: cleaning (S1-S8), revenue (A1-A4), funnel (A5-A8),
churn (A9-A18) and cohort retention (A19-A22). All are DataFrame -> DataFrame."""
