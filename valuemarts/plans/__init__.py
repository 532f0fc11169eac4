"""The marts: conformed views, RFM, cohorts, revenue at risk, presentation."""
