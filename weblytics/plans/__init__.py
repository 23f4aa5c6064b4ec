"""Multi-step jobs (training, scoring, publishing) and the query catalogue."""
