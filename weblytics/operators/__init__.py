"""Query operators: exploration, reports, metric tables, visitor history,
feature sets and model evaluation.  Each takes and returns DataFrames."""
