"""Each operator on the sample tables, beside its SQL."""
