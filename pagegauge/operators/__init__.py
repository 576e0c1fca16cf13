"""Set-level operators on tables of page captures."""
