"""hustings."""
