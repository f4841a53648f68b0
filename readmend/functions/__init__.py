"""Column functions and the small Arrow helpers used inside tasks."""
