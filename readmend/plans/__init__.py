"""Whole runs composed of the operators, and the command line."""
