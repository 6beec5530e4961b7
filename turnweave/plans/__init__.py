"""Whole plans over the operators, and the driver's queries."""
