"""Operators composed into whole profile workflows and table queries."""
