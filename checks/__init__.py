"""Registered queries and the SQL that checks them, side by side."""
