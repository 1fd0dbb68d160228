"""Operators for preparing training data; nothing else in gridloom imports them."""
