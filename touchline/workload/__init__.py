"""Bindings of the operators to the test tables, with an oracle query for each."""
