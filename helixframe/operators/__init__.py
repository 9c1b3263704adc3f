"""The rules, one query each."""
