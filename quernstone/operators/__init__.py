"""Preprocessing operators: fit/transform steps and plain DataFrame functions."""
