"""Scoring of unbounded tables by frozen calibrations."""
