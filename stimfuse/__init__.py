"""Stimulus/response fusion analytics as Spark DataFrame operators."""
