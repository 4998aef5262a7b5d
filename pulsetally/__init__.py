"""Event analytics on Spark: validate, store, aggregate and report user-activity events."""

__version__ = "0.1.0"
