"""Document analytics on Spark: curation, mention linking, evaluation and anonymization as DataFrame operators."""

__version__ = "0.1.0"
